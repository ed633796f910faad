"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np

#: A piece ends before a run of spaces and line feeds, and between a plain Latin letter or
#: digit and one of the marks below. Pre-tokenizers of the byte-level kind never join what stands on
#: both sides of such an end.
PIECE = re.compile(r"[ \n]*+[^ \n.,;:!?|%&$*#]++(?<=[a-zA-Z0-9\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f])|[ \n]*+[^ \n]++|[ \n]++")
#: The same for vocabularies whose pre-tokenizer drops white space.
BARE_PIECE = re.compile(r"[^ \n.,;:!?|%&$*#]++(?<=[a-zA-Z0-9\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f])|[^ \n]++")
#: Other white space may join runs across pieces, so such a text is one piece.
OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
MAX_CACHED, LONGEST_CACHED = 800_000, 64
_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Ids of texts, equal to the library's own over whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = [x.content for x in added if not x.normalized]
        self.added_normal = [self._normal(x.content) for x in added if x.normalized]
        self.top_id = max(self.library.get_vocab(with_added_tokens=True).values())
        self.piece = PIECE if self._ids("\n \n") else BARE_PIECE
        self.place: dict[str, int] = {}
        self.first = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.pieces = self.used = 0

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _normal(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if self.library.normalizer else text

    def _whole(self, text: str) -> bool:
        """Whether a text must not be split: it holds an added token or other white space."""
        if OTHER_SPACE.search(text) or any(x in text for x in self.added):
            return True
        if not self.added_normal:
            return False
        plain = self._normal(text)
        return any(x in plain for x in self.added_normal)

    def _add(self, pieces: list[str]) -> None:
        if not pieces:
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = self.pieces + len(ids), self.used + int(lengths.sum())
        if n > len(self.first):
            self.first, self.length = np.resize(self.first, 2 * n), np.resize(self.length, 2 * n)
        if total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * total)
        self.length[self.pieces : n] = lengths
        self.first[self.pieces : n] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : total] = np.fromiter(chain.from_iterable(ids), np.uint32, total - self.used)
        self.pieces, self.used = n, total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds by text); a null text is empty. Ids of pieces that are not kept, long ones
        and those beyond the cache's size, are forgotten when the batch is done."""
        split = [[] if not t else [t] if self._whole(t) else self.piece.findall(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
        flat = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        kept = self.pieces, self.used
        missing = np.flatnonzero(codes < 0)
        new: dict[str, int] = {}
        if len(missing):
            fresh = dict.fromkeys(flat[i] for i in missing)
            short = [p for p in fresh if len(p) < LONGEST_CACHED]
            new = {p: self.pieces + k for k, p in enumerate(short)}
            self._add(short)
            if len(self.place) + len(new) <= MAX_CACHED:
                self.place |= new
                kept = self.pieces, self.used
            long = [p for p in fresh if len(p) >= LONGEST_CACHED]
            new |= {p: self.pieces + k for k, p in enumerate(long)}
            self._add(long)
            codes[missing] = [new[flat[i]] for i in missing]
        lengths = self.length[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.first[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
        self.pieces, self.used = kept
        return ids, ends[bounds]


def encoder(path: str) -> PieceEncoder:
    """The process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Frees the encoders of a process that goes on with other work."""
    _encoders.clear()


def encode_with_end(path: str, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As `encode`, with the end id after each text."""
    ids, bounds = encoder(path).encode(texts)
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
