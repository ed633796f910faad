"""Main text of web pages by block rules in two passes.

A page is read tag by tag into blocks: runs of text between block-level tags, with counts of words, stop words
and characters inside links. Elements that say what they are (menus, forms, adverts, comments, ...) make
their blocks boilerplate at once. The first pass judges each other block alone: many
links are boilerplate; enough words with enough stop words are text; enough words without them are boilerplate
outside an article; everything short or in between is undecided. In the second pass an undecided block has the
label of the nearest decided one, where blocks of its own container are nearer than any other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_rules import STOP_WORDS

STOPS = frozenset(w.encode() for w in STOP_WORDS)
#: Elements whose content is never text of the page.
SILENT = frozenset("script style title noscript template iframe svg math object canvas audio video map textarea select datalist noframes noembed".split())
#: Elements that are boilerplate with all they hold.
BOILERPLATE = frozenset("nav header footer aside form menu dialog button".split())
#: Block-level elements: their tags end a block.
BLOCKS = frozenset(
    """
    html head body address article aside blockquote caption center col colgroup dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section
    summary table tbody td tfoot th thead tr ul button
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers within which undecided blocks look for a decided one first.
SECTIONS = frozenset("article main section aside nav header footer form body".split())
#: Words of a class, id or role that name what is not the article.
HINTS = frozenset(
    """
    ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar menu menubar nav navbar navigation
    breadcrumb breadcrumbs masthead footer header cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe
    subscription signup login search social share sharing related recommended recommendations comment comments disqus respond reply replies discussion widget
    pagination pager toolbar skip complementary contentinfo
    """.split()
)
#: Words of a class or id that name the article.
MAIN_HINTS = frozenset("article content main post entry story".split())
_NOT_OWN = frozenset("has with no without is js".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"'>]|$)""", re.I)
_WORD_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Lowers A-Z and turns other ASCII than letters into spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Block(NamedTuple):
    text: str
    words: int
    stops: int
    #: Share of the characters that stand in links.
    linked: float
    heading: bool
    #: Whether an element says that it is boilerplate, or part of the article.
    boilerplate: bool
    article: bool
    #: Number of the container.
    section: int


class Rules(NamedTuple):
    """Bounds of the first pass: a block with more than `links` of its characters in links is boilerplate; of
    `words` words or more, a share of `stops` stop words makes it text; of `many_words` or more, one
    under `few_stops` boilerplate."""

    links: float = 0.5
    words: int = 12
    stops: float = 0.25
    many_words: int = 20
    few_stops: float = 0.04


def _hints(attributes: str) -> tuple[bool, bool]:
    """Whether class, id, role or style say that an element is boilerplate, or the article."""
    bad = good = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            bad = True
        elif name in ("class", "id", "role"):
            for token in value.split():
                parts = [p.lower() for p in _WORD_PARTS.findall(token)]
                if parts and parts[0] not in _NOT_OWN:
                    bad |= parts[0] in HINTS or parts[-1] in HINTS
                    good |= parts[-1] in MAIN_HINTS or parts[0] in MAIN_HINTS
    return bad, good and not bad


class _Open(NamedTuple):
    tag: str
    bad: bool
    article: bool
    section: int
    #: Of boilerplate that may wrap a whole page: 1 if a main element inside is text after all, 2 if an article is too.
    wrapper: int


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in its order. Character references are decoded, white space inside a block is one
    space, blocks without characters are left out. Tags are matched as they come: an end without a
    start is ignored, and what is still open at the end of the page ends there."""
    out: list[Block] = []
    top = _Open("", False, False, 0, 0)
    stack, pieces, link_from, link_chars, chars = [top], [], -1, 0, 0
    opened: Counter[str] = Counter()  # by name, so that an end without a start is not looked for
    sections, heading, at, tag = 0, False, 0, _TAG

    def end_block() -> None:
        nonlocal pieces, link_chars, chars
        if pieces:
            words = "".join(pieces).split()
            if words:
                text, here = " ".join(words), stack[-1]
                stops = 0 if here.bad else sum(map(STOPS.__contains__, text.encode(errors="replace").translate(_LETTERS).split()))
                out.append(Block(text, len(words), stops, link_chars / max(chars, 1), heading, here.bad, here.article, here.section))
            pieces = []
        link_chars = chars = 0

    def add(text: str) -> None:
        nonlocal link_chars, chars
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            solid = len(text.strip())
            chars += solid
            link_chars += solid if link_from >= 0 else 0

    def push(o: _Open) -> None:
        stack.append(o)
        opened[o.tag] += 1

    def pop_to(size: int) -> None:
        nonlocal link_from
        for o in stack[size:]:
            opened[o.tag] -= 1
        del stack[size:]
        if link_from >= size:
            link_from = -1

    while True:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            add(page[at:lt])
            close = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
            if close < 0:
                break  # nothing after an open comment is text
            at = close + (3 if page[close] == "-" else 1)
            continue
        if not (follows.isalpha() and follows.isascii()) and follows != "/":
            add(page[at : lt + 1])  # a sign, not a tag
            at = lt + 1
            continue
        m = tag.match(page, lt)
        if m is None and tag is _TAG and _PLAIN_TAG.match(page, lt):
            tag = _PLAIN_TAG  # a quote is open to the end of the page: from here on quotes do not count
            m = tag.match(page, lt)
        if m is None:
            add(page[at:lt])
            if follows == "/" and not page[lt + 2 : lt + 3].isalpha():
                close = page.find(">", lt)
                if close >= 0:
                    at = close + 1
                    continue
            break  # the page ends inside a tag
        add(page[at:lt])
        at = m.end()
        name, attributes = m[2].lower(), m[3]
        if m[1]:
            if name in HEADINGS or name in BLOCKS:
                end_block()
                heading = heading and name not in HEADINGS
                for k in range(len(stack) - 1, 0, -1) if opened[name] else ():
                    if stack[k].tag == name:
                        pop_to(k)
                        break
            elif name == "a":
                link_from = -1
            elif stack[-1].bad and opened[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        end_block()
                        pop_to(k)
                        break
                    if stack[k].tag in BLOCKS:
                        break
            continue
        if name in SILENT:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if end is None:
                    end_block()
                    return out
                at = end.end()
            continue
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            continue
        bad, good = _hints(attributes) if attributes and not attributes.isspace() and name not in ("html", "body") else (False, False)
        if name not in BLOCKS:
            if name == "a":
                link_from = len(stack) - 1
            here = stack[-1]
            if bad and not here.bad:
                end_block()
            if bad or here.bad:
                push(here._replace(tag=name, bad=True))
            continue
        end_block()
        if stack[-1].tag == "p":  # a block ends an open paragraph
            pop_to(len(stack) - 1)
        if name in ("li", "dd", "dt", "tr", "td", "th", "option"):  # and an item the one before it
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in same) else ():
                if stack[k].tag in same:
                    pop_to(k)
                    break
                if stack[k].tag in ("ul", "ol", "menu", "dl", "table") or (stack[k].tag == "tr" and name in ("td", "th")):
                    break
        here = stack[-1]
        heading = heading or name in HEADINGS
        if not bad and not good and name not in SECTIONS and name not in BOILERPLATE:
            push(_Open(name, here.bad, here.article, here.section, here.wrapper))
            continue
        if name == "main" or (name == "article" and not here.article and not bad):
            state = here._replace(bad=here.bad and here.wrapper < (1 if name == "main" else 2), article=True, wrapper=0)
        elif name == "article" and here.article and opened["article"]:
            state = here._replace(bad=True)  # an article within an article is a comment on it
        else:
            own = bad or name in BOILERPLATE
            if name == "header" and here.article:
                own = bad and not any(p in attributes for p in ("header", "masthead"))  # the article's own head
            own = own and not (here.article and name in HEADINGS)
            wrapper = here.wrapper if here.bad else (2 if name == "form" else 1) if own and name in ("form", "div", "section") else 0
            state = here._replace(bad=here.bad or own, article=here.article or (good and not here.bad and not own), wrapper=wrapper)
        if name in SECTIONS or bad or state.article != here.article or state.bad != here.bad:
            sections += 1
            state = state._replace(section=sections)
        push(state._replace(tag=name))
    end_block()
    return out


def first_pass(b: Block, rules: Rules = Rules()) -> bool | None:
    """Whether a block is text by its own words: None if they do not decide."""
    if b.boilerplate or b.linked > rules.links:
        return False
    if not b.article and "©" in b.text:
        return False
    if not b.heading:
        share = b.stops / b.words
        if b.words >= rules.words and share >= rules.stops:
            return True
        if b.words >= rules.many_words and share < rules.few_stops and not b.article:
            return False
    return None


def second_pass(blocks: list[Block], first: list[bool | None]) -> list[bool]:
    """Labels of all blocks. An undecided block takes the nearest decided one of its container, before any other of the
    page; of two as near it takes the text, and a heading the one behind it. An article or main element
    that decides nothing itself is text, and so are the undecided blocks of a page where none is decided to be text."""
    if True not in first:
        return [label is None for label in first]
    n = len(blocks)
    far = 1 << 30

    def sweep(order: range, same: bool) -> list[tuple[int, bool]]:
        """Distance and label of the last decided block, of the same container or of any."""
        last: dict[int, tuple[int, bool]] = {}
        found = [(far, False)] * n
        for k in order:
            key = blocks[k].section if same else 0
            if first[k] is not None and not blocks[k].boilerplate:
                last[key] = (k, first[k])
            elif key in last:
                found[k] = (abs(k - last[key][0]), last[key][1])
        return found

    near = [(sweep(range(n), same), sweep(range(n - 1, -1, -1), same)) for same in (True, False)]
    out = []
    for k, b in enumerate(blocks):
        label = first[k]
        if label is None:
            for before, after in near:
                (x, left), (y, right) = before[k], after[k]
                if b.heading and y < far:
                    label = right
                elif x < far or y < far:
                    label = left if x < y else right if y < x else left or right
                if label is not None or b.article:
                    break
            label = True if label is None else label
        out.append(label)
    return out


def main_text(page: str, rules: Rules = Rules()) -> str:
    """The blocks of a page that are text, joined by one space."""
    blocks = page_blocks(page)
    keep = second_pass(blocks, [first_pass(b, rules) for b in blocks])
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_text(pages: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url"), rules: Rules = Rules()) -> DataFrame:
    """A row for each row of `pages`: the columns of `carry`, text, n_chars (its code points).

    A null or empty page has an empty text, as has one that is boilerplate alone. Repeated rows and
    ids appear as often as they come, nulls in carried columns stay. A page is read whole, once, in time that
    grows with its length. Other columns are not read; an empty table gives no rows. Nothing is shuffled.
    """
    d = pages.select(*carry, F.col(html_col).alias("_html"))
    fields = T.StructType([*(d.schema[c] for c in carry), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 500):
                batch = whole.slice(i, 500)
                texts = [main_text(x, rules) if x else "" for x in batch["_html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=fields.names)

    return d.mapInArrow(run, fields)
