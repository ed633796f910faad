"""Small cases of the training-data operators: nulls, empty tables, ties, clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.llm import katz_lm, ngram_jaccard, packing
from panelworks.llm.components import connected_components
from panelworks.llm.embedding_dedup import embedding_dedup
from panelworks.llm.huffman_ids import canonical_codes, code_lengths, decode_block, decode_slice, decode_table, encode_block, open_block, read_ids, read_some, write_ids
from panelworks.llm.mixing import fit_mixture, mixed, mixing_rates
from panelworks.llm.ngram_jaccard import jaccard_components
from panelworks.llm.packing import BestFit, pack_documents
from panelworks.llm.quality_classifier import quality_classifier
from panelworks.llm.quality_rules import quality_rules
from panelworks.llm.sharding import assign_slots, edit_map, moves, read_map, rebalance, shard
from panelworks.llm.tokenization import PieceEncoder
from panelworks.llm.warc_archive import read_archive, write_archive

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, kept string, size string"


def docs(spark, rows):
    """Rows of (id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", "y") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "tree", "river", "stone", "cloud", "light", "road", "song", "to", "in"]) + rng.choice(["", "s", "ly", "er"]) for _ in range(n))


def test_quality_rules(spark):
    good = prose(random.Random(1), 120)
    junk = " | ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, good), (3, None), (4, ""), (5, junk), (6, "a b c " * 40), (None, good), (7, "x" * 200_000)]
    r = {x.doc_id: x for x in quality_rules(docs(spark, rows)).collect()}
    assert r[1].kept and r[2].kept and r[None].kept and not r[5].kept
    assert r[3].n_words == 0 and r[3].base_failed and r[4].base_failed
    assert r[6].n_repeat_words == 120 and r[6].base_failed
    assert r[7].word_chars == 200_000 and r[7].n_words == 1
    assert quality_rules(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 20] + (0.02 * base[20 + i % 7] if i % 3 else 0)], i % 20 % 4) for i in range(60)]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [1.0] * 16, None), (103, [float("nan")] * 16, 1), (104, rows[0][1], rows[0][2]), (105, [None] + [1.0] * 15, 1), (106, [], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"key": F.lit(1), "n": F.lit(2)})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(d).collect()}
    ok = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    link = collections.defaultdict(set)
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2] == b[2] and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98:
                link[a[0]].add(b[0])
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for y in link[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[i] == (len(link[i]), min(seen), min(seen) == i)
    assert embedding_dedup(d.limit(0)).count() == 0


def test_embeddings_with_several_tables(spark):
    """Every link of two thousand vectors is found, each pair once, also inside families larger than a block."""
    from panelworks.llm import embedding_dedup as near

    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 24))
    v = [base[k] + 0.08 * rng.normal(size=24) for k in range(300) for _ in range(4)] + [base[0] + 0.02 * rng.normal(size=24) for _ in range(700)]
    v = np.array(v).astype(np.float32).astype(float)
    bits, tables = near.table_shape(len(v), 1)
    assert bits > 5 and tables > 8
    d = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.98
    np.fill_diagonal(link, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup(d).collect()}
    assert [got[i] for i in range(len(v))] == link.sum(1).tolist() and link.sum() > 400_000
    classes = d.select(F.col("vec_id").alias("cls"), F.lit(0).cast("long").alias("label"), F.col("embedding").alias("vec"))
    pairs = [tuple(r) for r in near.embedding_links(classes).collect()]
    assert len(pairs) == len(set(pairs)) == link.sum() // 2 and all(a < b for a, b in pairs)


def test_archive(spark):
    big = "<p>" + "é" * 900
    rows = [(1, "u1", big), (2, "u2\r\nX: y", big), (3, "u3", big), (4, "u4", "small"), (5, None, "small"), (6, "u6", None), (3, "u3", big)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "copy": F.lit(2)})
    a = write_archive(d)
    assert a.payloads.count() == 3
    r = sorted(read_archive(a).collect(), key=lambda x: (x.page_id, x.copy))
    assert [(x.page_id, x.record_type, x.refers_to) for x in r] == [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "response", None), (6, "response", None)]
    assert bytes(r[0].payload).decode() == big and r[6].payload_bytes == 0
    for x in r:
        head, body = bytes(x.record)[:-4].split(b"\r\n\r\n", 1)
        assert len(body) == int(re.search(rb"Content-Length: (\d+)", head)[1])
    broken = a._replace(payloads=a.payloads.withColumn("payload", F.concat("payload", F.lit(b"x"))))
    with pytest.raises(Exception, match="damaged"):
        read_archive(broken).collect()
    assert read_archive(write_archive(d.limit(0))).count() == 0


def test_sharding(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(400)) for i in range(3000)] + [(None, None)] * 3 + [(7, "same")] * 5
    r = shard(docs(spark, rows), 24).collect()
    sizes, places = collections.Counter(), collections.defaultdict(list)
    for x in r:
        sizes[x.shard] += x.size
        places[x.shard].append(x.place)
    assert len(r) == len(rows) and max(sizes.values()) - min(sizes.values()) < 500
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    text = dict(rows)
    for x in r:
        body = (text[x.doc_id] or "").encode()
        assert (x.doc_id == 7 or (x.size, x.text_crc32) == (len(body) + 8, zlib.crc32(body))) and 0 <= x.shard < 24
    assert sorted((x.size, x.text_crc32) for x in r if x.doc_id == 7) == sorted((len(t) + 8, zlib.crc32(t.encode())) for i, t in rows if i == 7)
    totals = [(s, rng.randrange(1, 100), 1) for s in range(1000)]
    old = assign_slots(totals, 10)
    new = edit_map(old, totals, 11)
    load = collections.Counter()
    for s, b, _ in totals:
        load[new[s]] += b
    assert sum(old[s] != new[s] for s in old) < 200 and max(load.values()) - min(load.values()) < 100
    assert shard(docs(spark, []), 24).count() == 0


def test_rebalance_edits_the_stored_map(spark, tmp_path):
    rng, store = random.Random(13), f"file://{tmp_path}/map"
    rows = [(i, "x" * rng.randrange(300)) for i in range(4000)]
    d = docs(spark, rows)
    shard(d, 10, slots=512, store=store)
    grown = d.unionByName(docs(spark, [(i, "new " * 20) for i in range(4000, 4400)]))
    for version, (data, shards) in enumerate([(d, 11), (grown, 11), (grown, 9)], 2):
        placed = rebalance(data, store, shards, slots=512).collect()
        sizes, places = collections.Counter(), collections.defaultdict(list)
        for x in placed:
            assert x.version == version
            sizes[x.shard] += x.size
            places[x.shard].append(x.place)
        assert set(sizes) == set(range(shards)) and max(sizes.values()) < 1.05 * min(sizes.values())
        assert all(sorted(p) == list(range(len(p))) for p in places.values())
        assert read_map(spark, store).agg(F.max("version")).first()[0] == version
    first = moves(spark, store, 1, 2).collect()
    total = read_map(spark, store, 2).agg(F.sum("bytes")).first()[0]
    assert sum(r.bytes for r in first if r.to_shard == 10) > 0.6 * sum(r.bytes for r in first) and sum(r.bytes for r in first) < 1.6 * total / 11
    last = moves(spark, store, 3, 4).collect()
    assert sum(r.bytes for r in last if r.from_shard < 9) < 0.4 * sum(r.bytes for r in last)
    kept = {r.vslot: r.shard for r in read_map(spark, store, 1).collect()}
    assert sum(kept[r.vslot] == r.shard for r in read_map(spark, store, 2).collect()) > 450


def test_piece_cache_does_not_leak():
    e = PieceEncoder(str(P.path("byte_bpe_50k.json")))
    for n in range(4):
        texts = [f"tab\t{'q' * 70}{n}{k} <|endoftext|> " + "z" * 100 for k in range(300)] + ["plain words"] + ["long " * 50_000]
        ids, bounds = e.encode(texts)
        used = e.pieces, e.used, len(e.place)
        assert n == 0 or used == before
        before = used
        assert list(ids[bounds[3] : bounds[4]]) == e._ids(texts[3]) and list(ids[bounds[-2] :]) == e._ids(texts[-1])


def test_equal_pieces_are_spread(spark):
    rows = packing.token_pieces(docs(spark, [(5, "the same text")] * 4000), str(P.path("byte_bpe_50k.json")), 2)
    sizes = [r["count"] for r in rows.repartition(40, "deal").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 100 and packing.pack(rows, task_pieces=100).count() >= 4000 * 4 // 1024


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    rng, e = random.Random(1), PieceEncoder(str(P.path(name)))
    alphabet = list("ab eE'sdté ñß.,;:!?|%&$*#()-_\n\n  0129") + ["\t", "\xa0", "́", "Σ", "İ", "don't", "<|endoftext|>", "日本", "क़", "²", "🙂", "\r\n", ".̸"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, "", "\n"]
    ids, bounds = e.encode(texts)
    assert all(list(ids[a:b]) == e._ids(t or "") for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_the_library_has_them(name):
    from tokenizers import Tokenizer

    rng, path = random.Random(2), str(P.path(name))
    library = Tokenizer.from_file(path)
    alphabet = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "endoftext", "|>", " ", "\n", "a", "don't", "É", ".", "\t", "日本"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", " <|startoftext|> \n a"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    ids, bounds = PieceEncoder(path).encode(texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert list(ids[a:b]) == library.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([3, 40, 200, 900, 1500]))) for i in range(120)] + [(None, None), (7, ""), (7, "")]
    r = pack_documents(docs(spark, rows), str(P.path("byte_bpe_50k.json"))).collect()
    books = collections.defaultdict(list)
    for x in r:
        assert len(x.ids) == x.length and zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and (x.piece == 0 or x.length == 1024)
        books[x.sequence_id].append((x.offset, x.length))
    for b in books.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(books) <= -(-sum(x.length for x in r) // 1024) + 3
    assert pack_documents(docs(spark, []), str(P.path("byte_bpe_50k.json"))).count() == 0
    one = BestFit(10, 2)
    assert [one.place(n) for n in (6, 5, 4, 9, 5)] == [(0, 0), (1, 0), (0, 6), (2, 0), (1, 5)]


def test_packed_sequences_hold_their_ids(spark):
    rng, path = random.Random(14), str(P.path("byte_bpe_50k.json"))
    rows = [(i, prose(rng, rng.choice([2, 50, 300, 1800]))) for i in range(60)] + [(None, None), (3, "")]
    packed = packing.pack(packing.token_pieces(docs(spark, rows), path, 2), open_bins=7)
    sequences = {x.sequence_id: np.frombuffer(bytes(x.ids), "<u2") for x in packed.collect()}
    lib, texts = PieceEncoder(path), collections.defaultdict(list)
    for i, t in rows:
        texts[i].append([*lib._ids(t or ""), 2])
    seen = collections.defaultdict(list)
    for x in packing.unpack(packed).collect():
        part = sequences[x.sequence_id][x.offset : x.offset + x.length]
        assert list(part) == x.ids and zlib.crc32(part.astype("<u4").tobytes()) == x.ids_crc32
        assert any(t[x.start : x.start + x.length] == x.ids for t in texts[x.id])
        seen[x.id].append(x.length)
    assert {i: sum(n) for i, n in seen.items()} == {i: sum(map(len, t)) for i, t in texts.items()}
    assert sum(map(len, sequences.values())) == sum(map(sum, seen.values())) and max(map(len, sequences.values())) <= 1024
    bare = packing.unpack(packed, with_ids=False)
    assert "ids" not in bare.columns and bare.agg(F.sum("ids_crc32")).first() == packing.unpack(packed).agg(F.sum("ids_crc32")).first()


def test_huffman(spark):
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.zipf(1.3, 50_000), 4000), minlength=5000)
    lengths = code_lengths(counts)
    assert lengths.max() <= 16 and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1 + 1e-12
    ids = np.repeat(np.flatnonzero(counts), counts[counts > 0])
    rng.shuffle(ids)
    ends = np.array([0, 10, len(ids)])
    keys, e, back = decode_block(encode_block([None, 5, -3], ends, ids, lengths, canonical_codes(lengths)), decode_table(lengths))
    assert keys == [None, 5, -3] and (e == ends).all() and (back == ids).all()
    rows = [(i, prose(random.Random(i), i % 90)) for i in range(150)] + [(None, None), (7, "again"), (3, "")]
    path = str(P.path("word_bpe_49k.json"))
    got = read_ids(write_ids(docs(spark, rows), path)).orderBy("start").collect()
    lib, start = PieceEncoder(path), 0
    assert [x.doc_id for x in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append([*lib._ids(t or ""), 1])
    for x in got:
        assert x.start == start and list(x.ids) in texts[x.doc_id]
        start += x.n_tokens
    assert read_ids(write_ids(docs(spark, []), path)).count() == 0
    long = docs(spark, [(1, "a b"), (2, "word and more " * 20_000), (3, None), (None, "x")])
    store = write_ids(long, path)
    some = {r.doc_id: list(r.ids) for r in read_some(store, spark.createDataFrame([(2,), (3,), (None,), (77,)], "doc_id long")).collect()}
    assert set(some) == {2, 3} and some[2] == [*lib._ids("word and more " * 20_000), 1] and some[3] == [1]
    block = open_block(encode_block([4], np.array([len(ids)]), ids, lengths, canonical_codes(lengths)))
    for a, b in ((0, 0), (0, 1), (255, 257), (700, 1999), (len(ids) - 3, len(ids))):
        assert (decode_slice(block, decode_table(lengths), a, b) == ids[a:b]).all()


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def test_too_many_ids_for_the_code():
    assert code_lengths(np.ones(1 << 16, np.int64)).max() == 16
    with pytest.raises(ValueError, match="cannot have codes"):
        code_lengths(np.ones((1 << 16) + 1, np.int64))


def test_release(spark):
    from panelworks.llm.storage import kept_tables, materialise, release

    materialise(spark.range(3), "some")
    release(spark)
    assert not kept_tables(spark)


def test_jaccard(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 30, 150, 400, 700]))]
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w) + (" " + passage if g % 4 == 0 else "")))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \n", rows[0][1].upper(), rows[0][1], "a b"])] + [(None, rows[0][1]), (2, rows[2][1])]
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    link = {a: {b for b in ids if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])} for a in ids}
    for r in jaccard_components(docs(spark, rows)).collect():
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is None:
            assert r.component_id is None
            continue
        seen, todo = {r.doc_id}, [r.doc_id]
        while todo:
            for y in link[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert r.component_id == min(seen)
    assert jaccard_components(docs(spark, [])).count() == 0


def test_jaccard_links_inside_components(spark):
    rng, rows = random.Random(21), []
    for n in (40, 40, 300, 700):
        base = [f"w{rng.randrange(9000)}" for _ in range(n)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, rows[3][1]), (901, rows[3][1]), (None, rows[4][1]), (902, None)]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows if i is not None and t and i < 900 for w in [words_of(t)]}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    for exact in (False, True):
        links = ngram_jaccard.jaccard_links(docs(spark, rows), exact=exact)
        rep = {r.cls: r.rep for r in links.classes.collect()}
        got = [tuple(sorted((rep[r.a], rep[r.b]))) for r in links.pairs.collect()]
        assert len(want) > 70 and len(got) == len(set(got)) and set(got) == want
        assert {(r.id, rep[r.cls]) for r in links.rows.where("cls is not null").collect()} == {(i, 3 if i in (900, 901) else i) for i, t in rows if i is not None and t}


def test_jaccard_ids_with_several_texts(spark):
    rng, rows = random.Random(31), []
    near = lambda t, k: " ".join(t.split()[:-1] + [f"u{k}"])
    first, second, third = (" ".join(f"{p}{rng.randrange(10**6)}" for _ in range(60)) for p in "abc")
    rows = [(5, first), (5, second), (5, second), (7, third), (7, first + " more")] + [(100 + k, near(first, k)) for k in range(10)] + [(200 + k, near(second, k)) for k in range(40)] + [(300, third), (301, "x " * 30_000)]
    got = collections.defaultdict(set)
    for r in jaccard_components(docs(spark, rows)).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert {c for i in got if i != 301 for _, c in got[i]} == {5} and got[301] == {(1, 301)}
    assert got[7] == {(56, 5), (57, 5)} and len(got) == 54


@pytest.mark.parametrize("classes", [128, 7])
def test_jaccard_counts_all_links(spark, monkeypatch, classes):
    """Every link is counted, whether a component is one block or many."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK_CLASSES", classes)
    rng, rows = random.Random(41), []
    base = [f"w{rng.randrange(9000)}" for _ in range(200)]
    for k in range(60):
        rows.append((k, " ".join([*base[:-1], f"u{k}"])))
    for n in (20, 90, 400):
        text = [f"t{rng.randrange(9000)}" for _ in range(n)]
        for _ in range(25):
            w = list(text)
            for _ in range(rng.randrange(n // 15 + 1)):
                w[rng.randrange(n)] = f"v{rng.randrange(10**6)}"
            rows.append((100 + len(rows), " ".join(w)))
    rows += [(900, rows[3][1]), (901, rows[3][1]), (None, rows[4][1]), (902, None), (903, "alone here"), (904, "alone here"), (905, "alone there")]
    sets = [(i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()) for i, t in rows for w in [words_of(t)]]
    want = {i: sum(1 for j, b in sets if j is not None and j != i and a and b and 100 * len(a & b) >= 75 * len(a | b)) for i, a in sets if i is not None}
    got = {r.doc_id: r for r in ngram_jaccard.jaccard_join(docs(spark, rows)).collect()}
    assert {i: r.n_links for i, r in got.items() if i is not None} == want and got[None].n_links == 0
    assert sum(want[i] for i in range(60)) == 2 * 1770 + 60 * 2
    assert ngram_jaccard.jaccard_join(docs(spark, [])).count() == 0


def test_overlaps_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram_jaccard, "COLUMNS", 5)
    rng = random.Random(2)
    lists = [rng.sample(range(-40, 40), rng.randrange(0, 30)) for _ in range(20)]
    left, right = np.arange(0, 12), np.arange(12, 20)
    got = ngram_jaccard.overlaps(pa.array(lists, pa.list_(pa.int64())), left, right)
    assert got.tolist() == [[len(set(lists[i]) & set(lists[j])) for j in right] for i in left]
    assert ngram_jaccard.overlaps(pa.array([[], []], pa.list_(pa.int64())), left[:1], left[1:2]).tolist() == [[0]]


def brute_katz(texts, train, order):
    """(log10 score of each text, P(word | context)) by counting in dictionaries."""
    c = [collections.Counter() for _ in range(order)]
    start = sum(train)
    for t, on in zip(texts, train, strict=True):
        w = ["\0", *words_of(t), "\1"]
        for i in range(1, len(w)):
            for k in range(order):
                if on and i - k >= 0:
                    c[k][tuple(w[i - k : i + 1])] += 1
    n, v = sum(c[0].values()), len(c[0])
    d = [katz_lm.Discounts.of([sum(x == r for x in k.values()) for r in range(1, katz_lm.K + 2)]) for k in c]
    count = lambda x: start if x == ("\0",) else c[len(x) - 1][x]
    after = collections.defaultdict(list)
    for k in c[1:]:
        for g in k:
            after[g[:-1]].append(g[-1])
    weights = {}

    def alpha(x):
        if x not in weights:
            seen = sum(d[len(x)](np.array([count((*x, b))]))[0] * count((*x, b)) for b in after[x]) / count(x)
            weights[x] = (1 - seen) / (1 - sum(p(b, x[1:]) for b in after[x]))
        return weights[x]

    def p(b, x):
        if not x:
            return (c[0][b,] + 1) / (n + v + 1)
        r = count((*x, b))
        if r:
            return d[len(x)](np.array([r]))[0] * r / count(x)
        return alpha(x) * p(b, x[1:]) if count(x) else p(b, x[1:])

    scores = []
    for t in texts:
        w = ["\0", *words_of(t), "\1"]
        scores.append(sum(np.log10(p(w[i], tuple(w[max(0, i - order + 1) : i]))) for i in range(1, len(w))))
    return scores, p, c, after, weights


@pytest.mark.parametrize("order", [1, 3])
def test_katz(spark, order):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(60))) for i in range(150)] + [(500, None), (501, "Only Once"), (None, "the tree"), (502, "word " * 3000), (9, prose(rng, 30))]
    got = katz_lm.katz_scores(docs(spark, rows), order=order, chunk_text=3000, bucket_entries=200)
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    scores, p, c, after, weights = brute_katz([t for _, t in rows], train, order)
    n, v, want = sum(c[0].values()), len(c[0]), collections.defaultdict(list)
    for (i, t), on, s in zip(rows, train, scores, strict=True):
        w = [*words_of(t), "\1"]
        want[i].append((on, len(w), sum(c[0][b,] > 0 for b in w), sum(np.log10((c[0][b,] + 1) / (n + v + 1)) for b in w), s))
    for x in got.scores.collect():
        match = [y for y in want[x.doc_id] if abs(y[4] - x.score) < 1e-8]
        assert match and (not x.held_out, x.n_tokens, x.n_known) == match[0][:3] and abs(x.base_score - match[0][3]) < 1e-8 and x.train_tokens == n
    words = [g[0] for g in c[0]]
    for x in [*sorted(after, key=lambda x: -len(after[x]))[:3], *rng.sample(sorted(after), min(5, len(after)))]:
        assert abs(sum(p(b, x) for b in words) + p("never seen", x) - 1) < 1e-9
    stored = {k: [0, 0] for k in range(order)}
    for r in got.counts.collect():
        counts = katz_lm.expand(bytes(r["counts"]), "u8")
        stored[r.level][0] += len(counts)
        stored[r.level][1] += int(counts.sum())
    assert all(stored[k] == [len(c[k]), sum(c[k].values())] for k in range(1, order)) and stored[0] == [v + 1, n + sum(train)]
    logs = np.concatenate([katz_lm.expand_values(bytes(r.alpha), "f8") for r in got.weights.collect()] or [np.zeros(0)])
    for x in list(weights):
        assert np.abs(logs - np.log10(weights[x])).min() < 1e-9
    assert katz_lm.katz_scores(docs(spark, []), order=order).scores.count() == 0


@pytest.mark.parametrize("order", [1, 3])
def test_a_stored_katz_model_scores_texts(spark, tmp_path, order):
    from panelworks.llm.katz_model import load_model, save_model, score_texts

    rng = random.Random(17)
    rows = [(i, prose(rng, rng.randrange(0, 60))) for i in range(120)] + [(500, None), (501, ""), (None, prose(rng, 9)), (502, "one two " * 4000), (3, prose(rng, 20))]
    model = katz_lm.katz_scores(docs(spark, rows), order=order, chunk_text=3000, bucket_entries=400)
    was = sorted(model.scores.collect(), key=str)
    save_model(model, str(tmp_path / "lm"))
    model = load_model(spark, str(tmp_path / "lm"))
    near = lambda a, b: str(a[:5]) == str(b[:5]) and abs(a.base_score - b.base_score) < 1e-9 and abs(a.score - b.score) < 1e-9
    got = sorted(score_texts(model, docs(spark, rows), chunk_text=7000).collect(), key=str)
    assert len(got) == len(was)
    by = lambda x: (str(x.doc_id), x.n_tokens, round(x.score, 6))
    assert all(near(a, b) for a, b in zip(sorted(got, key=by), sorted(was, key=by), strict=True))
    new = {r.doc_id: r for r in score_texts(model, docs(spark, [(1, "quite unheard-of words"), (2, rows[5][1]), (2, rows[5][1])])).collect()}
    assert new[1].n_known == 1 and new[1].score < 0 and abs(new[2].score - next(r.score for r in was if r.doc_id == 5)) < 1e-9
    assert score_texts(model, docs(spark, [])).count() == 0
    with pytest.raises(Exception, match="exists"):
        save_model(model, str(tmp_path / "lm"))


def test_katz_discounts_and_hashed_keys(spark, monkeypatch):
    for freq in ([0] * 6, [5, 0, 0, 0, 0, 0], [100, 40, 20, 12, 8, 6], [1, 50, 3, 70, 1, 9]):
        d = katz_lm.Discounts.of(freq)(np.arange(1, 10_000))
        assert (d > 0).all() and (d < 1).all()
    assert abs(katz_lm.Discounts.of([100, 40, 20, 12, 8, 6]).low[1] - 0.8) < 1e-12
    for bits in (1, 2, 7, 12):
        assert sorted(katz_lm.spread(np.arange(1 << bits, dtype=np.uint64), bits)) == list(range(1 << bits))
    rng = random.Random(7)
    d = docs(spark, [(i, prose(rng, 30)) for i in range(60)])
    exact = {r.doc_id: r.score for r in katz_lm.katz_scores(d).scores.collect()}
    monkeypatch.setattr(katz_lm, "min", lambda a, b: 64, raising=False)
    hashed = {r.doc_id: r.score for r in katz_lm.katz_scores(d).scores.collect()}
    assert all(abs(exact[k] - hashed[k]) < 1e-8 for k in exact)


def labelled(spark):
    rng = random.Random(8)
    good = [(i, prose(rng, 100)) for i in range(80)]
    bad = [(100 + i, "%%% ".join(f"zz{rng.randrange(999)}" for _ in range(80))) for i in range(40)]
    toxic = [(200 + i, prose(rng, 90) + " idiot scum") for i in range(30)]
    d = docs(spark, good + bad + toxic + [(None, None), (300, "")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[::2]] + [(i, 0, 0) for i, _ in bad[::2]] + [(i, 1, 1) for i, _ in toxic[::2]] + [(None, 1, 0), (9999, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    return d, labels


def test_classifier(spark):
    d, labels = labelled(spark)
    r = {x.doc_id: x.kept for x in quality_classifier(d, labels).collect()}
    assert all(r[i] for i in range(80)) and not any(r[100 + i] for i in range(40)) and len(r) == 152
    assert quality_classifier(d, labels.limit(0)).where("not kept").count() == 0
    assert quality_classifier(d.limit(0), labels).count() == 0


def test_classifier_posteriors_by_brute_force(spark):
    d, labels = labelled(spark)
    rng = random.Random(3)
    host = {r.doc_id: "bad" if 100 <= (r.doc_id or 0) < 140 and r.doc_id != 139 else "few" if r.doc_id in (139, 1) else f"h{rng.randrange(4)}" for r in d.select("doc_id").collect()}
    name = F.create_map(*[F.lit(x) for k, v in host.items() if k is not None for x in (k, v)])
    d = d.withColumn("source", F.coalesce(name[F.col("doc_id")], F.lit(""))).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en"))
    got = {r.doc_id: r for r in quality_classifier(d, labels).collect()}
    where = {r.doc_id: (r.source, r.lang) for r in d.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in got and r.quality is not None and r.doc_id is not None}
    e = {i: y.get(i, r.p_document) for i, r in got.items()}
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for i, (h, p) in where.items():
        paths[h, p].append(e[i])
        hosts[h].append(e[i])
    n, all_e = len(e), list(e.values())
    mean = np.mean(all_e)
    within = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in paths.values()) / (n - len(paths))
    c = n - sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())
    between = max(0, (sum(len(v) * (np.mean(v) - np.mean(hosts[h])) ** 2 for (h, _), v in paths.items()) - (len(paths) - len(hosts)) * within) / c)
    rest = sum(len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items()) - sum(len(v) ** 2 for v in paths.values()) / n
    spread = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values()) - (len(hosts) - 1) * within - between * rest
    over = max(0, spread / (n - sum(len(v) ** 2 for v in hosts.values()) / n))
    a, b = (within + between) / max(over, 1e-12), max(within, 1e-12) / max(between, 1e-12)
    assert over > 0.01
    logit = lambda p: np.log(p / (1 - p))
    for i, r in got.items():
        h, p = where[i]
        host_prior = (sum(hosts[h]) - e[i] + a * mean) / (len(hosts[h]) - 1 + a)
        path_prior = (sum(paths[h, p]) - e[i] + b * host_prior) / (len(paths[h, p]) - 1 + b)
        assert abs(r.host_prior - host_prior) < 1e-6 and abs(r.path_prior - path_prior) < 1e-6
        want = 1 / (1 + np.exp(logit(mean) - logit(r.p_document) - logit(np.clip(path_prior, 1e-6, 1 - 1e-6))))
        assert abs(r.p_quality - want) < 1e-6
    bad = np.mean([got[i].host_prior for i in range(100, 139)])
    assert bad < 0.2 and abs(got[139].host_prior - mean) < abs(bad - mean) and min(got[i].host_prior for i in range(2, 80)) > 0.7
    assert quality_classifier(d, labels, host_weight=1e9, path_weight=1e9).agg(F.max("host_prior") - F.min("host_prior")).first()[0] < 1e-4


def test_classifier_on_sparse_sites(spark):
    d, labels = labelled(spark)
    one = quality_classifier(d.limit(1), labels.limit(0)).collect()
    assert len(one) == 1 and one[0].kept and one[0].host_prior == one[0].path_prior
    alone = d.withColumn("source", F.concat(F.lit("host"), "doc_id"))
    rows = quality_classifier(alone, labels).collect()
    assert len(rows) == d.count() and len({r.host_prior for r in rows}) == 1 and all(r.path_prior == r.host_prior and 0 < r.p_quality < 1 for r in rows)
    paths = quality_classifier(d.withColumn("source", F.lit("h")).withColumn("lang", F.concat(F.lit("p"), "doc_id")), labels).collect()
    assert len(paths) == d.count() and all(r.path_prior == r.host_prior for r in paths)
    for given, known in ((d.withColumn("source", F.lit("h")).withColumn("lang", F.lit("p")), labels), (alone, labels.limit(0)), (d.limit(0), labels)):
        rows = quality_classifier(given, known).collect()
        assert len(rows) == given.count() and all(0 <= r.p_quality <= 1 for r in rows)
    same = quality_classifier(d.withColumn("text", F.lit("one text")).withColumn("source", F.concat(F.lit("host"), "doc_id")), labels.limit(0))
    assert {r.kept for r in same.collect()} == {True}
    for a, b in ((0.0, 0.0), (5.0, 0.0), (0.0, 5.0)):
        assert quality_classifier(alone, labels, host_weight=a, path_weight=b).where("path_prior is null or p_quality is null").count() == 0


def test_classifier_reads_words(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 120) + (" dull hollow vapid" if i % 2 else "")) for i in range(300)] + [(1000, "long word " * 40_000)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 200)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_classifier(docs(spark, rows), labels).collect()}
    assert sum(got[i] == (i % 2 == 0) for i in range(200, 300)) >= 97


def test_classifier_fits_on_all_labels(spark):
    from panelworks.llm.quality_classifier import FEATURES, best_threshold, fit_logistic, word_weights

    rng = np.random.default_rng(4)
    n = 30_000  # more than the sample of 20,000 that it was once fitted on
    x = rng.normal(size=(n, len(FEATURES)))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 3] + 0.3)))).astype(float)
    d = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y, strict=True)], "y double, x array<double>").repartition(7)
    z, w = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(n)]), np.zeros(len(FEATURES) + 1)
    pull = np.append(np.full(len(FEATURES), 1e-3 * n), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(pull), z.T @ (y - p) - pull * w)
    assert np.allclose(fit_logistic(d)[:-1], w[:-1] / x.std(0), atol=1e-6)
    p = np.round(1 / (1 + np.exp(-x[:, 0])), 3)
    cuts = np.unique(p)
    right = [(p[y == 0] < c).mean() + (p[y == 1] >= c).mean() for c in cuts]
    k = int(np.argmax(np.round(right, 12)))
    judged = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y, strict=True)], "p double, y double")
    assert abs(best_threshold(judged) - (cuts[k - 1] + cuts[k]) / 2) < 1e-9
    assert best_threshold(judged.where("y = 1")) == best_threshold(judged.limit(0)) == 0.5
    texts = spark.createDataFrame([(i, "same rare" if i == n - 1 else "same") for i in range(n)], "id long, text string")
    known = texts.select("id", (F.col("id") % 2).cast("double").alias("y"), F.lit(0).alias("fold"))
    weights = word_weights(texts, known)
    assert np.count_nonzero(np.abs(weights[2] - np.median(weights[2])) > 0.5) == 1 and not np.any(weights[0])


def test_mixing_by_brute_force(spark):
    d, labels = labelled(spark)
    d = d.unionByName(docs(spark, [(900, "many words " * 30_000)]))
    want = {"clean": 0.6, "toxic": 0.2, "low": 0.2}
    mix, rated = fit_mixture(d, labels, want)
    text = {r.doc_id: r.text or "" for r in d.collect()}
    for r in rated.collect():
        t = text[r.doc_id]
        size = len(t) + 1
        known = [len(re.findall(rf"(?i)\b(?:{'|'.join(w)})\b", t)) if w else 0 for w in mix.markers.values()]
        x = np.array([np.log(size), len(re.findall("[A-Z]", t)) / size, len(re.findall(r"[#*$%&|<>!]", t)) / size, *np.log1p(known)])
        logs = np.array([np.log(p) - 0.5 * np.log(v).sum() - ((x - np.array(m)) ** 2 / (2 * np.array(v))).sum() for p, m, v in zip(mix.prior, mix.mean, mix.var)])
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        rate = 1.0
        for step in mix.steps:
            rate = max(0.0, rate - float(np.dot(p, step)))
        assert np.abs([r[f"__mix_{k}"] - p[k] for k in range(len(p))]).max() < 1e-6 and abs(r["__mix_rate"] - rate) < 1e-6 and r["__mix_tokens"] == len(words_of(t))
    assert max(map(abs, mix.residual)) < 1e-6
    short, _ = fit_mixture(d, labels, want, rounds=0)
    assert not short.residual and not short.steps


def test_mixing(spark):
    d, labels = labelled(spark)
    want = {"clean": 0.7, "toxic": 0.1, "low": 0.2}
    rows = mixing_rates(d, labels, want).collect()
    total = sum(x.n_tokens for x in rows)
    assert all(x.rate >= 0 for x in rows)
    for k, share in want.items():
        assert abs(sum(x.n_tokens * x.rate * x[f"p_{k}"] for x in rows) / total - share) < 1e-4
    mix, _ = fit_mixture(d, labels, want)
    assert mixed(d, mix).columns == d.columns
    assert mixing_rates(d.limit(0), labels, want).count() == 0 and mixing_rates(d, labels.limit(0), want).count() == 152
