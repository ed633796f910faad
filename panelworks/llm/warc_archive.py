"""Content-addressed web archive: payloads once by digest, exact headers apart."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise, shuffles_deleted, new_folder

MIN_DEDUP_BYTES = 1000
CRLF = "\r\n"


class Archive(NamedTuple):
    """payloads: (sha256, payload), each payload once. records: (page_id, copy, sha256,
    header), the exact bytes that stand before the payload."""

    payloads: DataFrame
    records: DataFrame


def _bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = MIN_DEDUP_BYTES, date: str = "2020-01-01T00:00:00Z") -> Archive:
    """Writes a record for each page and returns the archive's two tables.

    Of records with equal payloads of at least `min_bytes`, the one with the largest id
    is the response and the others revisit it; smaller ones are all responses. A null
    body is empty, a null url an empty one. Rows equal in id, url and payload are copies
    0, 1, ...: of the largest, copy 0 is the response. Null ids come last. Other columns are not read.

    Equal payloads are found by SHA-256 with partial aggregation, so a payload that a
    third of the pages share is one row for each map task; payload bytes are shuffled
    once for each digest and task.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), _bytes(F.coalesce(F.col(body_col), F.lit(""))).alias("payload"))
    heads = p.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n"))
    heads = heads.groupBy("page_id", "url", "sha256", "sha1", "n").agg(F.count("*").alias("copies"))
    best = heads.groupBy("sha256").agg(F.max(F.coalesce("page_id", F.lit(-(1 << 62)))).alias("best"))
    urls = heads.groupBy("sha256", F.coalesce("page_id", F.lit(-(1 << 62))).alias("best")).agg(F.max("url").alias("best_url"))
    chosen = materialise(best.join(urls, ["sha256", "best"]), "warc-chosen")
    rows = heads.join(chosen, "sha256").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    first = (F.coalesce("page_id", F.lit(-(1 << 62))) == F.col("best")) & (F.col("url") == F.col("best_url")) & (F.col("copy") == 0)
    rows = rows.withColumn("revisit", (F.col("n") >= min_bytes) & ~first)
    uuid = lambda page, url, digest, copy: F.md5(F.concat_ws("|", page.cast("string"), url, digest, copy.cast("string")))
    spell = lambda h: F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    urn = lambda *x: F.concat(F.lit("<urn:uuid:"), spell(uuid(*x)), F.lit(">"))
    known = F.when(F.col("best") > -(1 << 62), F.col("best"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("n"), F.lit(CRLF * 2))
    clean_url = F.regexp_replace("url", r"[\r\n]", "")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        urn(F.col("page_id"), F.col("url"), F.col("sha256"), F.col("copy")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        clean_url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(F.col("revisit"), F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), urn(F.col("best"), F.col("best_url"), F.col("sha256"), F.lit(0)), F.lit(f"{CRLF}X-Refers-To-Page: "), F.coalesce(known.cast("string"), F.lit("")))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n")),
        F.lit(CRLF * 2),
        http,
    )
    records = rows.select("page_id", "copy", "sha256", _bytes(header).alias("header"))
    store = p.groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.first("payload").alias("payload"))
    paths = new_folder(spark, "warc-payloads"), new_folder(spark, "warc-records")
    with shuffles_deleted(spark):
        store.write.parquet(paths[0])
        records.write.parquet(paths[1])
    discard(chosen)
    return Archive(spark.read.schema("sha256 string, payload binary").parquet(paths[0]), spark.read.schema(records.schema).parquet(paths[1]))


def read_archive(archive: Archive, with_payload: bool = True) -> DataFrame:
    """The records rebuilt by a join on the digest: (page_id, copy, record_type,
    payload_bytes, payload_digest, refers_to, header[, payload, record]). `record` is the
    exact WARC record, in which a revisit has no payload; `payload` is always the full one. Line ends
    inside a url are not kept, as a header has no place for them. Raises if a payload does not have
    the digest under which it is stored, or not the one in its header. Payloads are checked and
    measured where they lie, and only join if they are asked for."""
    whole = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged")).cast("binary"))
    checked = archive.payloads.select("sha256", whole.alias("payload")).select("sha256", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("payload_bytes"), *["payload"] * with_payload)
    head = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(head, f"\r\n{name}: ([^\r\n]*)", 1)
    r = archive.records.join(checked, "sha256")
    digest = F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")), F.col("sha1")).otherwise(F.raise_error(F.lit("a payload does not match its record")).cast("string"))
    kind = field("WARC-Type")
    refers = field("X-Refers-To-Page")
    out = r.select(
        "page_id",
        "copy",
        kind.alias("record_type"),
        "payload_bytes",
        digest.alias("payload_digest"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        "header",
        *["payload"] * with_payload,
    )
    if with_payload:
        body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
        out = out.withColumn("record", F.concat("header", body, F.lit((CRLF * 2).encode())))
    return out
