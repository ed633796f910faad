"""Quality rules: a threshold table compiled into one projection, built-in functions only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"

#: Frequent words of four languages.
STOP_WORDS = tuple(
    """
    the of and to in is that for it as was with be by on not he his but at are this have or from
    le la les des de et du un une que qui est dans en pour pas au par sur plus il elle
    der die das und ein eine zu den mit von ist nicht auf für dem im sich auch es
    el los las y una por con para del se su al lo como más o
    """.split()
)


class Rule(NamedTuple):
    """A document passes if `low <= measure <= high`; None is no bound. A null measure passes."""

    measure: str
    low: float | None
    high: float | None


#: Bounds that clean prose keeps with a wide margin.
RULES = (
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_ratio", 0.04, None),
    Rule("upper_word_ratio", None, 0.5),
    Rule("letter_word_ratio", 0.6, None),
    Rule("dup_line_ratio", None, 0.6),
)


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression over the measures."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & F.coalesce(F.col(r.measure) >= r.low, F.lit(True))
        if r.high is not None:
            out = out & F.coalesce(F.col(r.measure) <= r.high, F.lit(True))
    return out


def _count(array: str, test) -> Column:
    return F.size(F.filter(array, test)).cast("double")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """Measures and verdict of each row, one row out for each row in.

    Words are runs without space and the controls 0x09-0x0D. Returns `id_col`,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), the ratios,
    base_failed and kept. A null text has no words, so it fails the base rule, as
    does an empty one. Repeated rows are judged one by one; other columns of the
    input are not looked at, so clashing names do no harm; those named in `carry` come
    back as the fields of a column `held`, which spares a join.

    Words in repeated windows: windows are hashed to 64 bits, sorted with their
    places, and equal neighbours mark three places each, so the cost is n log n for
    a text of any length.
    """
    held = F.struct(*(F.col(c) for c in carry)) if carry else F.lit(True)
    d = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    d = d.select(
        "id",
        "held",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("h"),
    )
    d = d.withColumn("h", F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))))
    has = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(has, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, x: F.coalesce(F.get("s", i)["h"] == x["h"], F.lit(False))
    repeats = F.filter("s", lambda x, i: same(i - 1, x) | same(i + 1, x))
    places = F.array_distinct(F.flatten(F.transform(repeats, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    n = F.nullif(F.col("n_words").cast("double"), F.lit(0.0))
    d = d.select(
        "id",
        "held",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), F.lit(0)).otherwise(F.size(places)).cast("long").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (_count("w", lambda x: F.lower(x).isin(*STOP_WORDS)) / n).alias("stop_word_ratio"),
        (_count("w", lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x))) / n).alias("upper_word_ratio"),
        (_count("w", lambda x: F.upper(x) != F.lower(x)) / n).alias("letter_word_ratio"),
        ((F.size("lines") - F.size(F.array_distinct("lines"))) / F.nullif(F.size("lines").cast("double"), F.lit(0.0))).alias("dup_line_ratio"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    # The row number keeps a filter on `kept` above this projection; pushed down, it would
    # repeat all measures inside itself.
    kept = F.when(F.monotonically_increasing_id() >= 0, ~F.col("base_failed") & verdict(rules))
    d = d.withColumn("kept", kept).withColumnRenamed("id", id_col)
    return d if carry else d.drop("held")
