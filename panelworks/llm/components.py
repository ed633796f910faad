"""Connected components by randomised contraction, all as joins and aggregates."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node long, component long): each node on an edge with the smallest node it reaches.

    In each round a node moves to the neighbour, or stays itself, whose id is
    smallest under a random exclusive-or mask; edges follow their ends, and loops
    and repeats go. Each mask serves two rounds, in which a star shrinks to a point. The number of nodes falls by a constant share a round. Hot
    nodes only occur on the side of a join that Spark can split, as the other side
    has one row a node, and minima are combined before the shuffle.
    Null ends and loops are ignored; no edges give no rows.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = materialise(e, "edges")
    rng, moves = random.Random(17), []
    while not e.isEmpty():
        if len(moves) % 2 == 0:
            mask = F.lit(rng.getrandbits(62))
        both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("b", "a"))
        to = both.groupBy("node").agg(F.min(F.col("other").bitwiseXOR(mask)).alias("m"))
        to = to.select("node", F.least(F.col("m"), F.col("node").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to"))
        to = materialise(to, "moves")
        moves.append(to)
        left = e.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        left = left.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        before, e = e, materialise(left, "edges")
        discard(before)
    if not moves:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(e)
    root = moves.pop()
    while moves:
        to, later = moves.pop(), root.select(F.col("node").alias("to"), F.col("to").alias("root"))
        before, root = root, materialise(to.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("to")), "roots")
        discard(before, to)
    least = materialise(root.groupBy("to").agg(F.min("node").alias("component")), "least")
    out = materialise(root.join(least, "to").select("node", "component"), "components")
    discard(root, least)
    return out
