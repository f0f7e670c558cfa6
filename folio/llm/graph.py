"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` can reach.

    ``edges`` has columns ``u`` and ``v`` of one ordered type (any direction, repeats and loops allowed, nulls ignored); the
    result has ``node`` and ``component``, one row for each node that has a neighbour. Every step groups by node
    with partial minima and joins those minima back, so a hub costs rows in proportion to its edges only and an
    adaptive join can split it. Each round's edges are written to the shared folder, and removed with the next.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    held = materialize(edges.where("u is not null and v is not null and u <> v").select(u, v).distinct(), "edges")
    before = _mark(held)
    while before[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        made = materialize(small.where("u <> v").select(u, v).distinct(), "edges")
        now = _mark(made)
        release(held)
        held = made
        if now == before:
            break
        before = now
    out = materialize(held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    release(held)
    return out
