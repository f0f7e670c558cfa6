"""Chains, aliases, ranges and names of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import removed, written


def with_ends(ranges: DataFrame, start: str) -> DataFrame:
    """Add ``range_end``, the start of the next range (null for the last); ranges are few."""
    return ranges.withColumn("range_end", F.lead(start).over(Window.orderBy(start)))


def in_range(df: DataFrame, at: str, ranges: DataFrame, start: str, most_ranges: int = 10_000) -> DataFrame:
    """Rows with the range that holds ``at``. Up to ``most_ranges`` ranges are broadcast; their number is checked."""
    if ranges.limit(most_ranges + 1).count() > most_ranges:
        raise ValueError(f"more than {most_ranges} ranges; use as_of")
    inside = (F.col(at) >= F.col(start)) & (F.col("range_end").isNull() | (F.col(at) < F.col("range_end")))
    return df.join(F.broadcast(ranges), inside)


def as_of_ranges(df: DataFrame, at: str, ranges: DataFrame, start: str) -> DataFrame:
    """Rows of ``df`` with the columns of the latest range whose ``start`` isn't after ``at``; nulls if there is none.

    For any number of ranges, without a key. Both sides are dealt together into ranges of the position, each of which
    carries its last range forward; what the earlier ones end with, a row for each of them, is carried over their borders.
    Rows at one position are spread as well. Of ranges with equal starts that with the largest other columns counts. A
    null position has no range. The columns of both sides must have different names.
    """
    carried = F.struct(*[F.col(c) for c in ranges.columns if c != start], F.col(start)).alias("_range")
    once = ranges.where(F.col(start).isNotNull()).groupBy(F.col(start).alias("_at")).agg(F.max(carried).alias("_range"))
    left = df.select(F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*df.columns).alias("_row")).withColumn("_spread", F.monotonically_increasing_id())
    both = left.unionByName(once.withColumn("_side", F.lit(0)).withColumn("_spread", F.lit(0).cast("long")), allowMissingColumns=True)
    dealt = written(both.repartitionByRange("_at", "_side", "_spread").withColumn("_part", F.spark_partition_id()), "as-of")
    ends = dealt.groupBy("_part").agg(F.max_by("_range", F.when(F.col("_side") == 0, F.col("_at"))).alias("_end"))
    ends = ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.last("_range", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("_own", own).where("_side = 1").join(ends, "_part")
    got = F.when(F.col("_at").isNotNull(), F.coalesce("_own", "_before"))
    return found.select("_row.*", got.alias("_got")).select(*df.columns, *[F.col(f"_got.{c}").alias(c) for c in ranges.columns])


def resolve_chain(df: DataFrame, column: str, chain: DataFrame, most: int) -> DataFrame:
    """Follow (custom, standard) links from ``column``, ``most`` times at most; a value without a link stays.

    The chain is resolved on its own first, so rows meet one flat table.
    """
    flat = chain
    for _ in range(max(1, (most - 1).bit_length())):
        nxt = flat.select(F.col("custom").alias("_next"), F.col("standard").alias("_standard"))
        flat = flat.join(nxt, F.col("standard") == F.col("_next"), "left").select("custom", F.coalesce("_standard", "standard").alias("standard"))
    return df.join(flat, F.col(column) == F.col("custom"), "left").withColumn(column, F.coalesce("standard", column)).drop("custom", "standard")


def flatten_aliases(links: DataFrame, most_rounds: int = 32) -> DataFrame:
    """id and canonical of (id, next) chains by doubling: each round halves what is left of the longest chain.

    A chain ends where next is the id itself; ``most_rounds`` rounds cover chains of 2 to the power of that many.
    Each round is written, and removed with the next; the loop ends when one changes nothing, and raises if none does.
    """
    now = links.select("id", "next")
    for _ in range(most_rounds):
        ahead = now.select(F.col("id").alias("_id"), F.col("next").alias("_next"))
        moved = written(now.join(ahead, F.col("next") == F.col("_id"), "left").select("id", F.coalesce("_next", "next").alias("next"), (F.coalesce("_next", "next") != F.col("next")).alias("_moved")), "aliases")
        removed(now)
        now = moved
        if not moved.where("_moved").limit(1).count():
            return now.select("id", F.col("next").alias("canonical"))
    raise ValueError(f"chains go on after {most_rounds} rounds: they form a cycle or are longer than 2^{most_rounds}")


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Nodes that edges (src, dst) lead to from ``roots`` (node), with their least depth.

    Breadth first: each round joins only the nodes found last with their edges, and one table of all nodes found so far,
    which replaces the one before. Cycles end, as nodes found before are left out. Raises if ``most_rounds`` don't do.
    """
    found = written(roots.select("node", F.lit(0).alias("depth")).distinct(), "reached")
    for depth in range(1, most_rounds + 1):
        fresh = found.where(F.col("depth") == depth - 1).join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(depth).alias("depth"))
        merged = written(found.unionByName(fresh).groupBy("node").agg(F.min("depth").alias("depth")), "reached")
        removed(found)
        found = merged
        if not found.where(F.col("depth") == depth).limit(1).count():
            return found
    raise ValueError(f"nodes are still found after {most_rounds} rounds")


def rename_prefix(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Names that start with ``old`` start with ``new`` instead, unless the new name is taken."""
    renamed = F.when(F.col(column).startswith(old), F.concat(F.lit(new), F.substring(column, len(old) + 1, 2**31 - 1)))
    taken = df.select(F.col(column).alias("_taken")).distinct()
    rows = df.withColumn("_new", renamed).join(taken, F.col("_new") == F.col("_taken"), "left")
    return rows.withColumn(column, F.when(F.col("_new").isNotNull() & F.col("_taken").isNull(), F.col("_new")).otherwise(F.col(column))).drop("_new", "_taken")


def edited(base: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, value) after ``changes``: a value sets or replaces its key's, a null value removes the key."""
    new = changes.select(key, F.struct(value).alias("_new"))
    both = base.select(key, value).join(new, key, "full")
    return both.select(key, F.when(F.col("_new").isNotNull(), F.col(f"_new.{value}")).otherwise(F.col(value)).alias(value)).where(F.col(value).isNotNull())


def submitted(fields: DataFrame, name: str, listed: list[str], exclude: bool = False) -> DataFrame:
    """Fields that are listed or lie under a listed one, or with ``exclude`` all others; without a list every field."""
    if not listed:
        return fields
    chosen = F.lit(False)
    for x in listed:
        chosen = chosen | (F.col(name) == x) | F.col(name).startswith(x + ".")
    return fields.where(~chosen if exclude else chosen)
