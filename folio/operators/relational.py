"""Joins, windows and assemblies of pages and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def as_of(df: DataFrame, at: str, ranges: DataFrame, start: str, by: str) -> DataFrame:
    """Rows of ``df`` with the columns of the latest range whose ``start`` isn't after ``at``; nulls if there is none.

    Both sides are sorted together once, for each ``by`` (a column of both), and the last range is carried forward.
    """
    keys = [by]
    carried = [c for c in ranges.columns if c not in keys]
    left = df.select(*[F.col(c) for c in df.columns], F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(ranges.select(F.struct(*carried)).schema[0].dataType).alias("_range"))
    right = ranges.select(*[F.col(k) for k in keys], F.col(start).alias("_at"), F.lit(0).alias("_side"), F.struct(*carried).alias("_range"))
    window = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_range", F.last("_range", ignorenulls=True).over(window))
    return both.where("_side = 1").select(*df.columns, *[F.col(f"_range.{c}").alias(c) for c in carried if c not in df.columns])


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with their key or are added."""
    names = [c for c in base.columns if c != key]
    joined = base.alias("b").join(changes.alias("c"), F.col(f"b.{key}") == F.col(f"c.{key}"), "full")
    hit = F.col(f"c.{key}").isNotNull()
    return joined.select(F.coalesce(f"c.{key}", f"b.{key}").alias(key), *[F.when(hit, F.col(f"c.{n}")).otherwise(F.col(f"b.{n}")).alias(n) for n in names])


def revision_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key`` and change (added, changed, removed) of the rows that differ."""
    names = [c for c in old.columns if c != key]
    side = lambda df, s: df.select(F.col(key).alias(f"{s}_key"), F.struct(*names).alias(f"{s}_value"))
    both = side(old, "old").join(side(new, "new"), F.col("old_key") == F.col("new_key"), "full")
    change = F.when(F.col("old_key").isNull(), "added").when(F.col("new_key").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return both.select(F.coalesce("old_key", "new_key").alias(key), change.alias("change")).where("change is not null")


def split_parts(starts: DataFrame, position: str, total: int | Column) -> DataFrame:
    """Parts between consecutive starts: first_page and page_count; pages before the first start form a part of their own."""
    total = F.lit(total) if isinstance(total, int) else total
    own = starts.select(F.col(position).alias("first_page"), F.lit(False).alias("leading")).distinct()
    zero = starts.sparkSession.range(1).select(F.lit(0).cast("long").alias("first_page"), F.lit(True).alias("leading"))
    all_starts = own.unionByName(zero).groupBy("first_page").agg(F.min("leading").alias("leading"))
    end = F.lead("first_page", 1).over(Window.orderBy("first_page"))
    return all_starts.select("first_page", (F.coalesce(end, total) - F.col("first_page")).alias("page_count")).where("page_count > 0")


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add ``name``, each row's place (from 0) in an order of all rows.

    Rows are dealt into ranges of the order; each range is sorted and numbers its own, and goes on from the rows before it,
    of which there is a count for each range. The numbered ranges are written once, as another sample would cut them
    elsewhere, so rows are shuffled once.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(dealt.select(*df.columns, F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at")), "ranges")
    counted = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counted.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def interleave(sources: list[DataFrame], key: str, group: int) -> DataFrame:
    """Round robin over the sources, ``group`` rows at a time, in the order of ``key``: source, key, place.

    A row's place follows from its page in its own source and the sources' sizes, so their union isn't sorted.
    """
    sizes, out = [d.count() for d in sources], []
    for i, d in enumerate(sources):
        page = F.col("page")
        turn = F.floor(page / group) * group
        others = [F.least(F.lit(n), turn + group if j < i else turn) for j, n in enumerate(sizes) if j != i]
        rows = numbered(d.select(F.lit(i).alias("source"), F.col(key).alias("key")), ["key"], "page")
        out.append(rows.select("source", "key", reduce(Column.__add__, others, page).alias("place")))
    return reduce(DataFrame.unionByName, out)


def concatenate(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first source, then of the next: source, key, place."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("source"), F.col(key).alias("key")) for i, d in enumerate(sources)])
    return numbered(rows, ["source", "key"], "place")


def page_ranges(df: DataFrame, column: str, pages: int) -> DataFrame:
    """A row (0-based ``page``) for each page that ``1-3, 7, 10-`` names, once, in order; none if a part is wrong."""
    parts = F.filter(F.split(column, "[, ;]"), lambda p: F.trim(p) != "")
    first = lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    last = lambda p: F.when(p.contains("-"), F.coalesce(F.regexp_extract(p, r"-(\d+)$", 1).try_cast("int"), F.lit(pages))).otherwise(first(p))
    valid = lambda p: p.rlike(r"^\d+(-\d*)?$") & first(p).between(1, pages) & last(p).between(1, pages) & (first(p) <= last(p))
    named = df.withColumn("_parts", parts).where((F.size("_parts") > 0) & F.forall("_parts", valid))
    return named.withColumn("page", F.explode(F.array_sort(F.array_distinct(F.flatten(F.transform("_parts", lambda p: F.sequence(first(p) - 1, last(p) - 1))))))).drop("_parts")


def booklet(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Add ``place``: where each row, a page in the given order, comes on sheets of four pages folded in the middle.

    A sheet takes two pages from the front and two from the back; the last pages stay blank if their number isn't a
    multiple of four, so their places are missing. Rows are numbered by ranges, and places follow by arithmetic.
    """
    placed = numbered(df, order, "_page")
    padded = -(-placed.count() // 4) * 4
    page, back = F.col("_page"), F.lit(padded - 1) - F.col("_page")
    front = F.floor(page / 2) * 4 + 1 + page % 2
    return placed.withColumn("place", F.when(page < padded // 2, front).otherwise(F.floor(back / 2) * 4 + F.when(back % 2 == 0, 0).otherwise(3))).drop("_page")


def consecutive_runs(df: DataFrame, by: str, position: str) -> DataFrame:
    """Maximal runs of consecutive positions: ``by``, first, count."""
    gap = F.col(position) - F.row_number().over(Window.partitionBy(by).orderBy(position))
    return df.select(by, position, gap.alias("_run")).groupBy(by, "_run").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("count")).drop("_run")


def flatten_tree(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """Depth-first listing of rows (id, parent_id, ord): id, depth and a path that sorts in reading order."""
    return nodes.sparkSession.sql(
        f"""WITH RECURSIVE tree MAX RECURSION LEVEL {most_depth} AS (
              SELECT id, 0 AS depth, lpad(CAST(ord AS STRING), 6, '0') AS path FROM {{nodes}} WHERE parent_id IS NULL
              UNION ALL
              SELECT n.id, t.depth + 1, concat(t.path, '/', lpad(CAST(n.ord AS STRING), 6, '0')) FROM tree t JOIN {{nodes}} n ON n.parent_id = t.id)
            SELECT id, depth, path FROM tree""",
        nodes=nodes,
    )


def interval_pairs(df: DataFrame, by: str, key: str, time: str, seconds: int) -> DataFrame:
    """Pairs of rows of one ``by`` within ``seconds``: each row meets those of its own time bucket and the next."""
    bucket = F.floor(F.unix_timestamp(time) / seconds)
    left = df.select(by, F.col(key).alias("first_key"), F.col(time).alias("first_time"), F.explode(F.array(bucket, bucket + 1)).alias("_bucket"))
    right = df.select(by, F.col(key).alias("second_key"), F.col(time).alias("second_time"), bucket.alias("_bucket"))
    near = (F.col("second_time") > F.col("first_time")) & (F.col("second_time") <= F.col("first_time") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return left.join(right, [by, "_bucket"]).where(near).select(by, "first_key", "second_key")
