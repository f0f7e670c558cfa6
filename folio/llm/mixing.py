"""Mix sources to target weights with a multivariate-hypergeometric splitting tree (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, release

#: The fewest blocks of a source, the words of all documents for each further one, parts of a block, and hash buckets in
#: which a node of the tree ranks its draws.
BLOCKS, BLOCK_WORDS, PARTS, BUCKETS = 64, 10_000_000, 64, 256


def _order(seed: int, *parts: Column) -> Column:
    """A pseudo-random text that depends on the seed and the parts only, so reruns agree on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """Targets by source from rows (skey, source, size).

    Sources by code point, null last, get ``weights`` in turn and share the sum of all sizes by weight. A target
    stops at ``most_repeats`` times its source's size; in the order of (cap / weight) the capped sources are a
    prefix, so running sums find them without a loop. One row a source: skey, source_size, target, passes, rest.
    """
    by_source = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    caps = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_repeats)
    everything = Window.partitionBy()
    earlier = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    caps = (
        caps.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("free") <= F.col("left") * F.col("weight"))
    )
    # The first source that isn't capped has what is left for it and all behind it.
    first = F.min_by(F.struct("left", "free"), F.when(~F.col("capped"), -F.col("free"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((first["left"] * F.col("weight")).cast("double") / first["free"])
    out = caps.withColumn("target", target)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return out.withColumn("passes", passes).select("skey", "source_size", "target", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))


def block_count(words: int, least: int = BLOCKS, block_words: int = BLOCK_WORDS) -> int:
    """Blocks of a source: the smallest power of two times ``least`` that leaves a block at most ``block_words`` of ``words``."""
    blocks = least
    while blocks * block_words < words:
        blocks *= 2
    return blocks


def split_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """How many of each source's draws go to each shard: skey, shard, quota, from rows (skey, block, pass).

    Level by level every node of the tree sends half of its draws, picked by a permutation of its own, to the left
    child: the left child's counts by source are a multivariate hypergeometric draw from the node's quotas, and
    the right child has exactly the rest. ``shards`` is a power of two; a leaf is a shard, and shards differ by
    one draw at most on any level. A draw's place in its node's permutation is its place in its hash bucket after
    all the buckets before, so no task ranks a whole node.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    out = draws.select("skey", "block", "pass", F.lit(0).alias("shard"))
    for level in range(shards.bit_length() - 1):
        out = out.withColumn("key", _order(seed, F.lit(level), F.col("skey"), F.col("block"), F.col("pass")))
        out = out.withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * BUCKETS / 2**32).withColumn("bucket", F.floor("bucket"))
        node = Window.partitionBy("shard")
        counted = out.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.select("shard", "bucket", (F.sum("n").over(node.orderBy("bucket")) - F.col("n")).alias("earlier"), F.sum("n").over(node).alias("whole"))
        place = F.col("earlier") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "skey", "block", "pass"))
        right = (place * 2 > F.col("whole") + 1).cast("int")
        out = out.join(counted, ["shard", "bucket"]).select("skey", "block", "pass", (F.col("shard") * 2 + right).alias("shard"))
    return out.groupBy("skey", "shard").agg(F.count(F.lit(1)).alias("quota"))


def draw_blocks(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """The draws (skey, block, pass) with the shard that takes each: leaves take disjoint runs of a source's permuted draws, as long as their quotas."""
    place = F.row_number().over(Window.partitionBy("skey").orderBy(_order(seed, F.lit("draw"), F.col("skey"), F.col("block"), F.col("pass"))))
    upto = F.sum("quota").over(Window.partitionBy("skey").orderBy("shard"))
    ends = split_quotas(draws, shards, seed).select("skey", F.struct(upto.alias("upto"), "shard").alias("end")).groupBy("skey").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    placed = draws.select("skey", "block", "pass", place.alias("place")).join(ends, "skey")
    return placed.select("skey", "block", "pass", F.filter("ends", lambda e: e["upto"] >= F.col("place"))[0]["shard"].alias("shard"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, shards: int = 8, seed: int = 7, blocks: int | None = None, parts: int = PARTS) -> DataFrame:
    """How often each document goes into the mix, and into which shards.

    ``docs`` has doc_id, source, text. Returns doc_id, source, size, source_size, target, taken, block and ``draws``,
    an array of (pass, shard), one entry for each copy taken. A source is dealt into ``blocks`` blocks of ``parts`` parts
    by a hash of the ids; where ``blocks`` isn't given it follows the size of the corpus (``block_count``), so a block stays
    as large as it was whatever the corpus. Its quota is every block floor(target / source size) times, and blocks in permuted order once
    more while they fit the rest. The tree splits the quotas of all sources among the shards, and each shard draws
    its quota of blocks; a document is taken as often as its block is drawn. The last block of a quota, at which the
    rest ends, gives parts and then documents in permuted order while they fit; then the one document outside all
    these whose size is nearest to what is missing joins, if that brings the sum nearer.

    Null or empty texts have size 0 and are drawn with their block, which takes no words. A null source is a
    source of its own. Repeated rows are documents of their own. Without words all targets are 0. The text is read
    once; what is shuffled are ids and sizes. Windows hold the blocks of a source, or the documents of one part of one block,
    some 160,000 words; the targets' hold a row for each source.
    """
    skey = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("n"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = docs.select("doc_id", "source", skey.alias("skey"), size.alias("size"), _order(seed, F.col("doc_id")).alias("rank"))
    cell = F.conv(F.substring("rank", 1, 8), 16, 10).cast("long")
    written = materialize(sized.withColumns({"row": F.monotonically_increasing_id(), "cell": cell}), "sizes")
    blocks = blocks or block_count(written.agg(F.sum("size")).first()[0] or 0)
    sized = written.withColumns({"block": F.col("cell") % blocks, "part": F.floor(F.col("cell") / blocks) % parts}).drop("cell")

    cells = materialize(sized.groupBy("skey", "source", "block", "part").agg(F.sum("size").alias("size")), "cells")
    targets = source_targets(cells, weights, most_repeats)
    summed = cells.groupBy("skey", "block").agg(F.sum("size").alias("block_size")).join(targets, "skey")
    path = Window.partitionBy("skey").orderBy(_order(seed, F.col("skey"), F.col("block"))).rowsBetween(Window.unboundedPreceding, 0)
    summed = summed.withColumn("upto", F.sum("block_size").over(path)).withColumn("before", F.col("upto") - F.col("block_size"))
    whole = (F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)
    cut = (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    placed = materialize(summed.withColumn("whole", whole).withColumn("cut", cut), "blocks")

    last = F.when(F.col("whole") | F.col("cut"), F.col("passes")).otherwise(F.col("passes") - 1)
    draws = placed.where(F.col("whole") | F.col("cut") | (F.col("passes") > 0)).select("skey", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pass"))
    drawn = draw_blocks(materialize(draws, "draws"), shards, seed).groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("drawn"))
    placed = placed.join(drawn, ["skey", "block"], "left").select("skey", "block", "source_size", "target", "passes", "whole", "cut", (F.col("rest") - F.col("before")).alias("room"), "drawn")
    placed = materialize(placed, "drawn")

    # The same again for the parts of the block at which a source's rest ends.
    within = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    pieces = cells.join(placed.where("cut").select("skey", "block", "room"), ["skey", "block"]).withColumn("upto", F.sum("size").over(within))
    pieces = pieces.select("skey", "block", "part", (F.col("room") - F.col("upto") + F.col("size")).alias("part_room"), (F.col("upto") <= F.col("room")).alias("part_whole"))

    # AQE turns these into broadcasts while the tables are small; keys are blocks, so a large source is spread.
    rows = sized.join(placed, ["skey", "block"]).join(pieces, ["skey", "block", "part"], "left")
    part_cut = F.col("cut") & ~F.col("part_whole") & (F.col("part_room") > 0)
    inside = Window.partitionBy("skey", "block", "part").orderBy("rank", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part_cut", F.coalesce(part_cut, F.lit(False)))
    rows = rows.where("part_cut").withColumn("fits", F.sum("size").over(inside) <= F.col("part_room")).unionByName(rows.where("not part_cut").withColumn("fits", F.coalesce(F.col("cut") & F.col("part_whole"), F.lit(False))))
    met = materialize(rows.select("row", "doc_id", "source", "skey", "block", "size", "rank", "source_size", "target", "passes", "whole", "cut", "room", "drawn", "fits"), "rows")
    release(written, cells)
    rows = met

    missing = rows.where("cut").groupBy("skey").agg((F.first("room") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0))).alias("missing"), F.element_at(F.first("drawn"), -1).alias("last_draw"))
    error = F.abs(F.col("missing") - F.col("size"))
    # By block, not by source: a source of a third of all rows would meet in one task.
    missing = placed.select("skey", "block").join(missing, "skey")
    best = (
        rows.where("not whole and not fits")
        .join(missing, ["skey", "block"])
        .where(error < F.col("missing"))
        .groupBy("skey")
        .agg(F.min_by(F.struct("row", "last_draw"), F.struct(error, "rank", "doc_id", "row")).alias("best"))
        .select(F.col("best.row").alias("row"), F.col("best.last_draw").alias("last_draw"))
    )
    rows = rows.join(best, "row", "left")
    none = F.expr("cast(array() as array<struct<pass:bigint,shard:int>>)")
    # Of the block at which the rest ends only what fits goes along with the last draw.
    own = F.filter(F.coalesce(F.col("drawn"), none), lambda d: (d["pass"] < F.col("passes")) | F.col("whole") | F.col("fits"))
    draws = F.when(F.col("last_draw").isNotNull(), F.array_append(own, F.col("last_draw"))).otherwise(own)
    return rows.withColumn("draws", draws).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "block", "draws")


def mix_documents(docs: DataFrame, shards: int = 8, seed: int = 7, **options) -> DataFrame:
    """The mix itself: a row for each copy drawn, with the columns of ``docs`` and mix_pass, mix_shard, mix_place.

    Documents join their plan on id, source and size; rows that repeat all three (as null texts under null ids) are
    numbered on both sides, by a hash of the text and by what the plan takes, and join on the number as well. Rows of a shard
    have an order of their own (``mix_place`` sorts them), which ``write_shards`` writes. Documents that the plan doesn't draw are absent; see ``plan_mix`` for the rest.
    """
    names = docs.columns
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    plan = plan_mix(docs, shards=shards, seed=seed, **options).select(key.alias("key"), "taken", "draws")
    plan = materialize(plan.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy("key"))), "mix")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("whole"), "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("hash")).select("whole", "doc_id", "hash", key.alias("key"))
    # A key of one row meets its plan by the key alone, so texts move once; rows that repeat a key are numbered on both
    # sides and meet one by one.
    alone = rows.join(plan.where("rows = 1 and size(draws) > 0").select("key", "draws"), "key")
    repeated = plan.where("rows > 1")
    nth = lambda order: F.row_number().over(Window.partitionBy("key").orderBy(order))
    numbered = rows.join(repeated.select("key").distinct(), "key", "left_semi").withColumn("nth", nth(F.col("hash")))
    met = numbered.join(repeated.select("key", nth(F.col("taken")).alias("nth"), "draws"), ["key", "nth"])
    met = alone.select("doc_id", "whole", "draws").unionByName(met.select("doc_id", "whole", "draws"))
    drawn = met.select("doc_id", "whole", F.explode("draws").alias("draw"))
    place = _order(seed, F.col("doc_id"), F.col("draw.pass"), F.col("draw.shard"))
    return drawn.select(*[F.col(f"whole.`{n}`").alias(n) for n in names], F.col("draw.pass").alias("mix_pass"), F.col("draw.shard").alias("mix_shard"), place.alias("mix_place"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """Write a mix (a written table, as it is read twice) as Parquet, a folder ``mix_shard=N`` each, locally shuffled.

    A shard's files, by name, hold its rows in the order of ``mix_place``: the shuffle within the shard. Shards are dealt
    by ranges of shard and place, so one of any size is spread over tasks and none needs an order over all shards. Copies
    of repeated rows that have a place in common stand next to each other. An empty mix gives a folder without shards.
    """
    ordered = mixed.repartitionByRange("mix_shard", "mix_place").sortWithinPartitions("mix_shard", "mix_place")
    ordered.write.partitionBy("mix_shard").parquet(path)
