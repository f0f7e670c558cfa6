"""Documents put together from pages of others, with their labels and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .relational import as_of
from .trees import followed


def effective_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """``pages`` (source, page) with the style and number that their source's label ranges (source, start, style, first) give them.

    A page before the first range, or of a source without ranges, has no style and counts from 1.
    """
    found = as_of(pages, "page", ranges.withColumnRenamed("start", "_start"), "_start", by="source")
    return found.withColumn("number", F.coalesce(F.col("page") - F.col("_start") + F.col("first"), F.col("page") + 1)).drop("_start", "first")


def compact_labels(labelled: DataFrame) -> DataFrame:
    """Ranges (start, style, first) of rows (place, style, number) whose places go on from 0 without gaps.

    A range begins where the style changes or the number doesn't go on by one. Each row meets the row before it by
    its place, so no order over all rows is needed.
    """
    before = labelled.select((F.col("place") + 1).alias("place"), F.col("style").alias("_style"), F.col("number").alias("_number"), F.lit(True).alias("_any"))
    both = labelled.join(before, "place", "left")
    goes_on = F.col("_any").isNotNull() & F.col("style").eqNullSafe(F.col("_style")) & (F.col("number") == F.col("_number") + 1)
    return both.where(~F.coalesce(goes_on, F.lit(False))).select(F.col("place").alias("start"), "style", F.col("number").alias("first"))


def assemble_labels(picked: DataFrame, ranges: DataFrame) -> DataFrame:
    """The label ranges of a document made of ``picked`` (place, source, page): every page keeps the label it had."""
    return compact_labels(effective_labels(picked, ranges).select("place", "style", "number"))


def splice_outlines(outlines: DataFrame, picked: DataFrame, most_depth: int = 64) -> DataFrame:
    """The outline of an assembled document: id, parent, depth, ord (source and path, which sort) and target.

    ``outlines`` (source, id, parent, ord, page; ids are distinct over all sources) and ``picked`` (place, source, page). An
    entry stays if its page is picked, and leads to the first place of that page; it hangs below its nearest ancestor that
    stays. Sources follow each other by the first place of any of their pages.
    """
    targets = written(picked.groupBy("source", "page").agg(F.min("place").alias("target")), "targets")
    order = targets.groupBy("source").agg(F.min("target").alias("first"))
    picks = targets.join(order, "source").withColumn("stays", F.lit(True))
    nodes = written(outlines.join(picks, ["source", "page"], "left").select("id", "parent", "ord", "target", "first", F.coalesce("stays", F.lit(False)).alias("stays")), "outlines")
    # An entry that stays counts for those below it, and is nearest to them until another does.
    roots = nodes.where("parent is null").select("id", "target", "first", "stays", F.lit(None).cast(nodes.schema["id"].dataType).alias("above"), F.lit(0).cast("long").alias("depth"), F.array("ord").alias("path"))
    grown = {"above": F.when(F.col("_stays"), F.col("_id")).otherwise(F.col("_above")), "depth": F.col("_depth") + F.col("_stays").cast("long"), "path": F.concat("_path", F.array("ord"))}
    found = followed(roots, nodes.where("parent is not null"), {"parent": "id"}, grown, most_depth, f"the tree is deeper than {most_depth} levels")
    return found.where("stays").select("id", F.col("above").alias("parent"), "depth", F.concat(F.array("first"), F.col("path")).alias("ord"), "target")
