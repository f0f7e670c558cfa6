"""Lengths, areas, fits and hit tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def polyline_length(points: DataFrame, by: str, order: list[str], x: Column, y: Column) -> DataFrame:
    """Sum of the segments' lengths."""
    w = Window.partitionBy(by).orderBy(*order)
    rows = points.select(by, x.alias("_x"), y.alias("_y"), *order)
    return rows.withColumn("_d", F.hypot(F.col("_x") - F.lag("_x").over(w), F.col("_y") - F.lag("_y").over(w))).groupBy(by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))


def polygon_area(points: DataFrame, by: str, order: list[str], x: Column, y: Column) -> DataFrame:
    """Half the shoelace sum; the last point meets the first."""
    w = Window.partitionBy(by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.select(by, x.alias("_x"), y.alias("_y"), *order)
    nx = F.coalesce(F.lead("_x").over(w), F.first("_x").over(whole))
    ny = F.coalesce(F.lead("_y").over(w), F.first("_y").over(whole))
    return rows.withColumn("_c", F.col("_x") * ny - nx * F.col("_y")).groupBy(by).agg((F.abs(F.sum("_c")) / 2).alias("area"))


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees from 0 to 360, with y growing downwards."""
    return F.pmod(F.degrees(F.atan2(y1 - y2, x2 - x1)), F.lit(360.0))


def affine_fit(points: DataFrame, by: str, x: str, y: str, target: str) -> DataFrame:
    """Least squares of target = a x + b y + c for each group, null where the points lie on a line."""
    s = points.groupBy(by).agg(
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, target).alias("xt"), F.covar_pop(y, target).alias("yt"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(target).alias("mt")
    )
    d = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = d > 1e-9
    a = F.when(ok, (F.col("xt") * F.col("yy") - F.col("yt") * F.col("xy")) / d)
    b = F.when(ok, (F.col("yt") * F.col("xx") - F.col("xt") * F.col("xy")) / d)
    return s.select(by, a.alias("a"), b.alias("b"), (F.col("mt") - a * F.col("mx") - b * F.col("my")).alias("c"))


def hit_test(points: DataFrame, key: str, boxes: DataFrame, box: str, tolerance: float, cell: float) -> DataFrame:
    """The box that holds each point (x, y), or the nearest within ``tolerance``, ties to the smaller box number.

    Boxes (left, bottom, right, top) are dealt over a grid of ``cell``, widened by the tolerance, so a point meets
    only the boxes of its own cell.
    """
    at = lambda v: F.floor(v / cell)
    spread = lambda low, high: F.explode(F.sequence(at(F.col(low) - tolerance), at(F.col(high) + tolerance)))
    dealt = boxes.withColumn("_cx", spread("left", "right")).withColumn("_cy", spread("bottom", "top"))
    near = points.withColumns({"_cx": at(F.col("x")), "_cy": at(F.col("y"))}).join(dealt, ["_cx", "_cy"])
    dx = F.greatest(F.col("left") - F.col("x"), F.lit(0.0), F.col("x") - F.col("right"))
    dy = F.greatest(F.col("bottom") - F.col("y"), F.lit(0.0), F.col("y") - F.col("top"))
    near = near.where((dx <= tolerance) & (dy <= tolerance)).withColumn("distance", F.hypot(dx, dy))
    best = near.groupBy(key).agg(F.min(F.struct("distance", box)).alias("b"))
    return best.select(key, F.col(f"b.{box}").alias(box), F.col("b.distance").alias("distance"))
