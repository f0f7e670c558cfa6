"""Boxes, transforms, mathematical functions and records as columns."""

from __future__ import annotations

import textwrap
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box whose left isn't right of its right, nor its bottom above its top."""
    return F.struct(F.least(x1, x2).alias("left"), F.least(y1, y2).alias("bottom"), F.greatest(x1, x2).alias("right"), F.greatest(y1, y2).alias("top"))


def affine(matrix: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """(a x + c y + e, b x + d y + f)."""
    a, b, c, d, e, f = matrix
    return x * a + y * c + e, x * b + y * d + f


def in_polygon(points: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses an odd number of edges; the polygon is part of the plan."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        if ay == by:
            continue
        straddles = (F.lit(ay) > y) != (F.lit(by) > y)
        crossings = crossings + (straddles & (x < (y - ay) * (bx - ax) / (by - ay) + ax)).cast("int")
    return crossings % 2 == 1


def exponential(x: Column, low: float, high: float, power: float) -> Column:
    return F.lit(low) + F.pow(x, F.lit(power)) * (high - low)


def stitched(x: Column, bounds: list[float], pieces: list[Callable[[Column], Column]]) -> Column:
    """The piece whose bounds hold ``x``, over ``x`` scaled to 0 to 1 between them."""
    out = None
    for low, high, piece in zip(bounds[:-1], bounds[1:], pieces, strict=True):
        value = piece((x - low) / (high - low))
        out = F.when(x < high, value) if out is None else out.when(x < high, value) if high != bounds[-1] else out.otherwise(value)
    return out


def sampled(x: Column, samples: list[float]) -> Column:
    """Linear interpolation between samples at equal distances over 0 to 1."""
    table = F.array(*[F.lit(float(s)) for s in samples])
    at = F.greatest(F.lit(0.0), F.least(x, F.lit(1.0))) * (len(samples) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.lit(len(samples) - 1))
    first, second = F.element_at(table, low + 1), F.element_at(table, high + 1)
    return first + (at - low) * (second - first)


def parse_scale(text: Column) -> Column:
    """(ratio, unit) of ``1 cm = 2 m``: units of the right side for one of the left; null for other texts."""
    shape = r"^\s*([0-9.]+)\s*(\p{L}+)\s*=\s*([0-9.]+)\s*(\p{L}+)\s*$"
    left, right = F.regexp_extract(text, shape, 1).try_cast("double"), F.regexp_extract(text, shape, 3).try_cast("double")
    return F.when(left > 0, F.struct((right / left).alias("ratio"), F.regexp_extract(text, shape, 4).alias("unit")))


def is_partial_date(text: Column) -> Column:
    """ISO 8601 to the year, month, day or minute, the last with an offset."""
    return text.rlike(r"^\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01])(T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?)?)?$")


def write_record(fields: dict[str, Column]) -> Column:
    """``key=value;`` in order; ``%``, ``;`` and ``=`` in values are escaped and null fields left out."""
    parts = []
    for name, value in fields.items():
        for char, code in (("%", "%25"), (";", "%3B"), ("=", "%3D")):
            value = F.replace(value, F.lit(char), F.lit(code))
        parts.append(F.concat(F.lit(f"{name}="), value))
    return F.concat_ws(";", *parts)


def read_record(text: Column) -> Column:
    fields = F.str_to_map(text, F.lit(";"), F.lit("="))
    back = lambda v: F.replace(F.replace(F.replace(v, F.lit("%3D"), F.lit("=")), F.lit("%3B"), F.lit(";")), F.lit("%25"), F.lit("%"))
    return F.transform_values(fields, lambda k, v: back(v))


def wrap(width: int):
    """Greedy lines of at most ``width`` characters; longer words are broken."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: textwrap.wrap(t, width) if t else [])

    return run


@F.pandas_udf(T.LongType())
def deflated_size(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(zlib.compress((t or "").encode("utf-8"))))
