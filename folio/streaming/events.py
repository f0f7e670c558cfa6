"""Structured Streaming forms of the event queries: settling, windows, search, newest state, history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Files below a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def settled(events: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """A row for each burst of events that ``gap`` without events ends: by, first, last, events."""
    bursts = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return bursts.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("events")).select(by, "first", "last", "events")


def tumbling_counts(events: DataFrame, time: str, by: str, size: str, late: str) -> DataFrame:
    counted = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")


def incremental_search(events: DataFrame, column: str, word: str) -> DataFrame:
    """Matching rows as they come; stateless."""
    return events.where(F.lower(column).contains(word.lower()))


def joined_within(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, seconds: int, late: str) -> DataFrame:
    """Pairs of two streams with equal ``by`` whose times are within ``seconds``, the right one not before the left."""
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late).withColumnRenamed(by, f"_{by}")
    near = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, (F.col(by) == F.col(f"_{by}")) & near).drop(f"_{by}")


def newest_generation(events: DataFrame, by: str, generation: str, schema: str) -> DataFrame:
    """Rows whose generation isn't older than the largest that their key has shown; stale ones are dropped.

    The state of a key is one number, so it doesn't grow with the stream.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        for frame in frames:
            largest = frame[generation].cummax()
            if newest is not None:
                largest = largest.clip(lower=newest)
            yield frame[frame[generation] >= largest]
            newest = int(largest.iloc[-1]) if len(frame) else newest
        if newest is not None:
            state.update((newest,))

    return events.groupBy(by).applyInPandasWithState(keep, schema, "newest long", "append", GroupStateTimeout.NoTimeout)


def history_positions(edits: DataFrame, by: str, order: str, action: str) -> DataFrame:
    """Undo and redo over a log of edits: the number of edits in force after each action, for each ``by``.

    ``action`` is edit, undo or redo; a new edit clears what could be redone. The log of one key is folded in order.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        at, top, out = 0, 0, []
        for what in frame.sort_values(order)[action]:
            if what == "undo":
                at = max(0, at - 1)
            elif what == "redo":
                at = min(top, at + 1)
            else:
                at += 1
                top = at
            out.append(at)
        return frame.sort_values(order)[[by, order]].assign(position=out)

    fields = {f.name: f.dataType.simpleString() for f in edits.schema.fields}
    return edits.select(by, order, action).groupBy(by).applyInPandas(fold, f"{by} {fields[by]}, {order} {fields[order]}, position int")
