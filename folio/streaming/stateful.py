"""Stateful streams: rows are held until the watermark has passed them and are then taken in the order of event time.

So what comes out doesn't depend on how a stream is cut into batches, and a stream that starts again from its
checkpoint goes on as if it had not stopped. Timers release what is held; state that no longer counts is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows (at: event time in microseconds, id: breaks ties, what) of a key, taken in order ``wait`` microseconds after their time.

    What is held for a key is bounded by what comes within the watermark's delay and ``wait``. There is always a timer at or
    before the time at which the first held row becomes due, and one timer takes all that are due.
    """

    def __init__(self, wait: int = 0):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id long, what string")
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        """Make further state."""

    def take(self, key: tuple, due: list[tuple], later: list[tuple]) -> list[tuple]:
        """Rows to hand on for the rows that are due, which come in order; ``later`` are those still held."""
        raise NotImplementedError

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def due(self, at: int) -> int:
        """The millisecond, rounded up, at which a row becomes due."""
        return -(-(at + self.wait) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for frame in rows for r in zip(frame["at"], frame["id"], frame["what"], strict=True)]
        if new:
            self.held.appendList([(int(a), int(i), w) for a, i, w in new])
            # A timer for the first that becomes due; those behind it get theirs when it expires.
            self.handle.registerTimer(self.due(min(int(a) for a, _, _ in new)))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.held.get()) if self.held.exists() else []
        due = [r for r in rows if self.due(r[0]) <= passed]
        if not due:
            return iter([])
        later = rows[len(due) :]
        out = self.take(key, due, later)
        if later:
            self.held.put(later)
            self.handle.registerTimer(self.due(later[0][0]))
        else:
            self.held.clear()
        return iter([self.frame(out)] if out else [])

    def close(self) -> None:
        pass


class LatestRequests(InOrder):
    """Requests that nothing newer of their client follows within ``wait``, with the client's generation at their time."""

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.generation = handle.getValueState("generation", "n long")

    def take(self, key, due, later):
        n = self.generation.get()[0] if self.generation.exists() else 0
        out = []
        for row, following in zip(due, [*due[1:], *later[:1], *([] if later else [None])], strict=False):
            if row[2] == "advance":
                n += 1
            elif following is None or following[0] > row[0] + self.wait:
                out.append((key[0], row[1], n))
        self.generation.update((n,))
        return out

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["client", "request", "generation"])


class UndoLog(InOrder):
    """Undo and redo stacks of a key, ``depth`` deep: an edit is pushed and clears what could be redone; the oldest go first."""

    def __init__(self, depth: int = 100):
        super().__init__(0)
        self.depth = depth

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.undo, self.redo = handle.getListState("undo", "id long"), handle.getListState("redo", "id long")

    def take(self, key, due, later):
        undo, redo = [[r[0] for r in s.get()] if s.exists() else [] for s in (self.undo, self.redo)]
        out = []
        for _, i, what in due:
            if what == "undo":
                redo += [undo.pop()] if undo else []
            elif what == "redo":
                undo += [redo.pop()] if redo else []
            else:
                undo, redo = [*undo, i][-self.depth :] if self.depth else [], []
            out.append((key[0], i, len(undo), len(redo), undo[-1] if undo else None))
        for state, ids in ((self.undo, undo), (self.redo, redo)):
            if ids:
                state.put([(i,) for i in ids])
            else:
                state.clear()
        return out

    def frame(self, rows):
        return pd.DataFrame(rows, columns=["owner", "action", "undo_count", "redo_count", "top"]).astype({"top": "Int64"})


def _by_key(events: DataFrame, by: str, time: str, row_id: str, what: str, late: str) -> DataFrame:
    """Rows with the columns of ``InOrder``, grouped by key."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(F.col(by).alias("key"), F.col(time), F.unix_micros(time).alias("at"), F.col(row_id).cast("long").alias("id"), F.col(what).alias("what"))
    return timed.groupBy("key")


def latest_requests(events: DataFrame, by: str, time: str, row_id: str, what: str, wait_ms: int, late: str) -> DataFrame:
    """client, request, generation: the requests of a stream that aren't superseded.

    A row whose ``what`` is ``advance`` begins the client's next generation; all others are requests. A request is
    stale, and dropped, if another row of its client comes within ``wait_ms`` after it. Requests come out when the
    watermark, ``late`` behind the newest time, has passed that wait; rows that come later still are dropped by Spark.
    """
    return _by_key(events, by, time, row_id, what, late).transformWithStateInPandas(LatestRequests(wait_ms * 1000), "client long, request long, generation long", "Append", "EventTime")


def undo_log(events: DataFrame, by: str, time: str, row_id: str, what: str, late: str, depth: int = 100) -> DataFrame:
    """owner, action, undo_count, redo_count, top: the stacks after each action of a stream of edits, undos and redos.

    ``what`` is undo, redo or anything else for an edit. ``top`` is the edit that an undo would take back next.
    """
    return _by_key(events, by, time, row_id, what, late).transformWithStateInPandas(UndoLog(depth), "owner long, action long, undo_count int, redo_count int, top long", "Append", "EventTime")


def until_the_end(spark: SparkSession, source: str, files: int, build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Run a stream over the Parquet files of ``source``, ``files`` at a time, until they end, and read what it wrote.

    Results and checkpoint lie below ``folder``; a run that finds them there goes on where the last one ended.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    pattern = f"{source[:-1]}[{source[-1]}]"  # a stream takes a single file only as what a pattern matches
    spark.conf.set(provider, PROVIDER)
    try:
        stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files).parquet(pattern)
        out = build(stream)
        query = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
