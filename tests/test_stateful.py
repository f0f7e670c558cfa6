import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions import positions
from folio.operators import search
from folio.streaming import stateful

START = datetime(2024, 1, 1)


def made(seed, kinds):
    """Events of five keys in order of time with some disorder within a minute; two files split them."""
    rng = random.Random(seed)
    rows = [(i, START + timedelta(seconds=20 * i + rng.randint(-30, 30)), rng.randint(1, 5), rng.choice(kinds)) for i in range(400)]
    return rows[:150], rows[150:280], rows[280:]


def run(spark, parts, folder, build, at_once):
    """All files at once, or run, add a file, and run again from the checkpoint."""
    source, out = f"{folder}/in", None
    frames = [spark.createDataFrame(p, "event_id long, ts timestamp, user_id long, what string").coalesce(1) for p in parts]
    for i, frame in enumerate(frames):
        frame.write.mode("append").parquet(source)
        if not at_once or i + 1 == len(frames):
            out = stateful.until_the_end(spark, source, 1, build, f"{folder}/out")
    return sorted(map(tuple, out.collect()), key=str)


def undo_brute(rows, depth, mark):
    out, stacks = [], {}
    for i, ts, user, what in sorted(rows, key=lambda r: (r[1], r[0])):
        if ts > mark:
            continue
        undo, redo = stacks.setdefault(user, ([], []))
        if what == "undo":
            redo += [undo.pop()] if undo else []
        elif what == "redo":
            undo += [redo.pop()] if redo else []
        else:
            undo.append(i)
            del undo[:-depth], redo[:]
        out.append((user, i, len(undo), len(redo), undo[-1] if undo else None))
    return sorted(out, key=str)


def latest_brute(rows, wait, mark):
    out = []
    for user in range(1, 6):
        own = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0]))
        n = 0
        for r, following in zip(own, [*own[1:], None]):
            n += r[3] == "advance"
            if r[3] != "advance" and r[1] + wait <= mark and (following is None or following[1] > r[1] + wait):
                out.append((user, r[0], n))
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [True, False])
def test_undo_log_goes_on_from_its_checkpoint(spark, tmp_path, at_once):
    parts = made(1, ["edit", "edit", "undo", "redo"])
    build = lambda e: stateful.undo_log(e, "user_id", "ts", "event_id", "what", "2 minutes", depth=4)
    rows = sum(parts, [])
    assert run(spark, parts, tmp_path, build, at_once) == undo_brute(rows, 4, max(r[1] for r in rows) - timedelta(minutes=2))


@pytest.mark.parametrize("at_once", [True, False])
def test_latest_requests_go_on_from_their_checkpoint(spark, tmp_path, at_once):
    parts = made(2, ["request", "request", "advance"])
    build = lambda e: stateful.latest_requests(e, "user_id", "ts", "event_id", "what", 40_000, "2 minutes")
    rows = sum(parts, [])
    assert run(spark, parts, tmp_path, build, at_once) == latest_brute(rows, timedelta(seconds=40), max(r[1] for r in rows) - timedelta(minutes=2))


def test_fold_map(spark):
    rows = [(1, "Café CAFÉ ｃａｆｅ"), (2, None), (3, ""), (1, "no"), (4, "é́e"), (5, "x " * 50_000 + "café")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    places = positions.match_places(F.col("text"), "café", ignore_diacritics=True, compatibility=True)
    got = {(r["doc_id"], r["text"]): [tuple(p) for p in r["p"]] for r in docs.withColumn("p", places).collect()}
    assert got[1, rows[0][1]] == [(1, 4, 1, 4), (6, 4, 7, 4), (11, 4, 12, 4)]
    assert got[2, None] == got[3, ""] == got[1, "no"] == []
    assert got[5, rows[5][1]] == [(100_001, 4, 100_001, 4)]
    for _, text in rows:
        for _, _, start, length in got.get((5, text), []):
            assert text[start - 1 : start - 1 + length].startswith("caf")
    over = search.match_starts(docs, "ee", "doc_id", ignore_diacritics=True)
    assert [(r["source_start"], r["source_length"]) for r in over.where("doc_id = 4").collect()] == [(1, 4)]
    plain = search.match_starts(spark.createDataFrame([(1, "aaaa  b")], "doc_id long, text string"), "aa", "doc_id", overlapping=True)
    assert [r["start"] for r in plain.orderBy("start").collect()] == [1, 2, 3]
    assert search.match_starts(docs, "  ", "doc_id").collect() == []
    assert "Exchange" not in docs.select(places)._jdf.queryExecution().executedPlan().toString()


def test_a_timer_for_the_first_row_that_becomes_due():
    # Each row had a timer of its own, and each timer read the state again.
    class Held(list):
        exists, get, appendList, clear = (lambda self: bool(self)), (lambda self: iter(list(self))), list.extend, list.clear
        put = lambda self, rows: self.__setitem__(slice(None), rows)

    class Handle:
        timers = []
        getListState = lambda self, *_: Held()
        registerTimer = lambda self, ms: self.timers.append(ms)

    class Passed:
        getCurrentWatermarkInMs = lambda self: 3

    log = stateful.UndoLog(3)
    log.init(Handle())
    list(log.handleInputRows((1,), iter([pd.DataFrame({"at": [5001, 2500, 1000, 9000], "id": [4, 3, 2, 5], "what": "edit"})]), None))
    assert Handle.timers == [1]
    out = list(log.handleExpiredTimer((1,), Passed(), None))
    assert [f["action"].tolist() for f in out] == [[2, 3]] and Handle.timers == [1, 6] and list(log.held) == [(5001, 4, "edit"), (9000, 5, "edit")]
