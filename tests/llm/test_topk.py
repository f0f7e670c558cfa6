import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long"


def brute(rows, k):
    usable = [(n, i, [math.floor(1024 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j is None, j or 0, m) for m, j, x in usable if m != n)
        out += [(i, r + 1, None if s[1] else s[2], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "STEP", 16)
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, rng.choice([0.1, 1, 5]), 8)]) for i in range(0, 2000, 10)]
    rows += [(i, rows[3][1]) for i in (5000, 5001, 5002, 5100, 5100)]
    rows += [(None, rows[0][1]), (6000, None), (6100, []), (6200, [1.0, None] + [0.0] * 6), (6300, [float("nan")] * 8), (6400, [float("inf")] * 8), (6500, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect()), key=str)
    assert got == brute(rows, 10)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 10).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0, 10).count() == 0
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0
