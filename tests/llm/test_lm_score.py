import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import lm_score, registry
from folio.llm.common import fold_of


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lm_score.make_vocabulary, "__defaults__", (300, 40, 20, 7))


def split(text):
    return (text or "").encode().lower().split() + [b""]


def brute(rows):
    words = {n: split(t) for n, (_, t) in enumerate(rows)}
    out = {n: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for n, (i, _) in enumerate(rows)}
    c = Counter(w for n, ws in words.items() if not out[n] for w in ws)
    total, distinct = sum(c.values()), len(c)
    return sorted(
        ((rows[n][0], out[n], len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 6)) for n, ws in words.items()), key=str
    )


def brute_score(model, counts, text):
    """The model by its definition, token by token, without batches: a softmax over clusters, one over a cluster's items, and a share."""
    outputs, table, scale = (x.astype(float) for x in model.parameters)
    numbers = {t: i for i, t in enumerate(model.tokens.to_pylist())}
    endings = dict(zip(model.endings.to_pylist(), model.ending_items.tolist(), strict=True))
    item_of = lambda w: int(model.items[numbers[w]]) if w in numbers else endings.get(w[-3:], model.other)
    front, total = [model.size] * lm_score.ORDER, 0.0
    for word in split(text):
        item = item_of(word)
        q = sum(scale[:, i] * table[:, f] for i, f in enumerate(front))
        s = outputs[0] + q @ outputs[1:]
        c = int(model.cluster_of[item])
        a, b = model.first[c], model.first[c + 1]
        p = np.exp(s[c]) / np.exp(s[: model.clusters]).sum() * np.exp(s[model.clusters + item]) / np.exp(s[model.clusters + a : model.clusters + b]).sum()
        share = (counts.get(word, 0) + 0.1) / (model.mass[item] + 0.1) if model.shared[item] else 1.0
        total += math.log10(p * share)
        front = [item, *front[:-1]]
    return total


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    got = lm_score.score_documents(df, fold_of(F.col("doc_id"), 10) == 0).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == brute(rows)
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-5 for r in got)
    return got


@pytest.mark.parametrize("slice_bytes", [100, 32 << 20])
def test_counts_and_base_scores(spark, small, monkeypatch, slice_bytes):
    monkeypatch.setattr(lm_score, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(lm_score, "COUNT_BYTES", slice_bytes)
    rows = [(i, f"The word{i % 50} and  word{i % 7}\nis Éa{i} end.") for i in range(400)]
    check(spark, [*rows, (None, None), (1000, ""), (1001, "\x00 5 \x1f"), (1003, "\x0b lead\x1ced x \x0c"), (3, rows[3][1]), (1002, "x " * 5000)])


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    assert all(abs(r["score"]) < 1e-6 for r in check(spark, [(held, "")]))
    assert all(abs(r["score"]) < 1e-6 for r in check(spark, [(held, "a b c")]))
    assert lm_score.score_documents(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0


def test_scores_against_the_definition(spark, small, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 50)
    monkeypatch.setattr(lm_score, "ROWS", 16)
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 40))) for i in range(1, 120)] + [(500, None), (501, "unseen words, W5 w10"), (502, "w5 " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_score.count_tokens(df)
    model = lm_score.fit(df, counts)
    monkeypatch.setattr(lm_score, "fit", lambda *_: model)
    known = {bytes(r["token"]): r["c"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(df, F.lit(False)).collect()}
    for doc_id, text in rows:
        assert got[doc_id] == pytest.approx(brute_score(model, known, text), rel=1e-4, abs=1e-4)


def test_probabilities_add_up(spark, small):
    texts = spark.createDataFrame([(" ".join(f"w{(i * j) % 97}" for j in range(30)),) for i in range(60)], "text string")
    counts = lm_score.count_tokens(texts)
    model = lm_score.fit(texts, counts)
    scorer = lm_score.Scorer(model)
    _, sizes, _, head, _ = next(lm_score.read_batch(model, pa.array(["w5 w10"])))
    items = np.array([scorer.score(np.append(head[:-1], i), sizes)[-1] for i in range(model.size)])
    assert np.sum(10**items) == pytest.approx(1, abs=1e-5)
    total = 0.0
    for token, c in ((bytes(r["token"]), r["c"]) for r in counts.collect()):
        item = int(next(lm_score.read_batch(model, pa.array([token.decode()])))[3][0])
        total += 10 ** items[item] * ((c + 0.1) / (model.mass[item] + 0.1) if model.shared[item] else 1)
    unknown = sum(10 ** items[i] * 0.1 / (model.mass[i] + 0.1) for i in np.flatnonzero(model.shared))
    assert total + unknown == pytest.approx(1, abs=1e-4)


def test_better_than_unigrams_on_held_out_text(spark, data):
    got = registry.op1_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (got["s"] - got["b"]) / got["n"] > 0.1
