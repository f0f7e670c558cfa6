import random

import numpy as np
import pytest

from folio.llm import decontaminate as d


def naive(item, doc, least):
    """Greedy string tiling by its definition."""
    mi, md, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sorted((i, j, n) for i, j, n in tiles)
        n, i, j = best
        tiles.append((i, j, n))
        mi[i : i + n] = md[j : j + n] = [True] * n


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_the_definition(seed):
    rng = random.Random(seed)
    words = [b"%d" % i for i in range(rng.choice([2, 4, 30]))]
    item = [rng.choice(words) for _ in range(rng.randint(3, 25))]
    doc = [rng.choice(words) for _ in range(rng.randint(0, 40))]
    at = rng.randint(0, len(doc))
    doc[at:at] = item[len(item) // 2 :] + item[: len(item) // 2]
    least = 3
    hi, hd = (d.window_hashes(d.token_hashes(x), least) for x in (item, doc))
    i, j = np.nonzero(hi[:, None] == hd[None])
    assert d.tile(item, doc, i, j, least) == naive(item, doc, least)


def test_collisions_only_cost_time():
    item, doc = [b"a", b"b", b"c", b"d", b"e", b"f"], [b"a", b"b", b"c", b"x", b"e", b"f"]
    i = np.arange(4)
    assert d.tile(item, doc, i, i, 3) == [(0, 0, 3)]


def test_documents(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    reordered = "x y NINE ten eleven twelve thirteen fourteen fifteen sixteen between one two three four five six seven eight z"
    rows = [(1, "so " + item.upper() + " end"), (2, reordered), (3, "one two three four five then other words"), (4, None), (5, ""), (None, item), (6, "short item here"), (7, item), (7, item)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, coverage string")
    bench = spark.createDataFrame([(10, item), (11, "short item here"), (12, None), (13, "")], "item_id long, text string")
    for slice_words in (d.SLICE_WORDS, 1):
        got = d.contaminations(docs, bench, slice_words=slice_words).collect()
        found = [("1", 10, 1.0, 1), ("2", 10, 1.0, 2), ("6", 11, 1.0, 1), ("7", 10, 1.0, 1), ("7", 10, 1.0, 1), ("None", 10, 1.0, 1)]
        assert sorted((str(r["doc_id"]), r["item_id"], r["coverage"], r["n_tiles"]) for r in got) == found
        clean = d.decontaminate(docs, bench, slice_words=slice_words)
        assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5]
    assert d.contaminations(docs, bench.limit(0)).count() == 0 and d.decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("pairs", [3, 1 << 20])
@pytest.mark.parametrize("seed", range(4))
def test_query_against_the_definition(spark, monkeypatch, seed, pairs):
    """All pairs of documents and items by the definition of tiling, items of every length, few words and many."""
    monkeypatch.setattr(d, "PAIRS", pairs)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rng.choice([1, 2, 5, 40]))]
    items = [(n, [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 20]))]) for n in range(12)]
    docs = [(None if n == 3 else n // 2, [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 6, 30]))]) for n in range(20)]
    for n in range(0, 20, 3):
        source = items[n % 12][1]
        docs[n][1].extend(source[len(source) // 2 :] + source[: len(source) // 2])
    want = []
    for doc_id, doc in docs:
        for item_id, item in items:
            least = min(5, len(item))
            tiles = naive(item, doc, least) if item else []
            if tiles and sum(t[2] for t in tiles) >= 0.6 * len(item):
                want.append((doc_id, item_id, tuple(tiles)))
    frame = lambda rows, ddl: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], ddl)
    got = d.contaminations(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["item_id"], tuple(map(tuple, r["tiles"]))) for r in got), key=str) == sorted(want, key=str)


def test_very_long_repetitive_texts():
    known = d.Benchmark([(1, "a " * 400), (2, "a b " * 150 + " ".join(f"u{i}" for i in range(60))), (3, "a")], 5)
    assert [(i, n, sum(t[2] for t in tiles)) for i, n, tiles in known.hits("a " * 200_000)] == [(3, 1, 1), (1, 400, 400)]
    assert {i: sum(t[2] for t in tiles) for i, _, tiles in known.hits("a b " * 50_000)} == {3: 1, 2: 300}


def test_planted_passages(spark, data):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    items = {r["item_id"]: " ".join(r["text"].lower().split()) for r in bench.collect()}
    whole = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in " ".join((r["text"] or "").lower().split())}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in d.contaminations(docs, bench).collect()}
