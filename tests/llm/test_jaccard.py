import random

import pytest
from pyspark.sql import functions as F

from folio.llm import jaccard as j

SCHEMA = "doc_id long, text string, n long, component string"


def shingle_sets(rows):
    out = []
    for _, text in rows:
        w = (text or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, root = shingle_sets(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for n in range(len(rows)):
        groups.setdefault(find(n), []).append(n)
    least = {}
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        for m in members:
            least[m] = min(ids, default=None)
    return sorted(((rows[n][0], len(sets[n]), least[n]) for n in range(len(rows))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.near_duplicates(df).collect()), key=str)


def edited(rng, words, rate):
    return [rng.choice("abcdefgh") + str(rng.random())[:5] if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(j, "BATCH_GRAMS", 500)
    monkeypatch.setattr(j, "BUCKET_CHARS", 500)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(55)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            rows.append((len(rows), " ".join(edited(rng, words, rng.choice([0, 0.01, 0.03, 0.1])))))
    rows += [(len(rows) + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 10, 20]))])) for i in range(25)]
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "W1 w2"), (904, "w1  W2"), (905, "w1"), (None, rows[0][1]), (0, rows[0][1]), (None, "alone in the world of words it is")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(1000)}" for _ in range(90)]
    rows = [(i, " ".join(edited(rng, words, 0.012))) for i in range(250)]
    assert run(spark, rows) == brute(rows)


def test_the_boundary_is_exact(spark):
    a = [f"a{i}" for i in range(94)]
    # 90 shingles each; the last ten words differ: 80 shared of 100, then one fewer.
    rows = [(1, " ".join(a)), (2, " ".join(a[:84] + [f"b{i}" for i in range(10)]))]
    assert [r[2] for r in run(spark, rows)] == [1, 1]
    rows[1] = (2, " ".join(a[:83] + [f"b{i}" for i in range(11)]))
    assert [r[2] for r in run(spark, rows)] == [1, 2]


def test_a_very_long_text_and_a_shingle_of_all_texts(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(edited(rng, long, 0.005))), (3, " ".join(long[:100_000])), (4, "x " * 300_000), (5, "x " * 20)]
    # Boilerplate that all texts hold, in sizes of several bands.
    rows += [(10 + i, "one two three four five six " + " ".join(f"{i}.{k}" for k in range(1 + i % 7))) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_bands_of_sizes(spark):
    rows = spark.range(1, 3000).select(F.col("id").alias("n"), F.explode(F.array(F.ceil(F.col("id") * 80 / 100), F.floor(F.col("id") * 100 / 80))).alias("m"))
    assert rows.where(F.abs(j._band(F.col("n"), 80, 100) - j._band(F.col("m"), 80, 100)) > 1).count() == 0


def test_packed_shingles_come_back():
    grams = j.shingles(" ".join(map(str, range(1000))))
    assert (j._from_planes(j._planes(grams)) == grams).all() and len(j._from_planes(b"")) == 0


def test_empty_and_keep_one(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert j.near_duplicates(df).count() == 0 and j.keep_one(df).count() == 0
    text = "a b c d e f g h i j k l m n"
    rows = [(5, text), (3, text.upper()), (3, text.upper()), (9, "other words are here now"), (None, None), (None, text), (7, None)]
    kept = j.keep_one(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("3", text.upper()), ("7", None), ("9", "other words are here now"), ("None", None)]
    assert kept.columns == ["doc_id", "text", "n", "component"]


def test_keep_one_keeps_columns_of_any_name(spark):
    from folio.llm.jaccard import keep_one

    rows = [(1, "one two three four five six", "k", 3, "o"), (2, "one two three four five six", "k2", 4, "p"), (3, "other words that are not like it", "k3", 5, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, once int, `key.x` string")
    got = keep_one(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
