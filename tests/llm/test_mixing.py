import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm.common import materialize, paths_of, shared_path
from folio.llm.mixing import block_count, draw_blocks, mix_documents, plan_mix, split_quotas, write_shards

SCHEMA = "doc_id long, text string, source string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def targets_of(sizes, weights=(1, 2, 3), cap=3):
    """Round by round: what lies over a cap goes to the others by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("spread", [(5, 50, 400, 90), (1, 1, 1, 1), (3000, 10, 10, 10)])
def test_targets_and_taken(spark, spread):
    rows = [(i * 10 + n, "w " * (i % 7 * 3 + 1), s) for n, (s, count) in enumerate(zip(("b", "a", None, "é"), spread, strict=True)) for i in range(count)]
    plan = plan_mix(docs(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target = targets_of(sizes)
    taken = defaultdict(int)
    for r in plan:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["size"] * len(r["draws"]) <= 3 * r["size"]
        assert sorted(d["pass"] for d in r["draws"]) == sorted({d["pass"] for d in r["draws"]})
        taken[r["source"]] += r["taken"]
    assert len(plan) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 19 for s in sizes)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "a b c", "b"), (3, "a b c", "b")]
    plan = plan_mix(docs(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in plan) == ["1", "2", "3", "3", "None"]
    assert all(r["taken"] == 0 for r in plan if not r["size"])
    assert plan_mix(docs(spark, [])).count() == 0
    assert {r["target"] for r in plan_mix(docs(spark, [(1, None, "a"), (2, " ", "b")])).collect()} == {0.0}


def test_reruns_agree_on_any_partitioning(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    key = lambda df: sorted((r["doc_id"], r["taken"], str(r["draws"])) for r in df.collect())
    assert key(plan_mix(table)) == key(plan_mix(table.repartition(7)))


def test_the_tree_splits_exactly(spark):
    draws = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 5).alias("skey"), F.col("id").alias("block"), F.lit(0).cast("long").alias("pass"))
    by, rows = defaultdict(dict), [(f"s{i % 5}", i, 0) for i in range(1000)]
    for r in split_quotas(draws, 8, 1).collect():
        by[r["shard"]][r["skey"]] = r["quota"]
    # By its definition: each node sorts all its draws and cuts them in the middle.
    nodes = {0: rows}
    for level in range(3):
        cut = {}
        for node, held in nodes.items():
            held = sorted(held, key=lambda r: hashlib.md5(f"1:{level}:{r[0]}:{r[1]}:{r[2]}".encode()).hexdigest())  # noqa: B023
            half = (len(held) + 1) // 2
            cut |= {2 * node: held[:half], 2 * node + 1: held[half:]}
        nodes = cut
    assert by == {shard: dict(Counter(r[0] for r in held)) for shard, held in nodes.items()}
    assert all(sum(v.values()) == 125 for v in by.values()) and all(10 <= n <= 42 for v in by.values() for n in v.values())
    got = draw_blocks(draws, 8, 1).collect()
    assert sorted((r["skey"], r["block"], r["pass"]) for r in got) == sorted(rows)
    assert Counter((r["shard"], r["skey"]) for r in got) == {(shard, k): n for shard, v in by.items() for k, n in v.items()}
    with pytest.raises(ValueError):
        split_quotas(draws, 6, 1)


def test_shards_change_the_draws_but_not_the_sums(spark):
    rows = [(i, "w " * (i % 9 + 1), f"s{i % 3}") for i in range(900)] + [(5000, "w " * 300_000, "s1")]
    one, eight = (plan_mix(docs(spark, rows), shards=n).collect() for n in (1, 8))
    assert sorted((r["doc_id"], r["taken"]) for r in one) == sorted((r["doc_id"], r["taken"]) for r in eight)
    assert {d["shard"] for r in one for d in r["draws"]} == {0} and {d["shard"] for r in eight for d in r["draws"]} == set(range(8))
    assert all(r["taken"] == r["size"] * len(r["draws"]) for r in eight)


def test_the_mix_has_every_draw(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 3}") for i in range(60)] + [(1, "w w", "s1"), (1, "w w", "s1")]
    table = docs(spark, rows)
    mixed = mix_documents(table)
    assert mixed.columns == [*table.columns, "mix_pass", "mix_shard", "mix_place"]
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].split())
    want = defaultdict(int)
    for r in plan_mix(table).collect():
        want[r["doc_id"]] += r["taken"]
    assert dict(words) == {k: v for k, v in want.items() if v}


def test_many_rows_that_repeat_id_and_size(spark):
    import time

    from folio.llm.mixing import mix_documents

    rows = [(None, None, "en", "a", 0)] * 20_000 + [(i, f"word {i} more", "en", "b", 3) for i in range(50)] + [(7, "same words here", "en", "b", 3)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    began = time.perf_counter()
    mixed = mix_documents(docs)
    kept = mixed.where("doc_id = 7").groupBy("text").count().collect()
    assert {r["text"] for r in kept} == {"word 7 more", "same words here"} and mixed.where("doc_id is null and text is not null").count() == 0
    assert time.perf_counter() - began < 120


def test_blocks_follow_the_size():
    assert [block_count(n) for n in (0, 1, 640_000_000, 640_000_001, 2_000_000_000)] == [64, 64, 64, 128, 256]


@pytest.mark.parametrize("blocks,parts", [(1, 1), (2, 3), (1024, 8)])
def test_sums_are_near_their_targets_with_any_blocks(spark, blocks, parts):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(600)]
    plan = plan_mix(docs(spark, rows), blocks=blocks, parts=parts).collect()
    taken, target = defaultdict(int), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["block"] < blocks and r["taken"] <= 3 * r["size"]
    assert len(plan) == 600 and all(abs(taken[s] - target[s]) <= 7 for s in target)


def test_shards_are_written_in_their_own_order(spark):
    rows = [(i, f"text {i} " + "w " * (i % 9), f"s{i % 3}") for i in range(900)] + [(None, None, None)] * 5
    mixed = materialize(mix_documents(docs(spark, rows), shards=4), "mixed")
    path = shared_path(spark, "shards")
    coalesce, partitions = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = spark.conf.get(partitions)
    spark.conf.set(coalesce, "false")
    spark.conf.set(partitions, "16")
    write_shards(mixed, path)
    spark.conf.unset(coalesce)
    spark.conf.set(partitions, before)
    folders = sorted(p for p in paths_of(spark, path) if "mix_shard=" in p)
    assert [f.rpartition("=")[2] for f in folders] == ["0", "1", "2", "3"]
    for shard, folder in enumerate(folders):
        files = sorted(p for p in paths_of(spark, folder) if p.endswith(".parquet"))
        places = [r["mix_place"] for f in files for r in spark.read.parquet(f).select("mix_place").coalesce(1).collect()]
        want = sorted(r["mix_place"] for r in mixed.where(f"mix_shard = {shard}").select("mix_place").collect())
        assert places == want and len(files) > 1
    write_shards(mixed.limit(0), path + "-empty")
