import re
import zlib
from collections import Counter

import corpus_pipeline as c

from folio.llm import decontaminate, jaccard, language_id, toxicity
from folio.llm.common import fold_of, materialize


def test_stages(spark, data):
    assert [n for n, _ in c.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    made = [docs]
    for n, (_, stage) in enumerate(c.STAGES):
        made.append(materialize(stage(spark, made[-1], data), f"test-{n}"))
    assert all(m.columns == docs.columns for m in made[:5])
    labels = spark.read.parquet(f"{data}/labels.parquet")
    from pyspark.sql import functions as F

    model = toxicity.fit_toxicity(docs, labels, fold_of(F.col("doc_id"), 3) != 1)
    scorer = toxicity.Scorer(model)
    assert ids(made[1]) == {r["doc_id"] for r in docs.collect() if scorer.score(r["text"])[0] < 0.7}
    known = language_id.Compressors(language_id.fit_languages(made[1], fold_of(F.col("doc_id"), 5) != 0))
    assert ids(made[2]) == {r["doc_id"] for r in made[1].collect() if known.predict(r["text"])[2]}
    groups = jaccard.near_duplicates(made[2]).collect()
    assert ids(made[3]) == {r["component_id"] for r in groups}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bench = decontaminate.Benchmark(items, 5)
    assert ids(made[4]) == {r["doc_id"] for r in made[3].collect() if all(sum(t[2] for t in tiles) < 0.6 * n for _, n, tiles in bench.hits(r["text"]))}
    taken = Counter(r["doc_id"] for r in made[5].select("doc_id").collect())
    assert set(taken) <= ids(made[4]) and max(taken.values()) <= 3
    size = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect())
    assert abs(size(made[5]) - size(made[4])) <= 0.02 * size(made[4])
    assert zlib.crc32(b"") == 0


def test_edges_and_folders(spark, data, tmp_path):
    import glob

    from folio.llm.common import clear, shared_dir

    clear(spark)
    real = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{data}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(60).collect()]
    rows = [*real, (None, real[0][1], None, None), (None, None, None, None), (9001, "", "en", "x"), (9002, "½ ² 12", None, "x"), (real[5][0], real[5][1], "zz", None), (9003, real[7][1] * 40, None, None)]
    wide = spark.createDataFrame([(*r, 7, "clash", 1.0) for r in rows], "doc_id long, text string, lang string, source string, score int, predicted string, size double")
    for name, docs, labels in (("a", wide, f"{data}/labels.parquet"), ("b", wide.limit(0), None)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        known = spark.read.parquet(labels) if labels else spark.createDataFrame([], "doc_id long, quality int, toxic int")
        known.write.parquet(f"{folder}/labels.parquet")
        spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        made = c.run(spark, folder)
        assert made.columns == [*docs.columns, "mix_pass", "mix_shard", "mix_place"]
        got = made.collect()
        assert {r["predicted"] for r in got} <= {"clash"} and not {9001, 9002} & {r["doc_id"] for r in got} and (got or name == "b")
        # Only the last stage's table is left.
        assert len(glob.glob(shared_dir(spark).removeprefix("file:").replace("//", "/") + "/folio-*")) == 1
        clear(spark)
        assert not glob.glob(shared_dir(spark).removeprefix("file:").replace("//", "/") + "/folio-*")
