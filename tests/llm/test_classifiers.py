import math
import re
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from folio.llm import language_id, registry, toxicity
from folio.llm.common import fold_of

MORE = "/root/testdata/sf0.01"


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out_accuracy(spark, data):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    got = registry.op8_language_id(spark, MORE).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) / len(held) > 0.96
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(not r["accepted"] for r in got) < 0.03 * len(got)


def test_language_edges(spark):
    rows = [(i, f"the cat and dog number of things {i} runs fast", "en", 0) for i in range(30)] + [(100 + i, f"der hund und die katze zahl {i} läuft schnell", "de", 0) for i in range(30)]
    rows += [(200, None, "en", 0), (201, "", "en", 0), (202, "123 !!", "en", 0), (None, "der hund und die katze", None, 0), (203, "the cat and dog of things", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.fit_languages(df, F.lit(True))
    got = {r["doc_id"]: r for r in language_id.predict_languages(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3
    assert (got[None]["lang_pred"], got[203]["lang_pred"]) == ("de", "en") and got[203]["accepted"]
    nothing = language_id.fit_languages(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict_languages(df, nothing).collect()} == {"und"}


def test_language_of_very_long_texts(spark, data):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = language_id.fit_languages(docs, ~held_out)
    made = {}
    for r in docs.where(held_out & F.col("lang").isNotNull()).orderBy("doc_id").collect():
        made.setdefault(r["lang"], []).append(r["text"] or "")
    compressors = language_id.Compressors(model)
    for lang, texts in made.items():
        once = " ".join(texts)
        # Another order each time, so that no long stretch comes back.
        whole = " ".join(w for i in range(-(-3_000_000 // len(once))) for w in texts[i % len(texts) :] + texts[: i % len(texts)])
        for size in (100_000, 1_000_000, 3_000_000):
            got, margin, accepted = compressors.predict(whole[:size])
            assert (got, accepted) == (lang, True) and margin > 0.02, (lang, size, got, margin)


def test_toxicity_held_out(spark, data):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    got = registry.op7_toxicity(spark, MORE).collect()
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)) > 0.9
    assert sum(s >= 0.7 for s in neg) <= 0.02 * len(neg)


def test_toxicity_finds_the_sentence(spark):
    clean = "This is fine. All of it is good and calm. Nothing more to say."
    rows = [(i, clean + (" You are a grolm." if i % 3 == 0 else ""), "x") for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, None, "x"), (900, "", "x"), (901, "Ä" * 10 + ". İ grolms here.", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, fold_of(F.col("doc_id"), 3) != 1)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 3 == 0) for i in range(300))
    where = got[3]["offending"][0]
    assert rows[3][1][where["start"] : where["start"] + where["length"]].strip() == "You are a grolm."
    assert got[None]["score"] == got[900]["score"] == 0.0
    empty = toxicity.fit_toxicity(docs, labels.limit(0), F.lit(True))
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(docs, empty).collect())


def test_toxicity_does_not_grow_with_length(spark, data):
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    scorer = toxicity.Scorer(toxicity.fit_toxicity(docs, labels, ~held_out))
    scored = [(*scorer.score(r["text"]), r["text"], r["toxic"]) for r in docs.where(held_out).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").orderBy("doc_id").collect()]
    clean = "\n".join(text for score, _, text, toxic in scored if toxic == 0 and score < 0.1)
    bad = next(text for score, _, text, toxic in scored if toxic == 1 and score > 0.95)
    sentences = [clean[a:b] for a, b in toxicity._sentences(clean)]
    for n in (2000, 6000, 20_000):
        assert scorer.score("Zq xv. " * n)[0] <= toxicity.LEAK
        long = "\n".join((sentences * -(-n // len(sentences)))[:n])
        assert scorer.score(long)[0] < scorer.model.threshold, n
        assert scorer.score(long + "\n" + bad)[0] >= scorer.model.threshold


def test_language_sizes_by_plain_calls(spark, data):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    model = language_id.fit_languages(docs, fold_of(F.col("doc_id"), 5) != 0)
    rows = docs.select("doc_id", "text").orderBy("doc_id").limit(300)
    got = {r["doc_id"]: r for r in language_id.predict_languages(rows, model).collect()}
    for r in rows.collect():
        content = " ".join(re.findall(r"[^\W\d_]+", (r["text"] or "").lower())).encode()
        if not content or not (r["text"] or "").isascii():
            continue
        sizes = []
        for _, words in model.dictionaries:
            held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            parts = range(0, len(content), language_id.SEGMENT)
            sizes.append(sum(len(zstandard.ZstdCompressor(level=6, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(content[i : i + language_id.SEGMENT])) for i in parts))
        first, second = sorted(sizes)[:2]
        best = got[r["doc_id"]]
        assert best["lang_pred"] == model.dictionaries[sizes.index(first)][0] and math.isclose(best["score"], 1 - first / second, abs_tol=1e-12)


def test_language_ties_repeats_and_the_bytes_sent(spark):
    rows = [(i, f"one two three four {i}", "aa") for i in range(5)] * 2 + [(i, f"one two three four {i}", "bb") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(docs, F.lit(True))
    assert [lang for lang, _ in model.dictionaries] == ["aa", "bb"]
    # Repeats of "aa" come next to each other, so both dictionaries give the same sizes; the one with more rows wins.
    got = language_id.predict_languages(docs, language_id.LanguageModel((("aa", b"one two three"), ("bb", b"one two three")), 6, 0.005)).collect()
    assert len(got) == 15 and {(r["lang_pred"], r["score"], r["accepted"]) for r in got} == {("aa", 0.0, False)}
    long = spark.createDataFrame([(i, f"{i:04d} " + "word " * 200, "aa") for i in range(60)] + [(99, "long " * 40_000, "cc")], "doc_id long, text string, lang string")
    by = dict(language_id.fit_languages(long, F.lit(True), dictionary_bytes=5000).dictionaries)
    assert 3000 < len(by["aa"]) <= 5000 and len(by["cc"]) > 5000
    assert language_id.predict_languages(docs.limit(0), model).count() == 0


def test_toxicity_by_noisy_or(spark, data):
    docs, labels = spark.read.parquet(f"{MORE}/documents.parquet"), spark.read.parquet(f"{MORE}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, fold_of(F.col("doc_id"), 3) != 1)
    rows = docs.select("doc_id", "text").orderBy("doc_id").limit(400)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(rows, model).collect()}
    at_bias, seen = 1 / (1 + math.exp(-model.bias)), 0
    for r in rows.collect():
        text = (r["text"] or "").lower()
        sentences = [x for x in re.findall(r"[^.!?\n]+[.!?]*", text) if x.strip()]
        clean = 1 - toxicity.LEAK * len(sentences) / (len(sentences) + 1)
        for x in sentences:
            found = {f for w in re.findall(r"[^\W\d_]+", x) for f in toxicity.features_of(w)}
            p = 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in found))))
            clean *= min(1.0, (1 - p) / (1 - at_bias))
            seen += p > 0.5
        assert math.isclose(got[r["doc_id"]]["score"], 1 - clean, abs_tol=1e-9)
    assert seen == sum(len(r["offending"]) for r in got.values()) > 0


def test_toxicity_bound_of_entries_repeats_and_empty_tables(spark):
    assert toxicity.fitting([(1, 5), (2, 9), (3, 4)], 18) is None and toxicity.fitting([(1, 5), (2, 9), (3, 4)], 10) == [1, 3]
    rows = [(i, "All is good. " + ("You are a grolm. " * 3 if i % 3 == 0 else "")) for i in range(90)]
    docs = spark.createDataFrame([*rows, *rows[:30], (91, "grolm. " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(91, 1)], "doc_id long, toxic int")
    whole, bound = (toxicity.fit_toxicity(docs, labels, F.lit(True), most_entries=n) for n in (20_000_000, 5000))
    for model in (whole, bound):
        got = toxicity.score_toxicity(docs, model).collect()
        assert len(got) == 121 and all(r["predicted"] == int(r["doc_id"] % 3 == 0 or r["doc_id"] == 91) for r in got)
    again = toxicity.fit_toxicity(docs.repartition(5), labels, F.lit(True))
    assert again.weights == whole.weights and again.bias == whole.bias
    named = toxicity.fit_toxicity(*(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")) for df in (docs, labels)), F.lit(True), most_entries=5000)
    assert named.weights
    none = toxicity.fit_toxicity(docs.limit(0), labels, F.lit(True))
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_toxicity_training_descends(spark):
    rng = np.random.default_rng(7)
    bags = [[sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(rng.integers(0, 4))] for _ in range(200)]
    labels = np.array([int(any(0 in s for s in bag)) for bag in bags])
    w, b = toxicity.train(labels, bags, 6)
    score = [1 - math.prod(min(1.0, (1 + math.exp(b)) / (1 + math.exp(b + sum(w[i] for i in s)))) for s in bag) for bag in bags]
    assert all((p > 0.5) == bool(y) for p, y in zip(score, labels, strict=True)) and w.argmax() == 0
