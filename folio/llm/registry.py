"""The queries opN_<name> and their SQL, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, html_extract, jaccard, language_id, lm_score, merkle, mixing, oracle, topk, toxicity, url_filter, warc
from .common import fold_of, shared_path, table

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 10) == 0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("node", "component", "text_key")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("via")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 3)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), fold != 1)
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted", "offending")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 5)
    model = language_id.fit_languages(docs, fold != 0)
    found = language_id.predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "block", F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).drop("n_regions")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = bpe.decode_documents(encoded, vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A null text stays null, so its digest stays as well.
    tampered = F.when(fold_of(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    held = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return held.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_warc": op3_warc,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_topk": op6_topk,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_html_extraction": op10_html_extraction,
    "op11_source_divergence": op11_source_divergence,
    "op12_bpe": op12_bpe,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": oracle.OP2,
    "op3_warc": oracle.OP3,
    "op4_url_filters": oracle.OP4,
    "op6_topk": oracle.OP6,
    "op9_mixing": oracle.OP9,
    "op11_source_divergence": oracle.OP11,
    "op13_merkle": oracle.OP13,
}
