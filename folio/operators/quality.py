"""Duplicates, rule reports and diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_groups(df: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of equal content: digest, canonical (the smallest key) and copies."""
    return df.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("copies"))


def alias_map(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key`` and canonical of the rows that aren't canonical; a digest that many rows share is split by the adaptive join."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    best = df.groupBy(digest.alias("digest")).agg(F.min(key).alias("canonical"))
    return df.select(key, digest.alias("digest")).join(best, "digest").where(F.col(key) != F.col("canonical")).select(key, "canonical")


def repeated_lines(lines: DataFrame, doc: str, line: str, by: str, least_docs: int = 2, least_share: float = 0.5) -> DataFrame:
    """Lines that at least ``least_docs`` and ``least_share`` of the documents of a group have, counted once a document."""
    once = lines.where(F.col(line) != "").select(by, doc, line).distinct()
    totals = once.groupBy(by).agg(F.countDistinct(doc).alias("with_text"))
    counted = once.groupBy(by, line).agg(F.count(F.lit(1)).alias("docs"))
    return counted.join(totals, by).where((F.col("docs") >= least_docs) & (F.col("docs") >= least_share * F.col("with_text"))).select(by, line, "docs")


def rule_report(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule: failures and the smallest key that fails (null if none), in one pass over ``df``.

    ``rules`` gives the condition that a row must meet; a null condition is a failure.
    """
    failed = [F.struct(F.lit(name).alias("rule"), (~F.coalesce(ok, F.lit(False))).alias("failed")) for name, ok in rules.items()]
    rows = df.select(key, F.explode(F.array(*failed)).alias("r"))
    report = rows.groupBy(F.col("r.rule").alias("rule")).agg(F.count_if("r.failed").alias("failures"), F.min(F.when(F.col("r.failed"), F.col(key))).alias("first_context"))
    return report.withColumn("status", F.when(F.col("failures") > 0, "failed").otherwise("passed"))


def diagnostics(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """A row (key, code) for each check that a row trips."""
    return reduce(DataFrame.unionByName, [df.where(bad).select(key, F.lit(code).alias("code")) for code, bad in checks.items()])
