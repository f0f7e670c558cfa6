"""A corpus from documents: without toxic texts, in known languages, once each, free of benchmark items, mixed by source.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each stage's
result in the shared folder and reads it again, so a lost executor costs no more than the stage at hand.

Null and empty texts are not toxic, but have no language and go with the second stage; so do texts without a letter.
Rows with a null doc_id stay like others. Of rows that repeat id and text one stays, of copies under several ids the
smallest id. A null source is a source of its own. Empty tables give empty results, without labels nothing is
toxic, and without known languages every document goes. Other columns of documents come along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import clear, fold_of, materialize, table
from folio.llm.decontaminate import decontaminate
from folio.llm.jaccard import keep_one
from folio.llm.language_id import fit_languages, predict_languages
from folio.llm.mixing import mix_documents
from folio.llm.toxicity import fit_toxicity, score_toxicity


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], new: tuple[str, ...], condition: str) -> DataFrame:
    """The rows of ``docs`` whose judgement meets a condition; columns that have the names of a judgement's step aside meanwhile."""
    aside = [f"_aside_{i}" if n in new else n for i, n in enumerate(docs.columns)]
    return judge(docs.toDF(*aside)).where(condition).select(*aside).toDF(*docs.columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on two thirds of the labelled ones, doesn't predict to be toxic."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 3) != 1)
    return _kept(docs, lambda df: score_toxicity(df, model), ("score", "predicted", "offending"), "predicted = 0")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells, by dictionaries from four fifths of the documents."""
    model = fit_languages(docs, fold_of(F.col("doc_id"), 5) != 0)
    return _kept(docs, lambda df: predict_languages(df, model), ("lang_pred", "score", "accepted"), "accepted")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that shares four fifths of its five-word shingles."""
    return keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item with tiles of five words or more."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix draws, with its pass, output shard and place in the shard."""
    return mix_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("language ID", keep_languages),
    ("n-gram Jaccard join", remove_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources to target weights", mix_sources),
]

#: Trained models decide in the first stages, which SQL can't express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
        clear(spark, keep=[docs])
    return docs
