"""Search over documents, lines and folders of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.positions import match_places


def match_count(text: Column, query: str, whole_word: bool = False, **folding: bool) -> Column:
    """The number of matches of ``query`` in a text, from left to right; 0 for a query of white space alone."""
    pattern = T.pattern_of(T.fold_query(query, **folding), whole_word)
    return F.lit(0) if pattern is None else F.regexp_count(T.fold(text, **folding), F.lit(pattern))


def count_matches(docs: DataFrame, query: str, text: str = "text", whole_word: bool = False, overlapping: bool = False, **folding: bool) -> DataFrame:
    """Add ``matches``, the number of matches of ``query`` in column ``text``; rows without one are left out.

    ``folding`` are the options of ``fold``. Matches go from left to right and don't overlap unless asked. A query
    without anything but white space matches nothing. Nothing is shuffled.
    """
    pattern = T.pattern_of(T.fold_query(query, **folding), whole_word)
    if pattern is None:
        return docs.withColumn("matches", F.lit(0)).where(F.lit(False))
    if overlapping:
        pattern = f"(?=({pattern}))"
    return docs.withColumn("matches", F.regexp_count(T.fold(F.col(text), **folding), F.lit(pattern))).where("matches > 0")


def match_starts(docs: DataFrame, query: str, key: str, text: str = "text", whole_word: bool = False, overlapping: bool = False, **folding: bool) -> DataFrame:
    """A row for each match: ``key``, ordinal, start and length in the folded text, source_start and source_length in the text itself.

    Starts count code points from 1. Matches are found and mapped back within their row, so nothing is shuffled, and rows
    that repeat a key stay apart. Null texts and empty queries match nothing.
    """
    places = match_places(F.col(text), query, whole_word, overlapping, **folding)
    found = docs.select(key, F.posexplode(places).alias("ordinal", "place"))
    return found.select(key, (F.col("ordinal") + 1).alias("ordinal"), "place.*")


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str, phrase_key: str, text: str = "text", most_short: int = 1000) -> DataFrame:
    """Pairs of ``key`` and ``phrase_key`` whose text holds the whole phrase; both tables have the column ``text``.

    A word inside a phrase is a whole word of every text that holds the phrase, so a phrase meets texts on that of
    its inner words which the fewest texts have. Phrases of one or two words may begin and end within words: up to
    ``most_short`` of them, which is checked, are looked for in every text. Null texts and phrases match nothing.
    """
    words = lambda c: F.split(c, r"\s+")
    items = phrases.where(F.col(text).isNotNull()).select(phrase_key, F.col(text).alias("phrase"), words(F.col(text)).alias("_words"))
    short = items.where(F.size("_words") < 3).select(phrase_key, "phrase").limit(most_short + 1).collect()
    if len(short) > most_short:
        raise ValueError(f"more than {most_short} phrases of one or two words")
    inner = items.where(F.size("_words") >= 3).select(phrase_key, "phrase", F.explode(F.array_distinct(F.slice("_words", 2, F.size("_words") - 2))).alias("word"))
    seen = docs.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("word")).join(inner.select("word").distinct(), "word", "left_semi")
    counted = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = inner.join(counted, "word").groupBy(phrase_key, "phrase").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    met = seen.join(rarest, "word").select(key, phrase_key, "phrase").distinct()
    out = met.join(docs.select(key, F.col(text).alias("_text")), key).where(F.contains("_text", "phrase")).select(key, phrase_key)
    if short:
        known = F.array(*[F.struct(F.lit(r[phrase_key]).alias("id"), F.lit(r["phrase"]).alias("phrase")) for r in short])
        held = docs.select(key, F.explode(F.filter(known, lambda p: F.contains(F.col(text), p["phrase"]))).alias("p"))
        out = out.unionByName(held.select(key, F.col("p.id").alias(phrase_key)))
    return out


def first_snippets(docs: DataFrame, query: str, key: str, text: str = "text", around: int = 50) -> DataFrame:
    """``key`` and the snippet around the first match, case ignored; the match is placed in the text itself."""
    start = T.first_place(F.col(text), query)
    return docs.where(start > 0).select(key, T.snippet(F.col(text), start, len(query), around).alias("snippet"))


def limited_matches(docs: DataFrame, query: str, key: str, most: int, **folding: bool) -> DataFrame:
    """Documents with at most ``most`` counted matches and whether there were more."""
    found = count_matches(docs, query, **folding)
    return found.select(key, F.least("matches", F.lit(most)).alias("shown"), (F.col("matches") > most).alias("truncated"))


def keyword_filter(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows in which each word of ``query`` occurs in at least one of ``columns``, case and accents ignored."""
    folded = [T.fold(F.coalesce(F.col(c), F.lit("")), ignore_diacritics=True) for c in columns]
    for word in T.fold_query(query, ignore_diacritics=True).split():
        any_of = F.lit(False)
        for c in folded:
            any_of = any_of | c.contains(word)
        df = df.where(any_of)
    return df


def line_values(text: Column, of: Callable[[Column], Column], keep: Callable[[Column], Column]) -> Column:
    """An array of (line, n) for the lines of a text, 0-based, whose value ``of(line)`` meets ``keep``; null for a null text.

    Lines stay in their row, so nothing is shuffled and rows that repeat a key stay apart.
    """
    valued = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.cast("long").alias("line"), of(x).alias("n")))
    return F.filter(valued, lambda v: keep(v["n"]))


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each line: ``key``, line (0-based) and its text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "line_text"))


def wrap_from(df: DataFrame, position: str, start: int, size: int) -> DataFrame:
    """Add ``wrapped``: the order that begins at ``start`` and goes on from 0 after the last position."""
    return df.withColumn("wrapped", F.pmod(F.col(position) - F.lit(start), F.lit(size)))


def folder_documents(spark, path: str, pattern: str = "*", recursive: bool = True, most: int = 10_000) -> DataFrame:
    """Files below a folder, hidden ones left out, by lower-cased name, at most ``most``: path, length, modificationTime, content."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).where(~F.col("path").rlike(r"/\.[^/]*$")).orderBy(F.lower("path")).limit(most)
