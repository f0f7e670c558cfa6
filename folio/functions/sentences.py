"""Sentences of a text: an Arrow function, as abbreviations and headings need the words around a mark."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words whose period ends no sentence, and the lengths of headings and of the longest sentence.
ABBREVIATIONS = "mr mrs ms dr prof st vs etc e.g i.e fig no vol p pp inc ltd jr sr a.m p.m approx dept est".split()
LONGEST_HEADING, LONGEST = 40, 300

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())]))

_BREAK = re.compile(r"[.!?](?=\s|$)|\n")
_SPACE = re.compile(r"\s*")
_SILENT = re.compile(r"[^ \r\n\t.,;:!?\-—…\"'()\[\]]")


def _ends(text: str, at: int, start: int) -> bool:
    """Whether the mark at ``at`` ends the sentence that began at ``start``."""
    if text[at] == "\n":
        if at <= start:
            return False
        if text[at + 1 : at + 2] in ("\n", "\r"):
            return True
        line = text[start:at].rstrip()
        follows = text[at + 1 :].lstrip()[:1]
        return 0 < len(line) <= LONGEST_HEADING and "\n" not in line and "\r" not in line and line[-1].isalnum() and (follows.isupper() or follows.isdigit())
    if text[at] != ".":
        return True
    word = text[:at].rsplit(None, 1)[-1:] if not text[at - 1 : at].isspace() else []
    bare = word[0].lstrip("([\"'“") if word else ""
    return not (bare.lower() in ABBREVIATIONS or (len(bare) == 1 and bare.isupper()))


def spans(text: str | None) -> list[dict[str, int]]:
    """Start and length of each sentence; marks alone are none, and long ones break at a comma, semicolon or space."""
    text = text or ""
    out, start = [], _SPACE.match(text).end()

    def add(a: int, b: int) -> None:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        piece = piece.strip()
        if _SILENT.search(piece):
            out.append({"start": a, "length": len(piece)})

    def long_breaks(upto: int) -> None:
        nonlocal start
        while upto - start > LONGEST:
            start += len(text[start:]) - len(text[start:].lstrip()) if text[start : start + 1].isspace() else 0
            found = re.compile("[,; ]").search(text, start + LONGEST - 1, upto)
            if not found:
                return
            add(start, found.end())
            start = found.end()

    for mark in _BREAK.finditer(text):
        at = mark.start()
        long_breaks(at)
        window = text[max(0, at - 64) : at + 512] if at > 64 else text[: at + 512]
        offset = max(0, at - 64) if at > 64 else 0
        if at >= start and _ends(window, at - offset, max(0, start - offset)):
            add(start, at + 1)
            start = _SPACE.match(text, at + 1).end()
    long_breaks(len(text))
    add(start, len(text))
    return out


@F.pandas_udf(SPANS)
def sentence_spans(texts: pd.Series) -> pd.Series:
    return texts.map(spans)


def sentences(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each sentence: key, ordinal, start (0-based), length and the sentence, ready to be spoken."""
    rows = docs.select(key, text, F.posexplode(sentence_spans(F.col(text))).alias("ordinal", "span"))
    piece = F.substring(F.col(text), F.col("span.start") + 1, F.col("span.length"))
    return rows.select(key, "ordinal", F.col("span.start").alias("start"), F.col("span.length").alias("length"), to_speech(piece).alias("sentence"))


def to_speech(sentence: Column) -> Column:
    """Words that a line's end hyphenated are joined, white space and control characters collapse to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(sentence, r"-[\r\n]+", ""), r"[\s\p{Cntrl}]+", " "))
