"""Where a search in folded text finds its matches in the text itself.

Folding keeps or drops each character, so an array of the kept ones' places maps folded places back. It is made for a
row at a time, as an array of numpy, in Arrow batches; nothing leaves the row, and nothing is shuffled.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _base_letters, _compatibility, fold_query, pattern_of

#: The places are code points from 1; the length in the text ends with the last matched character, without marks behind it.
PLACES = "array<struct<start: int, length: int, source_start: int, source_length: int>>"
DROPPED = 0xFFFFFFFF


@functools.lru_cache(maxsize=8)
def fold_table(match_case: bool = False, ignore_diacritics: bool = False, compatibility: bool = False) -> np.ndarray:
    """What each code point becomes: one code point, or ``DROPPED``."""
    out = np.arange(0x110000, dtype="<u4")
    base, plain = _base_letters() if ignore_diacritics else {}, {k: ord(v) for k, v in _compatibility().items()} if compatibility else {}
    for c in range(0x110000):
        x = chr(c)
        if ignore_diacritics and unicodedata.category(x) == "Mn":
            out[c] = DROPPED
            continue
        x = base.get(c, x)
        x = chr(plain.get(ord(x), ord(x)))
        small = x if match_case else x.lower()
        out[c] = ord(small if len(small) == 1 else x)
    return out


def folded_with_map(text: str, table: np.ndarray) -> tuple[str, np.ndarray]:
    """The folded text, and for each of its characters the place (from 0) of the character that it comes from."""
    folded = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    kept = np.flatnonzero(folded != DROPPED)
    return folded[kept].tobytes().decode("utf-32-le", "surrogatepass"), kept


def places_in(text: str, pattern: regex.Pattern, table: np.ndarray, overlapping: bool = False) -> list[tuple[int, int, int, int]]:
    folded, kept = folded_with_map(text, table)
    spans = [m.span() for m in pattern.finditer(folded, overlapped=overlapping)]
    return [(i + 1, j - i, int(kept[i]) + 1, int(kept[j - 1] - kept[i]) + 1) for i, j in spans]


def match_places(text: Column, query: str, whole_word: bool = False, overlapping: bool = False, **folding: bool) -> Column:
    """The matches of ``query`` in ``text``, in order: places and lengths in the folded text and in the text itself.

    An empty array where nothing matches, where the text is null and where nothing is left of the query.
    """
    pattern = pattern_of(fold_query(query, **folding), whole_word)
    if pattern is None:
        return F.array().cast(PLACES)

    def find(texts: pd.Series) -> pd.Series:
        compiled, table = regex.compile(pattern), fold_table(**folding)
        return pd.Series([places_in(t, compiled, table, overlapping) if t else [] for t in texts])

    return F.pandas_udf(find, PLACES)(text)
