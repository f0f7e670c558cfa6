"""Text functions as columns: folding, search patterns, snippets, line predicates, keys."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for Java's regular expressions, without brackets.
SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, digits, the underscore and the marks that stay within words.
WORD = r"\p{L}\p{N}_\p{Mn}\p{Mc}"

# The ranges that compatibility folding maps, the words that open captions, and line marks.
SPACES = [0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
SINGLE_QUOTES = range(0x2018, 0x201C)
DOUBLE_QUOTES = range(0x201C, 0x2020)
DASHES = [*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63, 0xFF0D]
FULL_WIDTH = range(0xFF01, 0xFF5F)
CAPTION_WORDS = ["figure", "fig.", "table", "chart", "listing", "plate", "exhibit"]
BULLETS = "•◦▪▫‣⁃∙●○■□–—-*➢►▶✓✔"
FOOTNOTE_MARKS = "*†‡§¶¹²³⁰⁴⁵⁶⁷⁸⁹"
PAGE_NUMBER_FORMS = ["#", "page #", "page # of #", "# of #", "# / #", "#/#", "p. #", "p #", "- # -", "– # –", "— # —", "[#]", "(#)"]


def _compatibility() -> dict[int, str]:
    out = {c: chr(c - 0xFEE0) for c in FULL_WIDTH}
    out |= dict.fromkeys(SPACES, " ") | dict.fromkeys(SINGLE_QUOTES, "'") | dict.fromkeys(DOUBLE_QUOTES, '"') | dict.fromkeys(DASHES, "-")
    return out


def _base_letters() -> dict[int, str]:
    """Letters that canonical decomposition splits into one letter and marks."""
    out = {}
    for c in (*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x400, 0x500), *range(0x1E00, 0x2000)):
        first, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            out[c] = first
    return out


def _translate(column: Column, table: dict[int, str]) -> Column:
    return F.translate(column, "".join(map(chr, table)), "".join(table.values()))


def fold(column: Column, match_case: bool = False, ignore_diacritics: bool = False, compatibility: bool = False) -> Column:
    """Diacritics, then compatibility variants, then case; query and text are folded alike."""
    if ignore_diacritics:
        column = _translate(F.regexp_replace(column, r"\p{Mn}", ""), _base_letters())
    if compatibility:
        column = _translate(column, _compatibility())
    return column if match_case else F.lower(column)


def fold_query(query: str, match_case: bool = False, ignore_diacritics: bool = False, compatibility: bool = False) -> str:
    if ignore_diacritics:
        query = "".join(c for c in query if unicodedata.category(c) != "Mn").translate(_base_letters())
    if compatibility:
        query = query.translate(_compatibility())
    return query if match_case else query.lower()


def pattern_of(query: str, whole_word: bool = False) -> str | None:
    """A Java pattern for a folded query: a run of white space matches any run; None if nothing is left of it.

    With ``whole_word`` a neighbour must not be a word character, where the query's own edge is one.
    """
    words = query.split()
    if not words:
        return None
    pattern = f"[{SPACE}]+".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
    if whole_word:
        is_word = lambda c: c == "_" or unicodedata.category(c)[0] in "LN" or unicodedata.category(c) in ("Mn", "Mc")
        first, last = words[0][0], words[-1][-1]
        pattern = (f"(?<![{WORD}])" if is_word(first) else "") + pattern + (f"(?![{WORD}])" if is_word(last) else "")
    return pattern


def collapse(column: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.regexp_replace(F.regexp_replace(column, f"[{SPACE}]+", " "), "^ | $", "")


def words(column: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(column, F.lit(f"[{WORD}]+"), F.lit(0))


def line_signature(column: Column) -> Column:
    """Lower case, digits as ``#``, white space collapsed: what repeated headers share."""
    return collapse(F.lower(F.regexp_replace(column, r"\p{Nd}", "#")))


def pagination_key(column: Column) -> Column:
    """Like the signature, with a run of digits as one ``#``."""
    return F.regexp_replace(line_signature(column), "#+", "#")


def is_page_number(column: Column) -> Column:
    """Digits with ``page``, ``of`` and ``/`` around them, or a Roman numeral, of 16 characters at most within ornaments."""
    bare = F.regexp_replace(column, rf"^[{SPACE}\-–—|·•\[\]()]+|[{SPACE}\-–—|·•\[\]()]+$", "")
    body = F.regexp_replace(bare, rf"(?i)^page[{SPACE}]*", "")
    counted = body.rlike(rf"^[0-9/oOfF{SPACE}]+$") & body.rlike("[0-9]")
    return (F.length(bare).between(1, 16)) & (counted | body.rlike("^[ivxlcIVXLC]+$"))


def is_page_number_form(key: Column) -> Column:
    """A pagination key that is one of the forms of page numbers."""
    return key.isin(PAGE_NUMBER_FORMS)


def is_caption(column: Column) -> Column:
    """A caption word followed by a number, or by a capital with a period or colon."""
    options = "|".join(re.escape(w) for w in CAPTION_WORDS)
    return column.rlike(rf"^(?i:{options})[{SPACE}]*(?:[0-9]|[A-Z][.:])")


def starts_item(column: Column) -> Column:
    """A bullet, or up to three digits or one small letter, with a period or parenthesis and a space."""
    marks = BULLETS.replace("-", r"\-")
    return column.rlike(rf"^(?:[{marks}](?: |[^{marks}\p{{L}}\p{{N}}])|\(*(?:[a-z]|[0-9]{{1,3}})[.)] )")


def starts_footnote(column: Column) -> Column:
    return column.rlike(f"^[0-9{FOOTNOTE_MARKS}]")


def ends_sentence(column: Column) -> Column:
    return column.rlike(r"[.?!:]$")


def join_hyphens(column: Column) -> Column:
    """Words that a hyphen broke at a line's end, before a small letter, and soft hyphens at line ends."""
    return F.regexp_replace(F.regexp_replace(column, r"(\p{L})[-\u2010]\r?\n(?=\p{Ll})", "$1"), r"\u00ad\r?\n?", "")


#: An e-mail address: no period at the edges of the local part or doubled in it, a top label of two letters or more.
EMAIL = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"


def emails(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(EMAIL), F.lit(0))


def plain_text(html: Column) -> Column:
    """Markup removed, basic entities decoded, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def first_place(text: Column, query: str) -> Column:
    """Where ``query`` first stands in the text itself (1-based, code points), case ignored; 0 if nowhere or empty.

    Lower-casing the text first may change its length, so the places of a lower-cased text aren't the text's own.
    """
    if not query:
        return F.when(text.isNotNull(), F.lit(0))
    pieces = F.split(text, "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", query), 2)
    return F.when(F.size(pieces) == 2, F.length(pieces[0]) + 1).when(text.isNotNull(), F.lit(0))


def snippet(text: Column, start: Column, length: int, around: int = 50) -> Column:
    """``around`` characters on each side of a match (1-based start), white space collapsed."""
    first = F.greatest(start - around, F.lit(1))
    return collapse(F.substring(text, first, F.lit(length + around) + (start - first)))
