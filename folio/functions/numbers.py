"""Form numbers: lenient parsing, formats, masks, page-label numerals, arithmetic expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def parse_number(text: Column) -> Column:
    """Digits with their decimal mark, the last of ``.`` and ``,`` unless it sets off thousands; ``-`` or ``()`` negate; else null."""
    digits = F.regexp_replace(text, "[^0-9.,]", "")
    last = F.regexp_extract(digits, r"([.,])[^.,]*$", 1)
    tail = F.regexp_extract(digits, r"[.,]([^.,]*)$", 1)
    both = digits.contains(".") & digits.contains(",")
    single = F.regexp_count(digits, F.lit(r"\.")) == 1
    decimal = both | (F.length(tail) != 3) | (single & (last == "."))
    plain = F.regexp_replace(digits, "[.,]", "")
    fraction = F.concat(F.regexp_replace(F.regexp_replace(digits, r"[.,][^.,]*$", ""), "[.,]", ""), F.lit("."), tail)
    value = F.when((last != "") & decimal, fraction).otherwise(plain).try_cast("double")
    negative = text.contains("-") | (text.contains("(") & text.contains(")"))
    return F.when(negative, -value).otherwise(value)


def format_number(value: Column, decimals: int, separators: int = 0, negatives: int = 0, currency: str = "", currency_first: bool = True) -> Column:
    """``separators`` 0 ``1,234.5``, 1 ``1234.5``, 2 ``1.234,5``, 3 ``1234,5``; ``negatives`` from 2 in parentheses; halves round away from zero."""
    places = max(0, min(10, decimals))
    rounded = F.round(F.abs(value).cast("decimal(38,12)"), places)
    text = F.format_number(rounded, places)
    if separators in (1, 3):
        text = F.replace(text, F.lit(","), F.lit(""))
    if separators >= 2:
        text = F.translate(text, ",.", ".,")
    text = F.concat(F.lit(currency), text) if currency_first else F.concat(text, F.lit(currency))
    below = F.concat(F.lit("("), text, F.lit(")")) if negatives >= 2 else F.concat(F.lit("-"), text)
    return F.when((value >= 0) | (rounded == 0), text).otherwise(below)


def format_percent(value: Column, decimals: int, separators: int = 0) -> Column:
    return F.concat(format_number(value * 100, decimals, separators), F.lit("%"))


def mask(text: Column, kind: str) -> Column:
    """``zip``, ``zip4``, ``phone`` or ``ssn`` for a text with the right number of digits; others stay as they are."""
    size, pattern, shape = {"zip": (5, r"(\d{5})", "$1"), "zip4": (9, r"(\d{5})(\d{4})", "$1-$2"), "phone": (10, r"(\d{3})(\d{3})(\d{4})", r"($1) $2-$3"), "ssn": (9, r"(\d{3})(\d{2})(\d{4})", "$1-$2-$3")}[kind]
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(F.length(digits) == size, F.regexp_replace(digits, pattern, shape)).otherwise(text)


def roman(number: Column, most: int | None = 100_000) -> Column:
    """Small Roman numerals from 1 to ``most`` (None: without end), decimals beyond."""
    out, rest = F.lit(""), number
    for value, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), (rest / value).cast("int")))
        rest = rest % value
    return F.when((number >= 1) & (F.lit(True) if most is None else number <= most), out).otherwise(number.cast("string"))


def letters(number: Column) -> Column:
    """a to z, then aa to zz, a letter as often as the round, up to 100 rounds; decimals beyond."""
    rounds = ((number - 1) / 26).cast("int") + 1
    letter = F.chr(F.lit(97) + (number - 1) % 26)
    return F.when((number >= 1) & (rounds <= 100), F.repeat(letter, rounds)).otherwise(number.cast("string"))


def label(number: Column, style: str | None, prefix: str = "", most_roman: int | None = 100_000) -> Column:
    """A page label: D decimal, R/r Roman up to ``most_roman``, A/a letters, none: the prefix alone."""
    body = {"D": number.cast("string"), "r": roman(number, most_roman), "R": F.upper(roman(number, most_roman)), "a": letters(number), "A": F.upper(letters(number)), None: F.lit("")}[style]
    return F.concat(F.lit(prefix), body)


def range_message(value: Column, low: float | None, high: float | None) -> Column:
    """Null where the value lies within the bounds, otherwise what it must be."""
    if low is not None and high is not None:
        return F.when(~value.between(low, high), F.lit(f"between {low:g} and {high:g}"))
    if low is not None:
        return F.when(value < low, F.lit(f"at least {low:g}"))
    if high is not None:
        return F.when(value > high, F.lit(f"at most {high:g}"))
    return F.lit(None).cast("string")


def evaluate(expression: str, fields: dict[str, str]) -> Column:
    """Sums, products, quotients, signs and parentheses over named fields, as a SQL expression over columns.

    ``fields`` gives a column for each name; a backslash joins a character to a name. Missing values count as 0;
    a division by zero and results that aren't finite numbers are null.
    """
    name = re.compile(r"(?:\\.|[^\W\d])(?:\\.|[\w.])*")
    body = name.sub(lambda m: f"coalesce(double(`{fields[re.sub(chr(92) * 2 + '(.)', chr(92) + '1', m[0])]}`), 0D)", expression)
    outside = name.sub("", expression)
    if re.search(r"[^\d.\s+\-*/()]", outside):
        raise ValueError(f"not an arithmetic expression: {expression!r}")
    body = re.sub(r"(?<![\w.`])(\d+(?:\.\d*)?|\.\d+)(?![\w`])", r"\1D", body)
    result = F.expr(_guarded(body))
    return F.when(~F.isnan(result) & (F.abs(result) < F.lit(float("inf"))), result)


def _guarded(body: str) -> str:
    """Divisions by what may be zero as try_divide, innermost operands being names, numbers or parenthesised parts."""
    part = r"(coalesce\(double\(`[^`]*`\), 0D\)|[\d.]+D|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))"
    return re.sub(rf"/\s*{part}", r"/ nullif(\1, 0D)", body)
