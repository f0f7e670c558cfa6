"""Dates of documents and forms as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date and time formats that forms name by number.
INDEXED_DATE_FORMATS = ["m/d", "m/d/yy", "mm/dd/yy", "mm/yy", "d-mmm", "d-mmm-yy", "dd-mmm-yy", "yy-mm-dd", "mmm-yy", "mmmm-yy", "mmm d, yyyy", "mmmm d, yyyy", "m/d/yy h:MM tt", "m/d/yy HH:MM"]
INDEXED_TIME_FORMATS = ["HH:MM", "h:MM tt", "HH:MM:ss", "h:MM:ss tt"]
# Times that any form takes, whatever its format.
COMMON_TIME_FORMATS = ["HH:MM", "H:MM", "h:MM tt", "HH:MM:ss", "H:MM:ss", "h:MM:ss tt"]


def date_pattern(form: str) -> str:
    """A form's date format (m is a month, M a minute, tt the half of the day) as a pattern of Spark's."""
    out, at = [], 0
    while at < len(form):
        c = form[at]
        run = len(form[at:]) - len(form[at:].lstrip(c))
        if c == "m":
            out.append("M" * min(run, 4))
        elif c == "M":
            out.append("m" * min(run, 2))
        elif c == "t":
            out.append("a")
        elif c in "dyHhs":
            out.append(c * run)
        elif c == "'":
            out.append("''" * run)
        elif c.isalpha():
            out.append("'" + c * run + "'")
        else:
            out.append(c * run)
        at += run
    return "".join(out)


def format_date(value: Column, form: str) -> Column:
    return F.date_format(value, date_pattern(form))


def indexed_format(index: int, time: bool = False) -> str:
    known = INDEXED_TIME_FORMATS if time else INDEXED_DATE_FORMATS
    return known[index] if 0 <= index < len(known) else known[0]


def parse_date(text: Column, form: str) -> Column:
    """By the form's format, then by common ones; null if none fits."""
    known = [date_pattern(form), "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy"]
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(p)) for p in known])


def parse_time(text: Column, form: str) -> Column:
    """The time of day in seconds, by the form's format, then by common ones; null if none fits.

    White space doesn't count, nor the case of the half of the day. A format that names a date takes its time only.
    """
    bare = F.upper(F.regexp_replace(text, r"\s+", ""))
    known = [date_pattern(f).replace(" ", "") for f in (form, *COMMON_TIME_FORMATS)]
    at = F.coalesce(*[F.try_to_timestamp(bare, F.lit(p)) for p in dict.fromkeys(known)])
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def parse_document_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSSOHH'mm'``: what follows the year is optional, without offset it is UTC; out of range is null."""
    shape = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(\d{2})?'?)?.*$"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(text, shape, i), F.lit("")), F.lit(default))
    stamp = F.try_to_timestamp(F.concat(part(1, ""), part(2, "01"), part(3, "01"), part(4, "00"), part(5, "00"), part(6, "00")), F.lit("yyyyMMddHHmmss"))
    minutes = part(9, "00").try_cast("bigint") * 60 + part(10, "00").try_cast("bigint")
    sign = F.when(part(8, "+") == "-", F.lit(-1)).otherwise(F.lit(1))
    return F.timestamp_micros(F.unix_micros(stamp) - sign * minutes * 60_000_000)


def format_document_date(value: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(value, "yyyyMMddHHmmss"), F.lit("+00'00'"))
