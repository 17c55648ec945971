"""Duration text: parsing variants, formatting, suffixes and placeholders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import col, to_double, to_long

# fixed values: texts that mean "no time"
NO_TIME = ["DQ", "NS", "NT", "SCR", "X", "---", "--", ""]
TIME_PATTERN = r"(?:\d{1,2}:)?\d{1,2}:\d{2}\.\d{2}|\d{1,3}\.\d{2}"
TIME_WITH_SUFFIX = r"^((?:\d{1,2}:)?\d{1,2}:\d{2}\.\d{2}|\d{1,3}\.\d{2})([ \t]*[*!@#A-Za-z()\[\]][^\n]*)?$"


def parse_time(c: Column | str, minutes: str = "float", extra_parts: str = "reject") -> Column:
    """`M:SS.ss` or `SS.ss` to seconds, null when malformed.

    minutes: "float" or "int" text before the colon.
    extra_parts: "reject" splits at the first colon only, "ignore" uses the first two parts of a full split.
    """
    s = F.trim(col(c).cast("string"))
    head = F.substring_index(s, ":", 1)
    tail = F.get(F.split(s, ":"), F.lit(1)) if extra_parts == "ignore" else _after_colon(s)
    mins = to_long(head).cast("double") if minutes == "int" else to_double(head)
    return F.when(F.contains(s, F.lit(":")), mins * 60.0 + to_double(tail)).otherwise(to_double(s))


def _after_colon(s: Column) -> Column:
    return F.substr(s, F.instr(s, ":") + 1)


def parse_time_hms(c: Column | str) -> Column:
    """Up to `H:M:S`; status words and anything without digits are null; other characters are dropped."""
    raw = F.upper(F.trim(col(c).cast("string")))
    parts = F.split(F.regexp_replace(raw, r"[^\d:.]", ""), ":")
    at = lambda i: F.get(parts, F.lit(i))
    sec = (
        F.when(F.size(parts) == 1, to_double(at(0)))
        .when(F.size(parts) == 2, to_long(at(0)) * 60 + to_double(at(1)))
        .when(F.size(parts) == 3, to_long(at(0)) * 3600 + to_long(at(1)) * 60 + to_double(at(2)))
    )
    return F.when(~raw.isin(NO_TIME), sec)


def format_time(c: Column | str) -> Column:
    """Seconds to `SS.ss`, `M:SS.ss` or `H:MM:SS.ss`; null becomes empty text."""
    sec = col(c).cast("double")
    minutes = F.floor(sec / 60.0)
    rest = sec - minutes * 60
    return (
        F.when(sec.isNull(), F.lit(""))
        .when(sec < 60, F.format_string("%.2f", sec))
        .when(minutes < 60, F.format_string("%d:%05.2f", minutes, rest))
        .otherwise(F.format_string("%d:%02d:%05.2f", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)), rest))
    )


def format_time_rounded(c: Column | str) -> Column:
    """Variant without hours that works on whole hundredths, so 59.999 shows as 1:00.00."""
    hundredths = F.floor(col(c).cast("double") * 100.0 + 0.5)
    minutes = F.floor(hundredths / 6000)
    rest = (hundredths - minutes * 6000) / F.lit(100.0)
    return F.when(minutes > 0, F.format_string("%d:%05.2f", minutes, rest)).otherwise(F.format_string("%.2f", rest))


def time_numeric(c: Column | str) -> Column:
    """Numeric part of a time token, or the whole token when it does not look like a time."""
    s = F.trim(col(c))
    return F.when(s.rlike(TIME_WITH_SUFFIX), F.regexp_extract(s, TIME_WITH_SUFFIX, 1)).otherwise(s)


def time_suffix(c: Column | str) -> Column:
    return F.trim(F.regexp_extract(F.trim(col(c)), TIME_WITH_SUFFIX, 2))


def is_placeholder_time(c: Column | str) -> Column:
    """No decimal part, or hundredths of exactly 00 or 50."""
    s = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    frac = F.substring_index(s, ".", -1)
    return (~F.contains(s, F.lit("."))) | frac.isin("00", "50")
