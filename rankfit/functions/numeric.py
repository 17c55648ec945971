"""Null-safe number parsing and rounding on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the number texts a lenient float / int parser accepts
FLOAT_TEXT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
NON_FINITE_TEXT = r"(?i)^[+-]?(nan|inf|infinity)$"
INT_TEXT = r"^[+-]?\d+(_\d+)*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind a costly expression once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lit_double(v: float) -> Column:
    return F.lit(float(v))


def to_double(c: Column | str) -> Column:
    """Text to double, null when it is not a number. Guards the suffix forms ('12d') a SQL cast takes."""
    s = F.trim(col(c).cast("string"))
    return F.when(
        s.rlike(FLOAT_TEXT) | s.rlike(NON_FINITE_TEXT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double")
    )


def to_long(c: Column | str) -> Column:
    s = F.trim(col(c).cast("string"))
    return F.when(s.rlike(INT_TEXT), F.replace(s, F.lit("_"), F.lit("")).try_cast("bigint"))


def safe_number(c: Column | str) -> Column:
    """Number with thousands commas and inner blanks removed; null when malformed."""
    return to_double(F.regexp_replace(col(c).cast("string"), r"[,\s]", ""))


def round_to(c: Column | str, digits: int) -> Column:
    """Round half up on the scaled double.

    The same arithmetic in any engine. The built-in round goes through decimal text instead, and the two can differ in
    the last digit on values that sit on a half.
    """
    scale = float(10**digits)
    x = col(c).cast("double")
    return F.floor(x * scale + 0.5).cast("double") / scale


def tenths(c: Column | str, signed: bool = False) -> Column:
    """Text with one decimal, rounded half up as in `round_to`; `signed` writes a plus as well."""
    x = col(c).cast("double")
    n = F.floor(F.abs(x) * 10 + 0.5).cast("bigint")
    sign = F.when(x < 0, "-").otherwise("+" if signed else "")
    return F.concat(sign, F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def nonzero(c: Column | str, default: float) -> Column:
    """Null and zero both mean 'not given'."""
    x = col(c)
    return F.coalesce(F.nullif(x, F.lit(0).cast("double")), F.lit(float(default)))


def ratio(num: Column, den: Column, default: float | None = None) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(default).cast("double"))


def exact_sum(c: Column | str, scale: int = 2) -> Column:
    """Order-independent sum of a double column that carries `scale` decimals."""
    return F.sum(col(c).cast(f"decimal(28,{scale})")).cast("double")


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))
