"""Column expressions shared by the operators (all JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affordspark.schema import NA_TOKENS

# Strict number grammar accepted by the numeric parser: optional sign, digits
# with an optional fraction (or a bare fraction), optional exponent, optional
# surrounding whitespace. Anything else (suffixes like 1.0d, hex, underscores,
# thousands separators, words) is not a number.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# First run of digits, dots and commas.
DIGITS_PATTERN = r"([\d\.,]+)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """Text that a CSV reader would treat as missing becomes NULL."""
    c = _c(c)
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def extract_number(c) -> Column:
    """First run of ``[\\d.,]`` with commas removed, as text; NULL if none.
    (``regexp_substr`` is NULL on no match, so the input is referenced once.)"""
    s = _c(c).cast("string")
    return F.replace(F.regexp_substr(s, F.lit(DIGITS_PATTERN)), F.lit(","), F.lit(""))


MAX_DOUBLE = 1.7976931348623157e308
# A number without blanks and exponent, too short to overflow: nearly all are.
PLAIN_NUMBER = r"^[+-]?(?:\d{1,300}(?:\.\d{0,300})?|\.\d{1,300})\z"
SHORT = 300  # characters; no run of so many digits overflows


def to_numeric_safe(c) -> Column:
    """Number or NULL: strict grammar, and overflow to +-inf is NULL too.
    (A plain number takes one match and one cast; text takes two matches that
    fail early, and no cast: a failing cast makes an exception.)"""
    s = _c(c).cast("string")
    v = F.trim(F.regexp_extract(s, NUMBER_PATTERN, 0)).try_cast("double")
    return F.when(s.rlike(PLAIN_NUMBER), s.try_cast("double")) \
        .when(s.rlike(NUMBER_PATTERN), F.when(F.abs(v) <= F.lit(MAX_DOUBLE), v))


def extracted_number(c) -> Column:
    """``to_numeric_safe(extract_number(c))`` with one regex: the extracted
    text holds only digits and dots, for which a plain cast already is the
    strict grammar ('58.0.0' and '.' fail, '1.' and '.5' parse)."""
    s = _c(c).cast("string")
    first = F.get(F.regexp_extract_all(s, F.lit(DIGITS_PATTERN)), F.lit(0))
    v = F.replace(first, F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.length(s) <= SHORT, v).otherwise(F.when(F.abs(v) <= F.lit(MAX_DOUBLE), v))


def clamp(c, lo=None, hi=None) -> Column:
    """NULL-safe clip: a NULL stays NULL (greatest/least would skip it)."""
    c = _c(c)
    out = c
    if lo is not None and hi is not None:
        lo_c, hi_c = _lit(lo), _lit(hi)
        out = F.when(c < lo_c, lo_c).when(c > hi_c, hi_c).otherwise(c)
    elif lo is not None:
        lo_c = _lit(lo)
        out = F.when(c < lo_c, lo_c).otherwise(c)
    elif hi is not None:
        hi_c = _lit(hi)
        out = F.when(c > hi_c, hi_c).otherwise(c)
    return out


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def gender_code(c) -> Column:
    """Upper-case, strip, first character (= first non-blank character of the
    upper-cased text); blank text becomes NULL."""
    return F.get(F.regexp_extract_all(F.upper(_c(c).cast("string")), F.lit(r"^\s*(\S)"), F.lit(1)), F.lit(0))


def ratio_plus_one(num, den) -> Column:
    """num / (den + 1); NULL where the divisor is zero."""
    return F.try_divide(_c(num), _c(den) + F.lit(1.0))


def format_currency(c) -> Column:
    """Rupee text with thousands separators and two decimals."""
    return F.concat(F.lit("₹ "), F.format_number(_c(c), 2))


def format_percent(c, decimals: int = 1) -> Column:
    """Percent text of a fraction, e.g. 0.972 -> '97.2%'."""
    return F.concat(F.format_number(_c(c) * 100, decimals), F.lit("%"))
