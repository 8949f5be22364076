"""Small text expressions shared by several operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as blank when a request is trimmed.
BLANK_CODES = (
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
)
BLANKS = "".join(map(chr, BLANK_CODES))

# Marks that suggestion buttons put before a request.
LEADING_MARKS = "📦💰🚚⚠️🌍📊 "


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def strip_marks(text: Column) -> Column:
    """Remove leading button marks, then blanks on both sides."""
    return strip_blanks(F.ltrim(text, F.lit(LEADING_MARKS)))


def slug(key: Column, also: str = "") -> Column:
    """Key with spaces, and each character of ``also``, turned to underscores."""
    chars = " " + also
    return F.translate(key, chars, "_" * len(chars))


def whole(number: Column) -> Column:
    """Whole number with thousands separators."""
    return F.coalesce(F.format_number(number.cast("decimal(28,0)"), 0), F.lit("n/a"))


def fixed(number: Column, digits: int) -> Column:
    """Number with a fixed count of decimals and no exponent."""
    return F.coalesce(number.cast(f"decimal(28,{digits})").cast("string"), F.lit("n/a"))
