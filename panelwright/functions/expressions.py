"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(column: Column | str, digits: int) -> Column:
    """Round the binary value (not its printed decimals) and fold negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    scale = float(10**digits)
    return F.round(column * scale, 0) / scale + F.lit(0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """NULL instead of a division error when the denominator is zero or missing."""
    return top / F.nullif(bottom, F.lit(0.0))


def month_label(mid: Column) -> Column:
    """Month id to ``YYYY-MM``."""
    return F.concat(
        F.lpad(F.floor(mid / 12).cast("int").cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad((mid % 12 + 1).cast("int").cast("string"), 2, "0"),
    )


def month_number(period: Column) -> Column:
    """``YYYY-MM`` to month id; NULL for anything that is not a valid month."""
    valid = period.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.when(
        valid, F.substring(period, 1, 4).cast("int") * 12 + F.substring(period, 6, 2).cast("int") - 1
    ).cast("int")


def hash_number(text: Column) -> Column:
    """A reproducible 32-bit draw from a string (first eight hex digits of its md5)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))


def order_bits(column: Column) -> Column:
    """A 64-bit whole number in the order of the doubles: the bits of the binary format, negated for negative values.

    NULL and NaN give NULL; both zeros give 0.
    """
    value = column.cast("double")
    text = F.format_string("%a", F.abs(value))
    digits = F.rpad(F.regexp_extract(text, r"\.([0-9a-f]+)p", 1), 13, "0")
    exponent = F.regexp_extract(text, r"p(-?\d+)$", 1).try_cast("bigint")
    biased = F.when(text.startswith("0x1"), exponent + 1023).otherwise(0)
    bits = F.when(F.abs(value) == float("inf"), F.lit(2047 << 52)).otherwise(
        F.shiftleft(biased, 52) + F.conv(digits, 16, 10).try_cast("bigint"))
    return F.when(value.isNotNull() & ~F.isnan(value), F.when(value < 0, -bits).otherwise(bits))
