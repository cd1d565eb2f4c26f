"""Display formats of the reports: fixed-width numbers, padded text and dates. Only reports use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(value: Column, digits: int = 12, signed: bool = False) -> Column:
    """Two decimals, thousands in groups, blanks for leading zeros, the sign before the first digit; signed: + too. Null stays null.

    A number too wide for its digits is shown whole, in more room, not cut or starred."""
    number = F.round(value, 2).cast("decimal(38,2)")
    sign = F.when(number < 0, "-").otherwise("+" if signed else "")
    shown = F.concat(sign, F.ltrim(F.to_char(F.abs(number), F.lit(",".join(["999"] * 11) + ",990.00"))))
    width = digits + (digits - 1) // 3 + 3 + signed
    return F.when(F.char_length(shown) > width, shown).otherwise(F.lpad(shown, width, " "))


def integer(value: Column, width: int, fill: str = " ") -> Column:
    return F.lpad(value.cast("string"), width, fill)


def text(value: Column, width: int) -> Column:
    """Cut or padded to the width; null is blank."""
    return F.rpad(F.coalesce(value, F.lit("")), width, " ")


def iso_date(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")
