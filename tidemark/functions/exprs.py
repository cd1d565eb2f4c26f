"""Small expressions that the operators share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def zero(value: Column | str) -> Column:
    """The value, or 0 for null."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """Hundred times part over whole; null where the whole is zero or null. Rounded half up to two digits."""
    return F.round(F.when(whole != 0, part * 100 / whole), 2).cast("decimal(18,2)")


def mean(value: Column | str, over=None) -> Column:
    """The mean, rounded half up to two digits from the exact sum and count; over: a window."""
    total, n = F.sum(value), F.count(value)
    if over is not None:
        total, n = total.over(over), n.over(over)
    return F.round(total / n, 2).cast(MONEY)


def days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two timestamps."""
    return F.timestamp_diff("SECOND", earlier, later)


def date_key(day: Column) -> Column:
    """YYYYMMDD as an integer."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def month_key(day: Column) -> Column:
    """YYYYMM as an integer."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


def timestamp_of(day: Column, clock: Column) -> Column:
    """A date and 'HH:mm:ss' text as a timestamp; null if either is."""
    return F.concat(day.cast("string"), F.lit(" "), clock).cast("timestamp_ntz")


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    """Null if either part is null."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def current(df: DataFrame) -> DataFrame:
    return df.where(F.col("current_flag") == "Y")


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the given order; ties must be broken by the order's last terms."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def within(df: DataFrame, column: str, first: Column, last: Column | None = None) -> DataFrame:
    """Rows whose date lies in [first, last]; a month partition column, if there is one, gets the matching bounds, so that files are pruned."""
    c = F.col(column)
    df = df.where(c >= first) if last is None else df.where(c.between(first, last))
    if "txn_month" in df.columns:
        df = df.where(F.col("txn_month") >= month_key(first))
        df = df if last is None else df.where(F.col("txn_month") <= month_key(last))
    return df
