"""The calendar dimension, from two dates and, if given, a table of holidays."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import date_key
from ..schemas import TABLES, align


def calendar(spark: SparkSession, first: date, last: date, holidays: DataFrame | None = None) -> DataFrame:
    """One row a day of [first, last]. holidays: calendar_date, holiday_name. The fiscal year is the calendar year; both week numbers are ISO weeks."""
    d = F.col("calendar_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("calendar_date"))
    if holidays is None:
        days = days.withColumn("holiday_name", F.lit(None).cast("string"))
    else:
        days = days.join(holidays.select("calendar_date", "holiday_name"), "calendar_date", "left")
    weekend, holiday = F.weekday(d) >= 5, F.col("holiday_name").isNotNull()
    flag = lambda c: c.cast("tinyint")
    out = days.select(
        date_key(d).alias("date_key"), d, (F.weekday(d) + 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofmonth(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"), F.weekofyear(d).alias("iso_week"), F.month(d).alias("month_num"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "MMM").alias("month_short"),
        F.quarter(d).alias("quarter_num"), F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"), F.when(F.month(d) <= 6, 1).otherwise(2).alias("half_year"), F.year(d).alias("calendar_year"),
        F.year(d).alias("fiscal_year"), F.quarter(d).alias("fiscal_quarter"), flag(weekend).alias("is_weekend"), flag(holiday).alias("is_norwegian_holiday"), "holiday_name", flag(~weekend & ~holiday).alias("is_business_day"),
        flag(d == F.last_day(d)).alias("is_month_end"), flag((d == F.last_day(d)) & (F.month(d) % 3 == 0)).alias("is_quarter_end"), flag((F.month(d) == 12) & (F.dayofmonth(d) == 31)).alias("is_year_end"),
        F.date_sub(d, 1).alias("prior_day_date"), F.date_add(d, 1).alias("next_day_date"), F.add_months(d, -12).alias("same_day_prev_year"),
    )
    return align(out, TABLES["dim_date"])
