"""Versions of customers: expire changed ones, insert new ones."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import current, day, latest_per
from ..schemas import HOME_COUNTRY, OPEN_END, TABLES, align, assign_identity

#: The columns whose change makes a new version, and those of them where null counts as ''.
COMPARED = ("marital_status", "email_address", "phone_number", "address_line_1", "city", "state_province", "postal_code", "customer_segment", "risk_score", "credit_rating", "kyc_status")
BLANK_IS_NULL = ("email_address", "phone_number")


def differs(column: str, old: str, new: str, null_safe: bool) -> Column:
    """Whether a compared column changed. Text of the case-blind columns ignores case. Unless null_safe, a change from or to null is no change."""
    a, b = F.col(f"{old}.{column}"), F.col(f"{new}.{column}")
    if column in TABLES["dim_customer"].ignore_case:
        a, b = F.lower(a), F.lower(b)
    if column in BLANK_IS_NULL:
        a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return ~a.eqNullSafe(b) if null_safe else F.coalesce(a != b, F.lit(False))


@dataclass
class Changes:
    """expired: the old versions, closed; inserted: the new versions, without keys; untouched: all other rows of the dimension."""

    expired: DataFrame
    inserted: DataFrame
    untouched: DataFrame

    def applied(self, dimension: DataFrame) -> DataFrame:
        """The dimension after the change."""
        fresh = assign_identity(self.inserted, dimension, TABLES["dim_customer"], ["customer_id"])
        return self.untouched.unionByName(self.expired).unionByName(align(fresh, TABLES["dim_customer"]))


def customer_changes(dimension: DataFrame, staging: DataFrame, batch_id: int, run_ts: Column, today: date, null_safe: bool = False) -> Changes:
    """What a batch of staged customers changes. Each staged customer is looked at for itself; customers that aren't staged stay as they are."""
    change = F.lit(False)
    for column in COMPARED:
        change = change | differs(column, "old", "new", null_safe)
    joined = current(dimension).alias("old").join(staging.alias("new"), F.col("old.customer_id") == F.col("new.customer_id"))
    changed = joined.where(change).select(F.col("old.customer_key").alias("customer_key")).distinct()
    marked = dimension.join(changed.withColumn("__changed", F.lit(True)), "customer_key", "left")
    closing = F.coalesce("__changed", F.lit(False)) & (F.col("current_flag") == "Y")
    expired = marked.where(closing).drop("__changed").withColumns({"current_flag": F.lit("N"), "effective_to": run_ts, "etl_update_ts": run_ts, "etl_batch_id": F.lit(batch_id).cast("long")})
    untouched = marked.where(~closing).drop("__changed")

    still = current(untouched).select("customer_id")
    before = expired.unionByName(untouched.where("current_flag = 'N'")).select("customer_id", "customer_key", "effective_to", F.col("onboarding_date").alias("__onboarded"))
    before = latest_per(before, ["customer_id"], F.desc("effective_to"), F.desc("customer_key")).select("customer_id", "__onboarded")
    fresh = staging.join(still, "customer_id", "left_anti").join(before, "customer_id", "left")
    inserted = fresh.withColumns(
        {
            "country_code": F.coalesce("country_code", F.lit(HOME_COUNTRY)),
            "onboarding_date": F.coalesce("__onboarded", day(today)),
            "last_review_date": day(today),
            "is_active": F.lit(1),
            "effective_from": run_ts,
            "effective_to": F.lit(OPEN_END).cast("timestamp_ntz"),
            "current_flag": F.lit("Y"),
            "etl_batch_id": F.lit(batch_id).cast("long"),
            "etl_insert_ts": run_ts,
            "etl_update_ts": run_ts,
        }
    ).drop("__onboarded")
    return Changes(expired.select(*dimension.columns), inserted, untouched.select(*dimension.columns))
