"""Monthly account snapshots: aggregate a month, carry the balance forward, upsert."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import current, day, mean, within, zero
from ..schemas import TABLES, align
from .views import Tables

#: Columns that an update of an existing snapshot leaves as they are.
KEPT = ("snapshot_date", "customer_key", "product_id", "branch_id", "currency_code", "base_currency_closing")


def month_bounds(year: int, month: int) -> tuple[Column, Column]:
    first = day(date(year, month, 1))
    return first, F.last_day(first)


def activity(facts: DataFrame, year: int, month: int) -> DataFrame:
    """Per account with transactions in the month: debits, credits, counts, interest, fees and balances. Overdraft days count transactions."""
    kind, amount, balance = F.col("transaction_type"), F.col("transaction_amount"), F.col("running_balance")
    out, into = kind.isin("DEBIT", "FEE"), kind.isin("CREDIT", "INTEREST")
    total = lambda c, v: F.sum(F.when(c, v).otherwise(F.lit(0)))
    return within(facts, "transaction_date", *month_bounds(year, month)).groupBy("account_key").agg(
        total(out, F.abs(amount)).alias("total_debits"),
        total(into, amount).alias("total_credits"),
        F.count_if(out).alias("debit_count"),
        F.count_if(into).alias("credit_count"),
        total((kind == "INTEREST") & (amount > 0), amount).alias("interest_earned"),
        total((kind == "INTEREST") & (amount < 0), F.abs(amount)).alias("interest_charged"),
        total(kind == "FEE", F.abs(amount)).alias("fees_charged"),
        F.min(balance).alias("minimum_balance"),
        F.max(balance).alias("maximum_balance"),
        mean(balance).alias("average_balance"),
        F.count_if(balance < 0).alias("days_in_overdraft"),
    )


def month_snapshot(t: Tables, year: int, month: int, batch_id: int, run_ts: Column) -> DataFrame:
    """The snapshot of every current, active or dormant account of a current customer. It opens with the balance at the end of the month before."""
    first, last = month_bounds(year, month)
    accounts = current(t["dim_account"]).where(F.col("account_status").isin("ACTIVE", "DORMANT")).select("account_key", "customer_id", "product_id", "branch_id", "currency_code")
    owners = current(t["dim_customer"]).select("customer_id", "customer_key")
    before = within(t["fact_monthly_account_snapshot"], "snapshot_date", F.date_sub(first, 1), F.date_sub(first, 1)).select("account_key", F.col("closing_balance").alias("__before"))
    rows = accounts.join(owners, "customer_id", "left").join(activity(t["fact_transaction"], year, month), "account_key", "left").join(before, "account_key", "left")
    numbers = ("total_debits", "total_credits", "debit_count", "credit_count", "interest_earned", "interest_charged", "fees_charged", "days_in_overdraft", "average_balance", "minimum_balance", "maximum_balance")
    idle = F.when(F.col("total_debits").isNull(), F.dayofmonth(last)).otherwise(0)
    rows = rows.withColumns(
        {c: zero(c) for c in numbers}
        | {
            "snapshot_date": last,
            "snapshot_month_key": F.lit(year * 100 + month),
            "opening_balance": zero("__before"),
            "closing_balance": zero("__before") + zero("total_credits") - zero("total_debits"),
            "days_dormant": idle,
            "etl_batch_id": F.lit(batch_id).cast("long"),
            "etl_insert_ts": run_ts,
        }
    )
    return align(rows, TABLES["fact_monthly_account_snapshot"], run_ts)


def orphans(snapshot: DataFrame) -> DataFrame:
    """Rows without a customer, which must not be stored."""
    return snapshot.where("customer_key is null")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """target with source merged in by keys, which source holds once each: matching rows take source's values but for ``kept``; others are added."""
    fresh = source.withColumn("__in", F.lit(True)).alias("s")
    both = target.withColumn("__old", F.lit(True)).alias("t").join(fresh, keys, "full")
    new, old = F.col("__in").isNotNull(), F.col("__old").isNotNull()
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in kept:
            out.append(F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
        else:
            out.append(F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return both.select(*out)
