"""The three analytical views: functions from tables to a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MONEY, current, day, days, full_name, latest_per, mean, row_hash, share, within, zero

Tables = Mapping[str, DataFrame]

#: Amounts from which a transaction is reported.
LARGE, LARGE_INTERNATIONAL = 100_000, 25_000


def customer_360(t: Tables, as_of: date, lookback: int = 90) -> DataFrame:
    """A row for each active current customer: accounts, latest balances and recent activity; zeros where there are none."""
    # One number orders snapshots by date and then month key, so the newest balance is a hash aggregate that combines before its shuffle.
    order = F.unix_date("snapshot_date").cast("long") * 1_000_000 + F.col("snapshot_month_key")
    newest = t["fact_monthly_account_snapshot"].groupBy("account_key").agg(F.max_by("closing_balance", order).alias("balance"))
    holdings = (
        current(t["dim_account"])
        .join(newest, "account_key", "left")
        .groupBy("customer_id")
        .agg(F.count("*").alias("n"), F.count_if(F.col("account_status") == "ACTIVE").alias("n_active"), F.sum("balance").alias("balance"))
    )
    recent = within(t["fact_transaction"], "transaction_date", F.date_sub(day(as_of), lookback))
    activity = recent.groupBy("customer_key").agg(F.count("*").alias("n_txn"), F.sum(F.abs("transaction_amount")).alias("volume"), F.max("transaction_date").alias("last_day"), F.max("channel").alias("top_channel"))
    people = current(t["dim_customer"]).where("is_active = 1")
    return people.join(holdings, "customer_id", "left").join(activity, "customer_key", "left").select(
        "customer_id",
        full_name().alias("full_name"),
        "customer_segment",
        "risk_score",
        "credit_rating",
        "kyc_status",
        "onboarding_date",
        F.round(days(day(as_of), F.col("onboarding_date")) / F.lit(365.25).cast("decimal(5,2)"), 1).cast("decimal(5,1)").alias("tenure_years"),
        zero("n").cast("long").alias("total_accounts"),
        zero("n_active").cast("long").alias("active_accounts"),
        zero("balance").cast(MONEY).alias("total_balance"),
        zero("n_txn").cast("long").alias("txn_count_last_90_days"),
        zero("volume").cast(MONEY).alias("txn_amount_last_90_days"),
        F.col("last_day").alias("last_txn_date"),
        F.col("top_channel").alias("primary_channel"),
        "city",
        "country_code",
    )


def publish(t: Tables, as_of: date) -> None:
    """The three views as temporary views for SQL, as of a day."""
    for name, view in {"vw_customer_360": customer_360(t, as_of), "vw_regulatory_large_transactions": regulatory_large_transactions(t), "vw_branch_performance": branch_performance(t, as_of)}.items():
        view.createOrReplaceTempView(name)


def regulatory_large_transactions(t: Tables) -> DataFrame:
    """Reportable transactions, each once, in its newest batch."""
    base = F.col("base_currency_amount")
    reasons = (
        (base >= LARGE, "THRESHOLD_EXCEEDED"),
        ((F.col("is_international") == 1) & (base >= LARGE_INTERNATIONAL), "INTL_THRESHOLD"),
        (F.col("is_flagged") == 1, "FLAGGED_SUSPICIOUS"),
    )
    category, report = F.lit("REVIEW"), F.lit(False)
    for condition, name in reversed(reasons):
        category, report = F.when(condition, name).otherwise(category), condition | report
    account = current(t["dim_account"]).select("account_key", "account_id", "account_type")
    customer = current(t["dim_customer"]).select("customer_key", "customer_id", "first_name", "last_name", "kyc_status")
    branch = t["dim_branch"].select("branch_id", "branch_name", "region")
    found = t["fact_transaction"].where(report).join(account, "account_key").join(customer, "customer_key").join(branch, "branch_id", "left")
    found = latest_per(found, ["transaction_id"], F.desc("etl_batch_id"), F.desc("account_key"), F.desc("transaction_ts"))
    return found.select(
        "transaction_id", "transaction_date", "transaction_ts", "customer_id", "first_name", "last_name", "kyc_status", "account_id", "account_type", "transaction_type", "transaction_subtype", "transaction_amount",
        "transaction_currency", "base_currency_amount", "merchant_name", "counterparty_acct", "is_international", "reference_number", "description_text", "branch_name", "region", category.alias("reporting_category"),
        row_hash("transaction_id", "transaction_date").alias("row_hash"), "etl_batch_id",
    )


def branch_performance(t: Tables, as_of: date, months: int = 24, per_branch: bool = False) -> DataFrame:
    """Branch and month: volumes, fees, and windows over them.

    The running fee total and the three-row moving average go over the whole result by month and branch, as the source defines them;
    per_branch restarts them for each branch (and the total for each year)."""
    days_ = t["dim_date"].select(F.col("calendar_date").alias("snapshot_date"), "month_name", "calendar_year")
    branches = t["dim_branch"].where("is_active = 1").select("branch_id", "branch_name", "branch_type", "region", "city")
    snapshots = within(t["fact_monthly_account_snapshot"], "snapshot_date", F.add_months(day(as_of), -months))
    keys = ["branch_id", "branch_name", "branch_type", "region", "city", "snapshot_month_key", "month_name", "calendar_year"]
    g = snapshots.join(branches, "branch_id").join(days_, "snapshot_date").groupBy(*keys).agg(
        F.count_distinct("account_key").alias("accounts_serviced"),
        F.count_distinct("customer_key").alias("customers_serviced"),
        F.sum("closing_balance").cast(MONEY).alias("total_deposits"),
        F.sum(F.col("total_debits") + F.col("total_credits")).cast(MONEY).alias("total_volume"),
        F.sum("fees_charged").cast(MONEY).alias("total_fees_earned"),
        F.sum("interest_charged").cast(MONEY).alias("total_interest_income"),
        mean("closing_balance").alias("avg_account_balance"),
    )
    running = Window.partitionBy("branch_id", "calendar_year").orderBy("snapshot_month_key") if per_branch else Window.orderBy("snapshot_month_key", "branch_id")
    moving = Window.partitionBy("branch_id").orderBy("snapshot_month_key") if per_branch else Window.orderBy("snapshot_month_key", "branch_id")
    regional = Window.partitionBy("region", "snapshot_month_key")
    return g.select(
        "branch_id", "branch_name", "branch_type", "region", "city", "snapshot_month_key",
        F.concat(F.col("month_name"), F.lit(" "), F.trim(F.col("calendar_year").cast("string"))).alias("month_label"),
        "accounts_serviced", "customers_serviced", "total_deposits", "total_volume", "total_fees_earned", "total_interest_income", "avg_account_balance",
        F.sum("total_fees_earned").over(running.rowsBetween(Window.unboundedPreceding, 0)).cast(MONEY).alias("cumulative_fees_ytd"),
        mean("total_volume", moving.rowsBetween(-2, 0)).alias("moving_avg_volume_3m"),
        F.rank().over(regional.orderBy(F.desc("total_deposits"))).alias("region_deposit_rank"),
        share(F.col("total_deposits"), F.sum("total_deposits").over(regional)).alias("pct_of_region_deposits"),
    )
