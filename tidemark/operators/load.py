"""A day's transactions: rejects and enriched rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import current, date_key, day, month_key, seconds, timestamp_of, zero
from ..schemas import HOME_CURRENCY, TABLES, align
from .views import Tables


def staged(t: Tables, load_date: date) -> DataFrame:
    return t["stg_transactions"].where(F.col("load_date") == day(load_date))


def rejects(t: Tables, load_date: date, batch_id: int) -> DataFrame:
    """The day's rows of an account without a current version, with reason and batch. A null account is neither rejected nor loaded."""
    known = current(t["dim_account"]).select("account_id")
    bad = staged(t, load_date).where("account_id is not null").join(known, "account_id", "left_anti")
    return bad.select(*t["stg_transactions"].columns, F.lit("INVALID_ACCOUNT").alias("error_reason"), F.lit(batch_id).cast("long").alias("batch_id"))


def enriched(t: Tables, load_date: date, batch_id: int, run_ts: Column) -> DataFrame:
    """The day's rows with keys, base amount and flags. A currency without a rate gets rate 0 and base amount 0, a null currency counts as the
    home currency; product and branch are the account's; the running balance isn't known here and stays null."""
    account = current(t["dim_account"]).select("account_id", "account_key", "customer_id", "product_id", "branch_id")
    customer = current(t["dim_customer"]).select("customer_id", "customer_key")
    rates = t["dim_exchange_rates"].where(F.col("to_currency") == HOME_CURRENCY)
    rates = rates.select(F.col("from_currency").alias("currency_code"), F.col("rate_date").alias("transaction_date"), F.col("exchange_rate").alias("__rate"))
    rows = staged(t, load_date).join(account, "account_id").join(customer, "customer_id").join(rates, ["currency_code", "transaction_date"], "left")
    foreign = F.coalesce(F.col("currency_code") != HOME_CURRENCY, F.lit(False))
    rate = zero("__rate").cast("decimal(12,6)")
    rows = rows.withColumns(
        {
            "transaction_ts": timestamp_of(F.col("transaction_date"), F.col("transaction_time")),
            "date_key": date_key(F.col("transaction_date")),
            "transaction_currency": F.col("currency_code"),
            "base_currency_amount": F.when(foreign, F.col("transaction_amount") * rate).otherwise(F.col("transaction_amount")).cast("decimal(15,2)"),
            "exchange_rate": rate,
            "is_international": foreign.cast("tinyint"),
            "etl_batch_id": F.lit(batch_id).cast("long"),
            "etl_insert_ts": run_ts,
        }
    )
    return align(rows, TABLES["fact_transaction"], run_ts)


def loaded(t: Tables, load_date: date, batch_id: int) -> DataFrame:
    """The batch's rows of the fact. Only the months that the day's staged rows have are read, as many as the calendar gives."""
    facts = t["fact_transaction"]
    if "txn_month" in facts.columns:
        month = F.coalesce(month_key(F.col("transaction_date")), F.lit(0)).alias("month")
        facts = facts.where(F.coalesce("txn_month", F.lit(0)).isin([r.month for r in staged(t, load_date).select(month).distinct().collect()]))
    return facts.where(F.col("etl_batch_id") == batch_id)


def rejected(t: Tables, load_date: date, batch_id: int) -> DataFrame:
    """The batch's rejects, read from the day's files only."""
    return t["stg_transaction_errors"].where((F.col("load_date") == day(load_date)) & (F.col("batch_id") == batch_id))


def reconciliation(t: Tables, load_date: date, batch_id: int) -> DataFrame:
    """One row: staged, loaded, rejected and dropped rows of a batch, and how many were loaded without a rate."""
    good = loaded(t, load_date, batch_id).agg(F.count("*").alias("loaded_rows"), F.count_if((F.col("is_international") == 1) & (F.col("exchange_rate") == 0)).alias("missing_fx_rows"))
    wrong = rejected(t, load_date, batch_id).agg(F.count("*").alias("error_rows"))
    all_rows = staged(t, load_date).agg(F.count("*").alias("staged_rows"))
    one = all_rows.crossJoin(good).crossJoin(wrong)  # three single rows
    return one.select(
        F.lit("DAILY_RECONCILIATION").alias("report_type"), day(load_date).alias("report_date"), F.lit(batch_id).cast("long").alias("batch_id"), "staged_rows", "loaded_rows", "error_rows",
        (F.col("staged_rows") - F.col("loaded_rows") - F.col("error_rows")).alias("dropped_rows"), "missing_fx_rows",
    )


def staging_check(t: Tables, load_date: date) -> DataFrame:
    """One row: how many rows and accounts are staged for a day."""
    return staged(t, load_date).agg(
        F.count("*").alias("row_count"), F.min("load_date").alias("min_date"), F.max("load_date").alias("max_date"), F.count_distinct("account_id").alias("distinct_accounts")
    ).select(F.lit("STAGING_CHECK").alias("step_name"), "row_count", "min_date", "max_date", "distinct_accounts")


def next_batch_id(control: DataFrame) -> DataFrame:
    return control.agg((F.coalesce(F.max("batch_id"), F.lit(0)) + 1).cast("long").alias("batch_id"))


def durations(control: DataFrame) -> DataFrame:
    """Per batch: its whole seconds from start to end; null while either is."""
    return control.select("batch_id", "batch_date", "batch_status", seconds(F.col("end_ts"), F.col("start_ts")).alias("seconds"))
