"""Parameterised screens: balances of a day, a customer's history, money-laundering patterns."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MONEY, current, day, days, full_name, latest_per, mean, within
from .views import Tables


def daily_balance_check(t: Tables, check_date: date) -> dict[str, DataFrame]:
    """summary: last balances of the day by account type and currency; negative: the day's last negative balance of each account."""
    on_day = within(t["fact_transaction"], "transaction_date", day(check_date), day(check_date))
    newest = (F.desc("transaction_ts"), F.desc("transaction_id"))
    active = current(t["dim_account"]).where("account_status = 'ACTIVE'").select("account_key", "account_type", "currency_code")
    last = latest_per(on_day.select("account_key", "transaction_ts", "transaction_id", "running_balance").join(active, "account_key"), ["account_key"], *newest)
    balance = F.col("running_balance")
    summary = last.groupBy("account_type", "currency_code").agg(
        F.count("*").alias("account_count"),
        F.sum(balance).cast(MONEY).alias("total_balance"),
        mean(balance).alias("avg_balance"),
        F.min(balance).alias("min_balance"),
        F.max(balance).alias("max_balance"),
    )
    summary = summary.select(F.lit("BALANCE_SUMMARY").alias("check_type"), *summary.columns).orderBy("account_type", "currency_code")

    own = current(t["dim_account"]).where(~F.col("account_type").isin("CREDIT_CARD", "LOAN")).select("account_key", "account_id", "account_type", "overdraft_limit", "customer_id")
    owner = current(t["dim_customer"]).select("customer_id", full_name().alias("customer_name"))
    below = on_day.where(balance < 0).select("account_key", "transaction_ts", "transaction_id", "running_balance")
    below = latest_per(below.join(own, "account_key").join(owner, "customer_id"), ["account_key"], *newest, F.asc("customer_name"))
    negative = below.select(
        F.lit("NEGATIVE_BALANCE_ALERT").alias("check_type"), "account_id", "customer_name", "account_type", balance.alias("current_balance"), "overdraft_limit", (balance - F.col("overdraft_limit")).cast("decimal(18,2)").alias("over_limit_amount")
    ).orderBy("current_balance", "account_id")
    return {"summary": summary, "negative": negative}


def customer_txn_history(t: Tables, customer_id: int, as_of: date, start: date | None = None, end: date | None = None, transaction_type: str = "ALL", rows: int = 1000) -> DataFrame:
    """A customer's transactions, newest first, at most ``rows``; by default those of the 30 days up to as_of."""
    first, last = day(start) if start else F.date_sub(day(as_of), 30), day(end) if end else day(as_of)
    facts = within(t["fact_transaction"], "transaction_date", first, last)
    if transaction_type != "ALL":
        facts = facts.where(F.col("transaction_type") == transaction_type)
    who = current(t["dim_customer"]).where(F.col("customer_id") == customer_id).select("customer_key")
    account = current(t["dim_account"]).select("account_key", "account_id", "account_type")
    found = facts.join(who, "customer_key").join(account, "account_key")
    return found.orderBy(F.desc("transaction_ts"), F.desc("transaction_id")).limit(rows).select(
        F.col("transaction_date").alias("txn_date"),
        F.date_format("transaction_ts", "HH:mm:ss").alias("txn_time"),
        "account_id",
        "account_type",
        "transaction_type",
        "transaction_subtype",
        "channel",
        F.col("transaction_amount").alias("amount"),
        F.col("transaction_currency").alias("ccy"),
        F.col("running_balance").alias("balance"),
        F.coalesce("merchant_name", "counterparty_acct", F.lit("--")).alias("payee"),
        F.col("description_text").alias("description"),
        F.col("reference_number").alias("ref_no"),
    )


def aml_screening(t: Tables, screening_date: date, lookback: int = 30, threshold: Decimal = Decimal("50000.00")) -> dict[str, DataFrame]:
    """structuring: three or more payments just under the threshold on an account; rapid: money in and out again within three
    days; new_international: customers of under 90 days with large foreign volume."""
    last = day(screening_date)
    window = within(t["fact_transaction"], "transaction_date", F.date_sub(last, lookback), last)
    base, limit = F.col("base_currency_amount"), F.lit(threshold).cast("decimal(18,4)")
    account = current(t["dim_account"]).select("account_key", "account_id", "customer_id")
    customer = current(t["dim_customer"]).select("customer_key", F.col("customer_id").alias("owner_id"), full_name().alias("customer_name"), "kyc_status", "onboarding_date")

    near = window.where(F.col("transaction_type").isin("CREDIT", "DEBIT") & base.between(limit * F.lit(Decimal("0.8")), limit))
    # Counted by key before the dimensions join, so what joins is one row an account and customer.
    near = near.groupBy("account_key", "customer_key").agg(F.count("*").alias("n"), F.sum(base).alias("total"), F.max("transaction_date").alias("newest"))
    near = near.join(account.select("account_key", "account_id"), "account_key").join(customer, "customer_key")
    near = near.groupBy("owner_id", "customer_name", "kyc_status", "account_id").agg(F.sum("n").alias("txn_count"), F.sum("total").alias("total_amount"), F.max("newest").alias("last_txn_date")).where("txn_count >= 3")
    structuring = near.select(
        F.lit("STRUCTURING").alias("pattern_type"), F.col("owner_id").alias("customer_id"), "customer_name", "kyc_status", "account_id", "txn_count", F.col("total_amount").cast(MONEY).alias("total_amount"),
        F.round(F.col("total_amount") / F.col("txn_count"), 2).cast(MONEY).alias("avg_amount"), "last_txn_date",
    ).orderBy(F.desc("total_amount"), "customer_id", "account_id")

    credit = window.where((F.col("transaction_type") == "CREDIT") & (base >= limit)).select("account_key", F.col("transaction_date").alias("credit_date"), base.alias("credit_amount"))
    debit = window.where(F.col("transaction_type").isin("DEBIT", "TRANSFER") & (base >= limit * F.lit(Decimal("0.9")))).select("account_key", F.col("transaction_date").alias("debit_date"), base.alias("debit_amount"))
    pair = credit.join(debit, "account_key").where(F.col("debit_date").between(F.col("credit_date"), F.date_add("credit_date", 3)))
    pair = pair.join(account, "account_key").join(customer.select(F.col("owner_id").alias("customer_id"), "customer_name"), "customer_id")
    rapid = pair.select(
        F.lit("RAPID_MOVEMENT").alias("pattern_type"), "customer_id", "customer_name", "account_id", "credit_date", "credit_amount", "debit_date", "debit_amount", days(F.col("debit_date"), F.col("credit_date")).alias("days_between")
    ).orderBy(F.desc("credit_amount"), "account_id", "credit_date", "debit_date", "debit_amount")

    foreign = window.where("is_international = 1").groupBy("customer_key").agg(F.count("*").alias("n"), F.sum(base).alias("total"))
    foreign = foreign.join(customer.where(F.col("onboarding_date") >= F.date_sub(last, 90)), "customer_key")
    foreign = foreign.groupBy("owner_id", "customer_name", "onboarding_date", "kyc_status").agg(F.sum("n").alias("intl_txn_count"), F.sum("total").alias("total_intl_amount")).where(F.col("total_intl_amount") >= limit)
    new = foreign.select(
        F.lit("NEW_CUSTOMER_INTL").alias("pattern_type"), F.col("owner_id").alias("customer_id"), "customer_name", "onboarding_date", days(last, F.col("onboarding_date")).alias("days_since_onboard"), "kyc_status", "intl_txn_count",
        F.col("total_intl_amount").cast(MONEY).alias("total_intl_amount"),
    ).orderBy(F.desc("total_intl_amount"), "customer_id")
    return {"structuring": structuring, "rapid": rapid, "new_international": new}
