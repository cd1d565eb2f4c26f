"""Validation queries and invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MONEY, current
from .views import Tables

COUNTED = ("dim_customer", "dim_account", "dim_product", "dim_branch", "dim_date", "fact_transaction", "fact_monthly_account_snapshot")


def row_counts(t: Tables) -> DataFrame:
    parts = [t[n].agg(F.count("*").alias("row_count")).select(F.lit(n.upper()).alias("table_name"), "row_count") for n in COUNTED]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")


def customer_checksum(t: Tables) -> DataFrame:
    """One row over the current customers. hash_sum is a decimal sum of 64-bit hashes, which can't overflow."""
    return current(t["dim_customer"]).agg(
        F.count("*").alias("row_count"),
        F.count_distinct("customer_id").alias("distinct_customers"),
        F.sum(F.xxhash64("customer_id", "first_name", "last_name", "customer_segment").cast("decimal(38,0)")).alias("hash_sum"),
        F.min("onboarding_date").alias("min_onboard_date"),
        F.max("onboarding_date").alias("max_onboard_date"),
        F.count_if(F.col("is_active") == 1).alias("active_count"),
    )


def txn_monthly_checksum(t: Tables) -> DataFrame:
    f = t["fact_transaction"]
    kind = F.col("transaction_type")
    return f.groupBy(F.year("transaction_date").alias("txn_year"), F.month("transaction_date").alias("txn_month")).agg(
        F.count("*").alias("txn_count"),
        F.sum("transaction_amount").cast(MONEY).alias("total_amount"),
        F.sum("base_currency_amount").cast(MONEY).alias("total_base_amount"),
        F.count_distinct("account_key").alias("distinct_accounts"),
        F.count_distinct("customer_key").alias("distinct_customers"),
        F.count_if(kind == "DEBIT").alias("debit_count"),
        F.count_if(kind == "CREDIT").alias("credit_count"),
        F.count_if(F.col("is_international") == 1).alias("intl_count"),
    ).orderBy("txn_year", "txn_month")


def balance_reconciliation(t: Tables) -> DataFrame:
    sums = {"closing_balance": "total_deposits", "total_debits": "total_debits", "total_credits": "total_credits", "interest_earned": "total_interest", "fees_charged": "total_fees"}
    grouped = t["fact_monthly_account_snapshot"].groupBy("snapshot_month_key")
    return grouped.agg(*[F.sum(c).cast(MONEY).alias(n) for c, n in sums.items()], F.count("*").alias("account_count")).orderBy("snapshot_month_key")


def orphan_checks(t: Tables) -> DataFrame:
    """How many fact rows lack their dimension row, of any version."""
    checks = (("FACT_TXN -> DIM_ACCOUNT", "fact_transaction", "dim_account", "account_key"), ("FACT_TXN -> DIM_CUSTOMER", "fact_transaction", "dim_customer", "customer_key"), ("SNAPSHOT -> DIM_ACCOUNT", "fact_monthly_account_snapshot", "dim_account", "account_key"))
    # Facts are counted by key first, so that each key crosses the network once a task.
    part = lambda name, fact, dim, key: t[fact].groupBy(key).count().join(t[dim].select(key), key, "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("orphan_count")).select(F.lit(name).alias("check_name"), "orphan_count")
    return reduce(DataFrame.unionByName, [part(*c) for c in checks])


def broken_invariants(t: Tables) -> DataFrame:
    """A row for each customer with more than one current version and each account whose balance doesn't open where the month before closed."""
    doubled = current(t["dim_customer"]).groupBy("customer_id").count().where("count > 1").select(F.lit("two current versions").alias("problem"), F.col("customer_id").cast("string").alias("key"))
    s = t["fact_monthly_account_snapshot"]
    last = s.select("account_key", F.last_day(F.add_months("snapshot_date", 1)).alias("snapshot_date"), F.col("closing_balance").alias("__before"))
    torn = s.join(last, ["account_key", "snapshot_date"]).where("opening_balance <> __before").select(F.lit("opening balance").alias("problem"), F.concat_ws("/", F.col("account_key"), F.col("snapshot_month_key")).alias("key"))
    return doubled.unionByName(torn)


def count_check(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Row counts against expected ones: OK, DIFFERENT, MISSING (no count), or APPROXIMATE where the note says so and the numbers differ."""
    n, want = F.col("row_count"), F.col("expected_row_count")
    rows = expected.join(counts, "table_name", "left")
    status = F.when(n.isNull(), "MISSING").when(n == want, "OK").when(F.lower("notes").startswith("approximate"), "APPROXIMATE").otherwise("DIFFERENT")
    return rows.select("table_name", n, want, (n - want).alias("difference"), status.alias("status"))
