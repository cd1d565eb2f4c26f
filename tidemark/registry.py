"""The registered queries: each operator over the banking tables derived from a folder of test tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .operators import calendar, load, report, scd2, screens, snapshot, validate, views
from .schemas import TABLES, align
from .sources.mapping import LOAD_DATE, Mapped

AS_OF, CHECK, BRANCH_AS_OF, LOADED = date(2024, 1, 31), date(2024, 1, 15), date(2001, 8, 31), date.fromisoformat(LOAD_DATE)
NOW = datetime(2024, 2, 1, 2, 0, 0)


def _run_ts():
    return F.lit(NOW).cast("timestamp_ntz")


def tables(spark: SparkSession, sf_dir: str) -> Mapped:
    return Mapped(spark, sf_dir, dim_date=calendar.calendar(spark, date(1995, 1, 1), date(2029, 12, 31)))


def _changes(t: Mapped) -> scd2.Changes:
    return scd2.customer_changes(t["dim_customer"], t["stg_customer"], 3, _run_ts(), NOW.date())


def _merged(t: Mapped) -> DataFrame:
    fresh = snapshot.month_snapshot(t, 2001, 3, 3, _run_ts())
    old = t["fact_monthly_account_snapshot"].where("snapshot_month_key = 200103")
    stored = align(old.withColumn("etl_insert_ts", F.lit(None)), TABLES["fact_monthly_account_snapshot"])
    return snapshot.upsert(stored, fresh, ["account_key", "snapshot_month_key"], snapshot.KEPT).where("customer_key is not null")


def _loaded(t: Mapped) -> DataFrame:
    return load.enriched(t, LOADED, 3, _run_ts())


def _recon(t: Mapped) -> DataFrame:
    after = {"stg_transactions": t["stg_transactions"], "fact_transaction": _loaded(t), "stg_transaction_errors": load.rejects(t, LOADED, 3)}
    return load.reconciliation(after, LOADED, 3)


_OPERATORS = {
    "customer_360": lambda t: views.customer_360(t, AS_OF),
    "regulatory_large_transactions": lambda t: views.regulatory_large_transactions(t).drop("row_hash"),
    "branch_performance": lambda t: views.branch_performance(t, BRANCH_AS_OF),
    "daily_balance_summary": lambda t: screens.daily_balance_check(t, CHECK)["summary"],
    "negative_balance_alert": lambda t: screens.daily_balance_check(t, CHECK)["negative"],
    "customer_txn_history": lambda t: screens.customer_txn_history(t, 7, AS_OF),
    "aml_structuring": lambda t: screens.aml_screening(t, AS_OF)["structuring"],
    "aml_rapid_movement": lambda t: screens.aml_screening(t, AS_OF)["rapid"],
    "aml_new_customer_intl": lambda t: screens.aml_screening(t, AS_OF)["new_international"],
    "load_rejects": lambda t: load.rejects(t, LOADED, 3),
    "load_enriched": _loaded,
    "monthly_snapshot_agg": lambda t: snapshot.activity(t["fact_transaction"], 2001, 3).withColumns({c: F.col(c).cast("decimal(38,2)") for c in ("total_debits", "total_credits", "interest_earned", "interest_charged", "fees_charged", "average_balance")}),
    "monthly_snapshot_merge": _merged,
    "scd2_expired": lambda t: _changes(t).expired.select("customer_key", "customer_id", "current_flag", "effective_to", "etl_batch_id"),
    "scd2_inserted": lambda t: _changes(t).inserted,
    "row_counts": validate.row_counts,
    "customer_checksum": lambda t: validate.customer_checksum(t).drop("hash_sum"),
    "txn_monthly_checksum": validate.txn_monthly_checksum,
    "balance_reconciliation": validate.balance_reconciliation,
    "orphan_checks": validate.orphan_checks,
    "staging_check": lambda t: load.staging_check(t, LOADED),
    "recon_report": _recon,
    "dim_date": lambda t: t["dim_date"],
    "batch_durations": lambda t: load.durations(t["etl_batch_control"]),
    "next_batch_id": lambda t: load.next_batch_id(t["fact_transaction"].select(F.col("etl_batch_id").alias("batch_id"))),
    "export_large_txn": lambda t: report.large_transactions(views.regulatory_large_transactions(t), AS_OF),
    "export_branch_performance": lambda t: report.branch_summary(views.branch_performance(t, BRANCH_AS_OF), BRANCH_AS_OF),
    # Hashes have no SQL twin: rows only.
    "transaction_row_hashes": lambda t: views.regulatory_large_transactions(t).select("transaction_id", "row_hash"),
    "customer_hash_sum": lambda t: validate.customer_checksum(t).select("hash_sum"),
}


def _query(operator):
    return lambda spark, sf_dir: operator(tables(spark, sf_dir))


QUERIES = {name: _query(operator) for name, operator in _OPERATORS.items()}
ORACLES = oracles.ORACLES
