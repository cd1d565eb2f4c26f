"""Month end: the snapshot's upsert, and the three exports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import report, screens, snapshot, views
from ..sources.warehouse import Warehouse, export_csv, export_report
from .daily import Exit


def take_snapshot(w: Warehouse, year: int, month: int, batch_id: int, now: datetime) -> int:
    """Upsert a month's snapshot; the number of rows it has from this run. Only that month's partition is read and replaced."""
    fresh = snapshot.month_snapshot(w, year, month, batch_id, F.lit(now).cast("timestamp_ntz"))
    if snapshot.orphans(fresh).limit(1).count():
        raise ValueError("an account of the snapshot has no current customer")
    stored = w["fact_monthly_account_snapshot"].where(F.col("txn_month") == year * 100 + month).drop("txn_month")
    merged = snapshot.upsert(stored, fresh, ["account_key", "snapshot_month_key"], snapshot.KEPT)
    w.replace_months("fact_monthly_account_snapshot", merged, F.lit(now).cast("timestamp_ntz"))
    return w["fact_monthly_account_snapshot"].where((F.col("txn_month") == year * 100 + month) & (F.col("etl_batch_id") == batch_id)).count()


def extract(w: Warehouse, as_of: date, folder: str) -> Exit:
    """Large transactions, branch summary and screening results, each in a folder of its own."""
    large = report.large_transactions(views.regulatory_large_transactions(w), as_of)
    export_csv(large, f"{folder}/large_transactions")
    if not large.limit(1).count():
        return Exit.NO_DATA
    export_report(report.branch_summary(views.branch_performance(w, as_of), as_of), f"{folder}/branch_summary")
    for name, frame in screens.aml_screening(w, as_of).items():
        export_csv(frame, f"{folder}/aml_{name}")
    return Exit.OK
