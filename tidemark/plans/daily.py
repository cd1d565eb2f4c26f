"""The daily load: check, batch id, customer versions, transactions, balances, reconciliation, batch record."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import load, scd2, screens
from ..sources.warehouse import Warehouse, export_csv, export_report


class Exit(IntEnum):
    OK = 0
    NO_DATA = 4
    ERROR = 8


@dataclass
class LoadResult:
    return_code: int = 0
    rows_inserted: int = 0
    rows_rejected: int = 0
    message: str = ""


@dataclass
class DailyResult:
    code: Exit
    batch_id: int | None = None
    load: LoadResult = field(default_factory=LoadResult)
    customers_inserted: int = 0
    customers_changed: int = 0
    reconciliation: DataFrame | None = None
    balances: dict[str, DataFrame] = field(default_factory=dict)


def _log(w: Warehouse, batch_id: int, level: str, message: str, now: datetime) -> None:
    w.append("etl_log", w.spark.createDataFrame([("LOAD_DAILY", batch_id, level, message, now)], "procedure_name string, batch_id long, log_level string, log_message string, log_ts timestamp_ntz"))


def load_transactions(w: Warehouse, load_date: date, batch_id: int, now: datetime, clock: Callable[[], float] = time.monotonic) -> LoadResult:
    """Store the day's rejects and enriched rows and log how long it took. An error is logged and returned as a code; the caller must look at it.

    ``now`` is the run's start; ``clock`` counts the seconds that pass."""
    began = clock()
    run_ts, result = F.lit(now).cast("timestamp_ntz"), LoadResult()
    try:
        _log(w, batch_id, "INFO", f"Starting load for {load_date}", now)
        bad = load.rejects(w, load_date, batch_id)
        good = load.enriched(w, load_date, batch_id, run_ts)
        w.append("stg_transaction_errors", bad)
        w.append("fact_transaction", good, run_ts)
        result.rows_rejected = load.rejected(w, load_date, batch_id).count()
        result.rows_inserted = load.loaded(w, load_date, batch_id).count()
        took = int(clock() - began)
        _log(w, batch_id, "INFO", f"Completed. Inserted: {result.rows_inserted}, Rejected: {result.rows_rejected}, Duration: {took}", now + timedelta(seconds=took))
    except Exception as error:  # the contract is a code and a log row, not an exception
        result.return_code, result.message = 1, str(error)[:500]
        _log(w, batch_id, "ERROR", result.message, now + timedelta(seconds=int(clock() - began)))
    return result


def apply_customers(w: Warehouse, batch_id: int, now: datetime, null_safe: bool = False) -> tuple[int, int]:
    """Store the customer dimension after the staged changes; how many versions were inserted and how many expired."""
    run_ts = F.lit(now).cast("timestamp_ntz")
    before = w["dim_customer"]
    changes = scd2.customer_changes(before, w["stg_customer"], batch_id, run_ts, now.date(), null_safe)
    w.replace("dim_customer", changes.applied(before), run_ts)
    after = w["dim_customer"].where(F.col("etl_batch_id") == batch_id)
    n = after.agg(F.count_if(F.col("current_flag") == "Y"), F.count_if(F.col("current_flag") == "N")).first()
    return n[0], n[1]


def run(w: Warehouse, load_date: date, now: datetime, report: str | None = None, clock: Callable[[], float] = time.monotonic) -> DailyResult:
    """One day's run. report: a folder for the reconciliation and the balance checks; without it they are returned and not yet computed."""
    began = clock()
    if not load.staging_check(w, load_date).first().row_count:
        return DailyResult(Exit.NO_DATA)
    batch_id = load.next_batch_id(w["etl_batch_control"]).first().batch_id
    out = DailyResult(Exit.OK, batch_id)
    try:
        out.customers_inserted, out.customers_changed = apply_customers(w, batch_id, now)
        out.load = load_transactions(w, load_date, batch_id, now, clock)
        if out.load.return_code:
            raise RuntimeError(out.load.message)
        out.balances = screens.daily_balance_check(w, load_date)
        out.reconciliation = load.reconciliation(w, load_date, batch_id)
        if report:
            export_report(out.reconciliation, f"{report}/reconciliation")
            for name, frame in out.balances.items():
                export_csv(frame, f"{report}/balance_{name}")
    except Exception:  # recorded as a failed batch
        out.code = Exit.ERROR
    status = "COMPLETED" if out.code == Exit.OK else "FAILED"
    w.append("etl_batch_control", w.spark.createDataFrame([(batch_id, load_date, status, now, now + timedelta(seconds=int(clock() - began)))], "batch_id long, batch_date date, batch_status string, start_ts timestamp_ntz, end_ts timestamp_ntz"))
    return out
