"""Formatted exports: only display columns, built from the typed views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as f
from ..functions.exprs import day, month_key


def large_transactions(view: DataFrame, as_of: date) -> DataFrame:
    """Reportable transactions of the month up to as_of, in fixed widths, ordered by day and id."""
    c = F.col
    rows = view.where(c("transaction_date").between(F.add_months(day(as_of), -1), day(as_of))).orderBy("transaction_date", "transaction_id")
    widths = {"first_name": 50, "last_name": 50, "kyc_status": 15, "account_id": 20, "account_type": 20, "transaction_type": 20, "transaction_currency": 3, "reporting_category": 25, "merchant_name": 100, "reference_number": 30}
    shown = {n: f.text(c(n), w) for n, w in widths.items()}
    shown |= {"transaction_id": f.integer(c("transaction_id"), 19), "transaction_date": f.iso_date(c("transaction_date")), "customer_id": f.integer(c("customer_id"), 10), "is_international": f.integer(c("is_international"), 1, "0")}
    shown |= {n: f.amount(c(n), 9, signed=True) for n in ("transaction_amount", "base_currency_amount")}
    order = ("transaction_id", "transaction_date", "customer_id", "first_name", "last_name", "kyc_status", "account_id", "account_type", "transaction_type", "transaction_amount", "transaction_currency", "base_currency_amount", "is_international", "reporting_category", "merchant_name", "reference_number")
    return rows.select(*[shown[n].alias(n) for n in order])


def branch_summary(view: DataFrame, as_of: date) -> DataFrame:
    """Branch figures of the calendar month before as_of, by region and rank."""
    c = F.col
    rows = view.where(c("snapshot_month_key") == month_key(F.add_months(day(as_of), -1))).orderBy("region", "region_deposit_rank", "branch_id")
    shown = {
        "Branch": (f.text(c("branch_name"), 40), 40),
        "Region": (f.text(c("region"), 15), 15),
        "Month": (f.text(c("month_label"), 20), 20),
        "Accounts": (f.integer(c("accounts_serviced"), 7), 7),
        "Total Deposits (NOK)": (f.amount(c("total_deposits"), 12), 18),
        "Fees Earned": (f.amount(c("total_fees_earned"), 9), 14),
        "Rank": (f.integer(c("region_deposit_rank"), 2), 2),
        "% Region": (f.amount(c("pct_of_region_deposits"), 3), 6),
    }
    return rows.select(*[v.alias(n, metadata={"width": w}) for n, (v, w) in shown.items()])
