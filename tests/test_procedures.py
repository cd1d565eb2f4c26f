"""Edge cases of views, screens, loads, snapshots, versions and storage on small hand-made tables."""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, load, report, scd2, screens, snapshot, validate, views
from tidemark.plans import daily, monthly
from tidemark.schemas import TABLES, align, assign_identity, violations
from tidemark.sources.seeds import read_expected, read_seed
from tidemark.sources.warehouse import Warehouse, export_report
from tidemark.streaming import incoming

NOW = datetime(2024, 2, 1, 2)


def ts():
    return F.lit(NOW).cast("timestamp_ntz")


def make(spark, table, *rows):
    """Rows as dicts; columns that a row lacks take their defaults."""
    types = {f.name: f.dataType.simpleString() for f in TABLES[table].schema.fields}
    names = list(dict.fromkeys(k for r in rows for k in r)) or list(types)
    usual = {k: NOW if v == "now" else datetime(9999, 12, 31, 23, 59, 59) if k == "effective_to" else v for k, v in TABLES[table].defaults.items()}
    fix = lambda k, v: Decimal(str(v)) if v is not None and types[k].startswith("decimal") else v
    df = spark.createDataFrame([tuple(fix(k, r.get(k, usual.get(k))) for k in names) for r in rows], ", ".join(f"{k} {types[k]}" for k in names))
    return align(df, TABLES[table], ts())


def person(i, key=None, **more):
    return {"customer_id": i, "customer_key": key or i, "first_name": "A", "last_name": f"N{i}", "customer_segment": "RETAIL", "city": "Oslo", "onboarding_date": date(2020, 1, 1)} | more


def account(k, customer=1, **more):
    return {"account_key": k, "account_id": f"A{k}", "customer_id": customer, "account_type": "CHECKING", "opening_date": date(2020, 1, 1), "product_id": 1, "branch_id": 1} | more


def payment(i, amount, day=date(2024, 1, 10), kind="DEBIT", account=1, customer=1, clock="10:00:00", **more):
    return {"transaction_id": i, "transaction_date": day, "transaction_ts": datetime.fromisoformat(f"{day} {clock}"), "account_key": account, "customer_key": customer, "product_id": 1, "branch_id": 1, "date_key": 0, "transaction_type": kind,
            "transaction_amount": amount, "base_currency_amount": amount, "etl_batch_id": 1} | more


@pytest.fixture
def t(spark):
    return {n: make(spark, n) for n in TABLES} | {
        "dim_customer": make(spark, "dim_customer", person(1), person(2, 20, current_flag="N"), person(2, 21)),
        "dim_account": make(spark, "dim_account", account(1), account(2, 2)),
        "dim_branch": make(spark, "dim_branch", {"branch_id": 1, "branch_code": "B1", "branch_name": "One", "region": "R"}),
    }


def test_view_edges(spark, t):
    t["fact_transaction"] = make(
        spark, "fact_transaction", payment(1, 100_000), payment(2, 25_000, is_international=1), payment(3, None, is_flagged=1, transaction_amount=1), payment(4, 99_999), payment(5, 200_000, account=2, customer=20),
        payment(6, 100_000), payment(6, 150_000, etl_batch_id=2),
    )
    got = {r.transaction_id: r for r in views.regulatory_large_transactions(t).collect()}
    assert {k: r.reporting_category for k, r in got.items()} == {1: "THRESHOLD_EXCEEDED", 2: "INTL_THRESHOLD", 3: "FLAGGED_SUSPICIOUS", 6: "THRESHOLD_EXCEEDED"}
    assert got[6].etl_batch_id == 2


def test_customer_without_accounts(spark, t):
    t["dim_account"] = make(spark, "dim_account")
    row = views.customer_360(t, date(2024, 1, 31)).where("customer_id = 1").first()
    assert (row.total_accounts, row.total_balance, row.txn_count_last_90_days, row.last_txn_date) == (0, 0, 0, None)


def test_zero_region_and_calendar_range(spark, t):
    t["dim_date"] = calendar.calendar(spark, date(2024, 1, 1), date(2024, 1, 31))
    snap = {"snapshot_month_key": 202401, "account_key": 1, "customer_key": 1, "product_id": 1, "branch_id": 1, "opening_balance": 0, "closing_balance": 0}
    t["fact_monthly_account_snapshot"] = make(spark, "fact_monthly_account_snapshot", snap | {"snapshot_date": date(2024, 1, 31)}, snap | {"snapshot_date": date(2024, 2, 29), "snapshot_month_key": 202402})
    got = views.branch_performance(t, date(2024, 3, 1)).collect()
    assert [(r.snapshot_month_key, r.pct_of_region_deposits, r.month_label) for r in got] == [(202401, None, "January 2024")]
    assert views.branch_performance(t, date(2024, 3, 1), per_branch=True).count() == 1


def test_aml_edges(spark, t):
    near = [payment(i, a, account=1) for i, a in ((1, 40_000), (2, 50_000), (3, 45_000))] + [payment(i, 45_000, account=2, customer=21) for i in (4, 5)]
    t["fact_transaction"] = make(spark, "fact_transaction", *near)
    got = screens.aml_screening(t, date(2024, 1, 31))["structuring"].collect()
    assert [(r.account_id, r.txn_count) for r in got] == [("A1", 3)]
    t["fact_transaction"] = make(
        spark, "fact_transaction", payment(1, 60_000, kind="CREDIT"), payment(2, 50_000, date(2024, 1, 13)), payment(3, 50_000, date(2024, 1, 14)), payment(4, -60_000, date(2024, 1, 11)), payment(5, 44_999, date(2024, 1, 11))
    )
    got = screens.aml_screening(t, date(2024, 1, 31))["rapid"].collect()
    assert [(r.debit_date, r.days_between) for r in got] == [(date(2024, 1, 13), 3)]


def test_negative_balance_is_the_last_negative_one(spark, t):
    t["fact_transaction"] = make(spark, "fact_transaction", payment(1, 1, running_balance=-10, clock="09:00:00"), payment(2, 1, running_balance=5, clock="10:00:00"))
    checks = screens.daily_balance_check(t, date(2024, 1, 10))
    assert [r.current_balance for r in checks["negative"].collect()] == [Decimal("-10.00")]
    assert [(r.account_count, r.total_balance) for r in checks["summary"].collect()] == [(1, Decimal("5.00"))]


def test_history_filters_and_payee(spark, t):
    t["fact_transaction"] = make(spark, "fact_transaction", payment(1, 1), payment(2, 2, kind="CREDIT", merchant_name="Shop"), payment(3, 3, date(2023, 1, 1)))
    got = screens.customer_txn_history(t, 1, date(2024, 1, 31)).collect()
    assert [(r.amount, r.payee) for r in got] == [(2, "Shop"), (1, "--")]
    assert screens.customer_txn_history(t, 1, date(2024, 1, 31), transaction_type="CREDIT").count() == 1
    assert screens.customer_txn_history(t, 1, date(2024, 1, 31), rows=1).count() == 1


def test_versions(spark, t):
    dim = make(spark, "dim_customer", person(1, email_address=None, phone_number=None), person(2, postal_code=None), person(3), person(4, current_flag="N", effective_to=datetime(2023, 1, 1), onboarding_date=date(2019, 5, 5)))
    stage = lambda i, **m: {k: v for k, v in person(i).items() if k not in ("customer_key", "onboarding_date")} | {"kyc_status": "PENDING"} | m
    staging = make(spark, "stg_customer", stage(1, phone_number="", customer_segment="retail"), stage(2, postal_code="0155"), stage(3, city="Bergen"), stage(4), stage(7), stage(8, country_code="SWE"), stage(9))
    loose = scd2.customer_changes(dim, staging, 5, ts(), NOW.date())
    assert [r.customer_id for r in loose.expired.collect()] == [3]
    fresh = {r.customer_id: r for r in loose.inserted.collect()}
    assert sorted(fresh) == [3, 4, 7, 8, 9]
    assert (fresh[3].onboarding_date, fresh[4].onboarding_date, fresh[7].onboarding_date) == (date(2020, 1, 1), date(2019, 5, 5), NOW.date())
    assert (fresh[7].country_code, fresh[8].country_code) == ("NOR", "SWE")
    assert sorted(r.customer_id for r in scd2.customer_changes(dim, staging, 5, ts(), NOW.date(), null_safe=True).expired.collect()) == [2, 3]
    after = loose.applied(dim)
    assert after.count() == 9 and after.select("customer_key").distinct().count() == 9
    assert after.where("customer_id = 3 and current_flag = 'Y'").first().effective_from == after.where("customer_id = 3 and current_flag = 'N'").first().effective_to
    assert validate.broken_invariants({"dim_customer": after, "fact_monthly_account_snapshot": make(spark, "fact_monthly_account_snapshot")}).count() == 0


def staged(i, account="A1", currency="NOK", **more):
    return {"load_date": date(2024, 1, 15), "transaction_id": i, "transaction_date": date(2024, 1, 15), "transaction_time": "08:30:00", "account_id": account, "transaction_type": "DEBIT", "transaction_amount": 100, "currency_code": currency} | more


def test_load(spark, t):
    t["dim_account"] = make(spark, "dim_account", account(1), account(3, 99))
    t["dim_exchange_rates"] = make(spark, "dim_exchange_rates", {"from_currency": "USD", "to_currency": "NOK", "rate_date": date(2024, 1, 15), "exchange_rate": 10.5})
    t["stg_transactions"] = make(spark, "stg_transactions", staged(1), staged(2, currency="USD"), staged(3, currency="EUR"), staged(4, currency=None), staged(5, "NONE"), staged(6, None), staged(7, "A3"))
    good = {r.transaction_id: r for r in load.enriched(t, date(2024, 1, 15), 9, ts()).collect()}
    assert {k: (r.base_currency_amount, r.exchange_rate, r.is_international) for k, r in good.items()} == {1: (100, 0, 0), 2: (1050, Decimal("10.5"), 1), 3: (0, 0, 1), 4: (100, 0, 0)}
    assert (good[1].transaction_ts, good[1].date_key, good[1].running_balance, good[1].is_flagged) == (datetime(2024, 1, 15, 8, 30), 20240115, None, 0)
    bad = load.rejects(t, date(2024, 1, 15), 9)
    assert [(r.transaction_id, r.error_reason, r.batch_id) for r in bad.collect()] == [(5, "INVALID_ACCOUNT", 9)]
    after = t | {"fact_transaction": load.enriched(t, date(2024, 1, 15), 9, ts()), "stg_transaction_errors": bad}
    recon = load.reconciliation(after, date(2024, 1, 15), 9).first()
    assert (recon.staged_rows, recon.loaded_rows, recon.error_rows, recon.dropped_rows, recon.missing_fx_rows) == (7, 4, 1, 2, 1)


def test_snapshot_carries_balances(spark, t):
    t["dim_customer"] = make(spark, "dim_customer", person(1), person(2))
    t["fact_monthly_account_snapshot"] = make(spark, "fact_monthly_account_snapshot", {"snapshot_date": date(2024, 1, 31), "snapshot_month_key": 202401, "account_key": 1, "customer_key": 1, "product_id": 1, "opening_balance": 0, "closing_balance": 100})
    t["fact_transaction"] = make(spark, "fact_transaction", payment(1, 50, date(2024, 2, 3), "CREDIT", running_balance=-5), payment(2, -20, date(2024, 2, 29), "DEBIT"), payment(3, 7, date(2024, 3, 1), "CREDIT"))
    got = {r.account_key: r for r in snapshot.month_snapshot(t, 2024, 2, 4, ts()).collect()}
    assert (got[1].opening_balance, got[1].closing_balance, got[1].total_debits, got[1].days_in_overdraft, got[1].days_dormant, got[1].snapshot_date) == (100, 130, 20, 1, 0, date(2024, 2, 29))
    assert (got[2].opening_balance, got[2].days_dormant) == (0, 29)
    merged = snapshot.upsert(t["fact_monthly_account_snapshot"], snapshot.month_snapshot(t, 2024, 2, 4, ts()), ["account_key", "snapshot_month_key"], snapshot.KEPT)
    again = snapshot.upsert(merged, snapshot.month_snapshot(t, 2024, 2, 4, ts()), ["account_key", "snapshot_month_key"], snapshot.KEPT)
    assert merged.count() == again.count() == 3


def test_schema_helpers(spark):
    df = make(spark, "dim_customer", person(1), person(1))
    assert df.count() == 1  # the table refuses duplicate rows
    assert df.first().country_code == "NOR" and df.first().effective_to.year == 9999
    assert make(spark, "dim_customer", person(1, country_code=None)).first().country_code is None
    row = violations(make(spark, "dim_account", account(1), account(1, 2)), TABLES["dim_account"]).first()
    assert row.repeated_keys == 1
    keys = assign_identity(spark.range(1000).select(F.col("id").alias("customer_id")), df, TABLES["dim_customer"], ["customer_id"])
    assert sorted(r.customer_key for r in keys.collect()) == list(range(2, 1002))


def test_calendar(spark):
    days = calendar.calendar(spark, date(2000, 1, 1), date(2029, 12, 31), spark.createDataFrame([(date(2024, 5, 17), "National day")], "calendar_date date, holiday_name string"))
    assert days.count() == 10958
    r = days.where("date_key = 20240517").first()
    assert (r.day_of_week, r.day_name, r.is_business_day, r.is_norwegian_holiday, r.quarter_name) == (5, "Friday", 0, 1, "Q2")
    assert days.where("is_year_end = 1").count() == 30


def test_seeds_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "b.csv").write_text("BRANCH_ID|BRANCH_CODE|BRANCH_NAME|BRANCH_TYPE|CITY|COUNTY|REGION|POSTAL_CODE|COUNTRY_CODE|LATITUDE|LONGITUDE|OPENING_DATE|IS_ACTIVE|EMPLOYEE_COUNT\n7|B7|Seven||Oslo||EAST|0155|NOR|59.9|10.7|1990-01-01|1|45\n")
    r = align(read_seed(spark, str(tmp_path / "b.csv"), "dim_branch"), TABLES["dim_branch"], ts()).first()
    assert (r.postal_code, r.branch_type, r.employee_count, r.latitude) == ("0155", None, 45, Decimal("59.9000000"))


@pytest.fixture
def house(spark, t, tmp_path):
    w = Warehouse(spark, str(tmp_path / "dw"))
    for n in ("dim_customer", "dim_account", "dim_branch"):
        w.replace(n, t[n], ts())
    w.replace("dim_date", calendar.calendar(spark, date(2024, 1, 1), date(2024, 12, 31)), ts())
    return w


def test_daily_run(spark, house, tmp_path):
    assert daily.run(house, date(2024, 1, 15), NOW).code == daily.Exit.NO_DATA
    house.append("stg_transactions", make(spark, "stg_transactions", staged(1), staged(2, "NONE")))
    house.replace("stg_customer", make(spark, "stg_customer", {k: v for k, v in person(5).items() if k not in ("customer_key", "onboarding_date")}))
    out = daily.run(house, date(2024, 1, 15), NOW, str(tmp_path / "recon"))
    assert (out.code, out.batch_id, out.load.rows_inserted, out.load.rows_rejected, out.customers_inserted) == (0, 1, 1, 1, 1)
    assert house["etl_batch_control"].first().batch_status == "COMPLETED"
    assert house["dim_customer"].count() == 4
    assert house["etl_log"].count() == 2
    assert house["etl_log"].where("log_message rlike 'Inserted: 1, Rejected: 1, Duration: [0-9]+$'").count() == 1
    assert len(list((tmp_path / "recon/reconciliation").glob("part-*"))) and (tmp_path / "recon/balance_summary").exists() and (tmp_path / "recon/balance_negative").exists()
    ticks = iter(range(0, 1000, 5))
    again = daily.run(house, date(2024, 1, 15), NOW, clock=lambda: next(ticks))
    assert [r.seconds for r in load.durations(house["etl_batch_control"]).where("batch_id = 2").collect()] == [15]
    assert house["etl_log"].where("log_message like '%Duration: 5'").count() == 1
    assert again.batch_id == 2 and house["fact_transaction"].count() == 2  # append only


def test_failed_load_is_recorded(spark, house, monkeypatch):
    house.append("stg_transactions", make(spark, "stg_transactions", staged(1)))
    monkeypatch.setattr(load, "enriched", lambda *a: 1 / 0)
    out = daily.run(house, date(2024, 1, 15), NOW)
    assert (out.code, out.load.return_code) == (daily.Exit.ERROR, 1)
    assert house["etl_batch_control"].first().batch_status == "FAILED"
    assert house["etl_log"].where("log_level = 'ERROR'").count() == 1


def test_month_end(spark, house, tmp_path):
    house.append("fact_transaction", make(spark, "fact_transaction", payment(1, 200_000, date(2024, 2, 3), "CREDIT"), payment(2, 10, date(2024, 3, 3), "CREDIT")), ts())
    assert monthly.take_snapshot(house, 2024, 2, 1, NOW) == 2
    assert monthly.take_snapshot(house, 2024, 3, 1, NOW) == 2
    assert monthly.take_snapshot(house, 2024, 2, 2, NOW) == 2
    got = house["fact_monthly_account_snapshot"].where("account_key = 1").orderBy("snapshot_date").collect()
    assert [(r.opening_balance, r.closing_balance) for r in got] == [(0, 200_000), (200_000, 200_010)]
    assert validate.broken_invariants(house).count() == 0
    assert monthly.extract(house, date(2024, 3, 1), str(tmp_path / "out")) == 0
    parts = sorted((tmp_path / "out/branch_summary").glob("part-*"))
    title, dashes, line = "".join(p.read_text() for p in parts).splitlines()
    assert title.startswith("Branch  ") and title.split("  ")[-1] == "% Region" and set(dashes) == {"-", " "}
    assert "200,000.00" in line and "100.00" in line and len(line) == len(title)
    text = spark.read.csv(str(tmp_path / "out/large_transactions"), sep="|", header=True).first()
    assert text.transaction_amount.strip() == "+200,000.00" and text.transaction_date == "2024-02-03"
    assert monthly.extract(house, date(2025, 3, 1), str(tmp_path / "none")) == daily.Exit.NO_DATA


def test_month_filter_prunes_files(spark, house):
    house.append("fact_transaction", make(spark, "fact_transaction", payment(1, 1), payment(2, 1, date(2023, 1, 1))), ts())
    plan = views.customer_360(house, date(2024, 1, 31))._jdf.queryExecution().toString()
    assert "txn_month" in plan and "PartitionFilters: [isnotnull(txn_month" in plan


def test_stream(spark, house, t, tmp_path):
    make(spark, "stg_transactions", staged(1), staged(2, "NONE")).write.parquet(str(tmp_path / "in"))
    incoming.start(spark, str(tmp_path / "in"), house, str(tmp_path / "ck"), clock=lambda: NOW).awaitTermination()
    assert house["fact_transaction"].count() == 1 and house["stg_transaction_errors"].count() == 1


def test_validation(spark, t):
    t["fact_transaction"] = make(spark, "fact_transaction", payment(1, 1), payment(2, 1, account=77), payment(3, 1, account=77, customer=88))
    assert {r.check_name: r.orphan_count for r in validate.orphan_checks(t).collect()} == {"FACT_TXN -> DIM_ACCOUNT": 2, "FACT_TXN -> DIM_CUSTOMER": 1, "SNAPSHOT -> DIM_ACCOUNT": 0}
    assert validate.customer_checksum(t).first().hash_sum is not None
    export = report.large_transactions(views.regulatory_large_transactions(t), date(2024, 1, 31))
    assert export.columns[0] == "transaction_id" and len(export.columns) == 16


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_stream_loads_a_batch_whole_after_a_failure(spark, house, t, tmp_path, monkeypatch, fails_at):
    second = {"load_date": date(2024, 1, 16), "transaction_date": date(2024, 1, 16)}
    make(spark, "stg_transactions", staged(1), staged(2, "NONE"), staged(3, **second), staged(4, "NONE", **second)).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls, append = [], Warehouse.append

    def failing(self, *a):
        calls.append(a)
        if len(calls) == fails_at:
            raise OSError("lost")
        append(self, *a)

    monkeypatch.setattr(Warehouse, "append", failing)
    for _ in range(2):
        try:
            incoming.start(spark, str(tmp_path / "in"), house, str(tmp_path / "ck"), clock=lambda: NOW).awaitTermination()
        except Exception as e:
            assert "lost" in str(e)
    assert sorted(r.transaction_id for r in house["fact_transaction"].collect()) == [1, 3]
    assert sorted(r.transaction_id for r in house["stg_transaction_errors"].collect()) == [2, 4]


def test_counts_of_a_batch_read_its_files_only(spark, house):
    house.append("stg_transactions", make(spark, "stg_transactions", staged(1), staged(2, load_date=date(2024, 2, 1))))
    house.append("fact_transaction", make(spark, "fact_transaction", payment(1, 1, etl_batch_id=7), payment(2, 1, date(2023, 1, 1), etl_batch_id=7)), ts())
    rows = load.loaded(house, date(2024, 1, 15), 7)
    assert rows.count() == 1 and re.search(r"PartitionFilters: \[\(?coalesce\(txn_month", rows._jdf.queryExecution().toString())
    assert "PartitionFilters: [isnotnull(load_date" in load.staged(house, date(2024, 1, 15))._jdf.queryExecution().toString()
    assert house["stg_transactions"].columns == TABLES["stg_transactions"].schema.names


def test_report_keeps_nulls_in_place_and_long_values_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 2), (2, "x" * 40, None)], "a int, b string, c int").orderBy("a")
    export_report(df, str(tmp_path / "r"), separator="|")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*"))).splitlines()
    assert [[c.strip() for c in line.split("|")] for line in lines] == [["a", "b", "c"], ["-" * 11, "-" * 30, "-" * 11], ["1", "", "2"], ["2", "x" * 40, ""]]
    export_report(df.limit(0), str(tmp_path / "e"), width=20)
    assert ["".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*")))][0].splitlines()[1] == "-" * 11 + "  " + "-" * 7


def test_sql_sees_tables_views_and_statistics(spark, house):
    house.append("fact_transaction", make(spark, "fact_transaction", payment(1, 200_000, date(2024, 1, 20))), ts())
    house.publish()
    views.publish(house, date(2024, 1, 31))
    assert spark.sql("SELECT count(*) FROM vw_regulatory_large_transactions v JOIN dim_account a USING (account_id)").first()[0] == 1
    house.publish(statistics=True)
    try:
        found = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED fact_transaction").collect()}
        assert "1 rows" in found["Statistics"] and spark.table("fact_transaction").count() == 1
    finally:
        for name in TABLES:
            spark.catalog.dropTempView(name)
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_expected_counts(spark, tmp_path):
    (tmp_path / "e.csv").write_text("TABLE_NAME|EXPECTED_ROW_COUNT|AS_OF_DATE|NOTES\nA|2|2024-01-31|x\nB|3|2024-01-31|Approximate\nC|4|2024-01-31|x\nD|1|2024-01-31|x\n")
    counts = spark.createDataFrame([("A", 2), ("B", 5), ("C", 5)], "table_name string, row_count long")
    got = validate.count_check(counts, read_expected(spark, str(tmp_path / "e.csv")))
    assert {r.table_name: (r.status, r.difference) for r in got.collect()} == {"A": ("OK", 0), "B": ("APPROXIMATE", 2), "C": ("DIFFERENT", 1), "D": ("MISSING", None)}
