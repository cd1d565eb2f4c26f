"""DuckDB SQL that gives what the registered queries give, over the same mapped tables."""

from __future__ import annotations

from .sources.mapping import LOAD_DATE, with_clause

AS_OF, CHECK, BRANCH_AS_OF = "2024-01-31", "2024-01-15", "2001-08-31"


def _sql(body: str, *tables: str) -> str:
    return with_clause("duckdb", *tables) + " " + body


def _mean(total: str, n: str) -> str:
    """Half up to two digits in whole cents, as division of decimals is inexact here."""
    cents = f"CAST(({total}) * 100 AS HUGEINT)"
    return f"CAST(SIGN({cents}) * ((2 * ABS({cents}) + {n}) // (2 * {n})) / 100 AS DECIMAL(38,2))"


def _ratio(part: str, whole: str) -> str:
    """Hundred times part over whole, half up to two digits in whole cents; null where the whole is zero or null."""
    a, b = f"CAST(({part}) * 100 AS HUGEINT)", f"NULLIF(CAST(({whole}) * 100 AS HUGEINT), 0)"
    return f"CAST(SIGN({a}) * SIGN({b}) * ((20000 * ABS({a}) + ABS({b})) // (2 * ABS({b}))) / 100 AS DECIMAL(18,2))"


def _amount(value: str, width: int, signed: bool = False) -> str:
    """Two decimals and thousands in groups; the sign stands before the first digit."""
    sign = f"CASE WHEN {value} < 0 THEN '-' ELSE '{'+' if signed else ''}' END"
    shown = f"{sign} || format('{{:,.2f}}', ABS(CAST({value} AS DOUBLE)))"
    return f"lpad({shown}, CAST(GREATEST({width}, length({shown})) AS INT), ' ')"


_FRAME = "OVER (ORDER BY snapshot_month_key, branch_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_V2 = """SELECT f.*, a.account_id, a.account_type, c.customer_id, c.first_name, c.last_name, c.kyc_status, b.branch_name, b.region,
    CASE WHEN base_currency_amount >= 100000 THEN 'THRESHOLD_EXCEEDED' WHEN is_international = 1 AND base_currency_amount >= 25000 THEN 'INTL_THRESHOLD' ELSE 'FLAGGED_SUSPICIOUS' END AS reporting_category
    FROM fact_transaction f JOIN dim_account a USING (account_key) JOIN dim_customer c ON c.customer_key = f.customer_key AND c.current_flag = 'Y' LEFT JOIN dim_branch b ON b.branch_id = f.branch_id
    WHERE base_currency_amount >= 100000 OR (is_international = 1 AND base_currency_amount >= 25000) OR is_flagged = 1
    QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY f.etl_batch_id DESC) = 1"""
_V3 = f"""g AS (SELECT b.branch_id, branch_name, branch_type, region, b.city, snapshot_month_key, strftime(snapshot_date, '%B') || ' ' || CAST(year(snapshot_date) AS VARCHAR) AS month_label,
    COUNT(DISTINCT account_key) AS accounts_serviced, COUNT(DISTINCT customer_key) AS customers_serviced, CAST(SUM(closing_balance) AS DECIMAL(38,2)) AS total_deposits, CAST(SUM(total_debits + total_credits) AS DECIMAL(38,2)) AS total_volume,
    CAST(SUM(fees_charged) AS DECIMAL(38,2)) AS total_fees_earned, CAST(SUM(interest_charged) AS DECIMAL(38,2)) AS total_interest_income, {_mean("SUM(closing_balance)", "COUNT(*)")} AS avg_account_balance
    FROM fact_monthly_account_snapshot s JOIN dim_branch b ON b.branch_id = s.branch_id AND b.is_active = 1 WHERE snapshot_date >= DATE '{BRANCH_AS_OF}' - INTERVAL 24 MONTH GROUP BY ALL),
    v3 AS (SELECT * EXCLUDE (region_deposits), CAST(SUM(total_fees_earned) OVER (ORDER BY snapshot_month_key, branch_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS cumulative_fees_ytd,
    {_mean(f"SUM(total_volume) {_FRAME}", f"COUNT(*) {_FRAME}")} AS moving_avg_volume_3m,
    CAST(RANK() OVER (PARTITION BY region, snapshot_month_key ORDER BY total_deposits DESC) AS INTEGER) AS region_deposit_rank,
    {_ratio("total_deposits", "region_deposits")} AS pct_of_region_deposits FROM (SELECT *, SUM(total_deposits) OVER (PARTITION BY region, snapshot_month_key) AS region_deposits FROM g))"""
_LAST = f"""SELECT f.account_key, f.running_balance FROM fact_transaction f WHERE transaction_date = DATE '{CHECK}'"""
_WINDOW = f"transaction_date BETWEEN DATE '{AS_OF}' - INTERVAL 30 DAY AND DATE '{AS_OF}'"
_BLIND = ("address_line_1", "city", "state_province", "customer_segment", "kyc_status")
_EXACT = ("marital_status", "postal_code", "risk_score", "credit_rating")
_DIFFERS = " OR ".join(
    [f"lower(o.{c}) <> lower(n.{c})" for c in _BLIND]
    + [f"o.{c} <> n.{c}" for c in _EXACT]
    + ["lower(COALESCE(o.email_address, '')) <> lower(COALESCE(n.email_address, ''))", "COALESCE(o.phone_number, '') <> COALESCE(n.phone_number, '')"]
)
_CHANGED = f"changed AS (SELECT o.customer_key, o.customer_id FROM dim_customer o JOIN stg_customer n USING (customer_id) WHERE o.current_flag = 'Y' AND ({_DIFFERS}))"
_LOADED = f"""loaded AS (SELECT s.*, a.account_key, c.customer_key, a.product_id, a.branch_id, COALESCE(x.exchange_rate, 0) AS rate FROM stg_transactions s JOIN dim_account a USING (account_id) JOIN dim_customer c ON c.customer_id = a.customer_id AND c.current_flag = 'Y'
    LEFT JOIN dim_exchange_rates x ON x.from_currency = s.currency_code AND x.to_currency = 'NOK' AND x.rate_date = s.transaction_date)"""
_NUMBERS = ("average_balance", "minimum_balance", "maximum_balance", "debit_count", "credit_count", "interest_earned", "interest_charged", "fees_charged", "days_in_overdraft")
_SNAP = f"""act AS (SELECT account_key, SUM(CASE WHEN transaction_type IN ('DEBIT', 'FEE') THEN ABS(transaction_amount) ELSE 0 END) AS total_debits, SUM(CASE WHEN transaction_type IN ('CREDIT', 'INTEREST') THEN transaction_amount ELSE 0 END) AS total_credits,
    COUNT(*) FILTER (transaction_type IN ('DEBIT', 'FEE')) AS debit_count, COUNT(*) FILTER (transaction_type IN ('CREDIT', 'INTEREST')) AS credit_count, SUM(CASE WHEN transaction_type = 'INTEREST' AND transaction_amount > 0 THEN transaction_amount ELSE 0 END) AS interest_earned,
    SUM(CASE WHEN transaction_type = 'INTEREST' AND transaction_amount < 0 THEN -transaction_amount ELSE 0 END) AS interest_charged,
    SUM(CASE WHEN transaction_type = 'FEE' THEN ABS(transaction_amount) ELSE 0 END) AS fees_charged, MIN(running_balance) AS minimum_balance, MAX(running_balance) AS maximum_balance, {_mean("SUM(running_balance)", "COUNT(running_balance)")} AS average_balance, COUNT(*) FILTER (running_balance < 0) AS days_in_overdraft
    FROM fact_transaction WHERE transaction_date BETWEEN DATE '2001-03-01' AND DATE '2001-03-31' GROUP BY 1),
    fresh AS (SELECT a.account_key, c.customer_key, a.product_id, a.branch_id, COALESCE(p.closing_balance, 0) AS opening_balance, COALESCE(p.closing_balance, 0) + COALESCE(act.total_credits, 0) - COALESCE(act.total_debits, 0) AS closing_balance,
    COALESCE(act.total_debits, 0) AS total_debits, COALESCE(act.total_credits, 0) AS total_credits, {', '.join(f'COALESCE(act.{c}, 0) AS {c}' for c in _NUMBERS)}, CASE WHEN act.account_key IS NULL THEN 31 ELSE 0 END AS days_dormant, a.currency_code
    FROM dim_account a LEFT JOIN dim_customer c ON c.customer_id = a.customer_id AND c.current_flag = 'Y' LEFT JOIN act ON act.account_key = a.account_key LEFT JOIN fact_monthly_account_snapshot p ON p.account_key = a.account_key AND p.snapshot_date = DATE '2001-02-28'
    WHERE account_status IN ('ACTIVE', 'DORMANT'))"""


def _merge() -> str:
    """The columns of the merged snapshot: kept ones of a stored row, all others of the fresh row if there is one."""
    kept = {"snapshot_date": "DATE '2001-03-31'", "customer_key": "f.customer_key", "product_id": "f.product_id", "branch_id": "f.branch_id", "currency_code": "f.currency_code", "base_currency_closing": "NULL"}
    out = [f"CASE WHEN o.account_key IS NULL THEN {v} ELSE o.{c} END AS {c}" for c, v in kept.items()]
    types = {c: "DECIMAL(15,2)" for c in ("opening_balance", "closing_balance", "total_debits", "total_credits", "average_balance", "minimum_balance", "maximum_balance")}
    types |= {c: "DECIMAL(12,2)" for c in ("interest_earned", "interest_charged", "fees_charged")} | {c: "INT" for c in ("debit_count", "credit_count")} | {c: "SMALLINT" for c in ("days_in_overdraft", "days_dormant")}
    out += [f"CAST(CASE WHEN f.account_key IS NULL THEN o.{c} ELSE f.{c} END AS {t}) AS {c}" for c, t in types.items()]
    out += ["CAST(CASE WHEN f.account_key IS NULL THEN o.etl_batch_id ELSE 3 END AS BIGINT) AS etl_batch_id", "CASE WHEN f.account_key IS NOT NULL THEN TIMESTAMP '2024-02-01 02:00:00' END AS etl_insert_ts"]
    return ", ".join(out)


ORACLES = {
    "customer_360": _sql(
        f"""SELECT c.customer_id, first_name || ' ' || last_name AS full_name, customer_segment, risk_score, credit_rating, kyc_status, onboarding_date, CAST(ROUND(CAST(DATE '{AS_OF}' - onboarding_date AS DECIMAL(18,6)) / 365.25, 1) AS DECIMAL(5,1)) AS tenure_years,
        COALESCE(n, 0) AS total_accounts, COALESCE(na, 0) AS active_accounts, CAST(COALESCE(bal, 0) AS DECIMAL(38,2)) AS total_balance, COALESCE(nt, 0) AS txn_count_last_90_days, CAST(COALESCE(vol, 0) AS DECIMAL(38,2)) AS txn_amount_last_90_days,
        ld AS last_txn_date, ch AS primary_channel, city, country_code FROM dim_customer c
        LEFT JOIN (SELECT customer_id, COUNT(*) AS n, COUNT(*) FILTER (account_status = 'ACTIVE') AS na, SUM(b) AS bal FROM dim_account LEFT JOIN (SELECT account_key, arg_max(closing_balance, snapshot_date) AS b FROM fact_monthly_account_snapshot GROUP BY 1) s USING (account_key) GROUP BY 1) a USING (customer_id)
        LEFT JOIN (SELECT customer_key, COUNT(*) AS nt, SUM(ABS(transaction_amount)) AS vol, MAX(transaction_date) AS ld, MAX(channel) AS ch FROM fact_transaction WHERE transaction_date >= DATE '{AS_OF}' - 90 GROUP BY 1) t USING (customer_key)
        WHERE current_flag = 'Y' AND is_active = 1""",
        "dim_customer", "dim_account", "fact_transaction", "fact_monthly_account_snapshot",
    ),
    "regulatory_large_transactions": _sql(
        f"""SELECT transaction_id, transaction_date, transaction_ts, customer_id, first_name, last_name, kyc_status, account_id, account_type, transaction_type, transaction_subtype, transaction_amount, transaction_currency, base_currency_amount, merchant_name,
        counterparty_acct, is_international, reference_number, description_text, branch_name, region, reporting_category, etl_batch_id FROM ({_V2})""",
        "fact_transaction", "dim_account", "dim_customer", "dim_branch",
    ),
    "branch_performance": with_clause("duckdb", "fact_monthly_account_snapshot", "dim_branch") + ", " + _V3 + " SELECT * FROM v3",
    "daily_balance_summary": _sql(
        f"""SELECT 'BALANCE_SUMMARY' AS check_type, account_type, currency_code, COUNT(*) AS account_count, CAST(SUM(running_balance) AS DECIMAL(38,2)) AS total_balance, {_mean("SUM(running_balance)", "COUNT(*)")} AS avg_balance,
        MIN(running_balance) AS min_balance, MAX(running_balance) AS max_balance FROM ({_LAST} QUALIFY row_number() OVER (PARTITION BY account_key ORDER BY transaction_ts DESC, transaction_id DESC) = 1) JOIN dim_account USING (account_key) WHERE account_status = 'ACTIVE' GROUP BY ALL""",
        "fact_transaction", "dim_account",
    ),
    "negative_balance_alert": _sql(
        f"""SELECT 'NEGATIVE_BALANCE_ALERT' AS check_type, account_id, first_name || ' ' || last_name AS customer_name, account_type, running_balance AS current_balance, overdraft_limit, CAST(running_balance - overdraft_limit AS DECIMAL(18,2)) AS over_limit_amount
        FROM ({_LAST} AND running_balance < 0 QUALIFY row_number() OVER (PARTITION BY account_key ORDER BY transaction_ts DESC, transaction_id DESC) = 1) JOIN dim_account USING (account_key) JOIN dim_customer c USING (customer_id)
        WHERE c.current_flag = 'Y' AND account_type NOT IN ('CREDIT_CARD', 'LOAN')""",
        "fact_transaction", "dim_account", "dim_customer",
    ),
    "customer_txn_history": _sql(
        f"""SELECT transaction_date AS txn_date, strftime(transaction_ts, '%H:%M:%S') AS txn_time, account_id, account_type, transaction_type, transaction_subtype, channel, transaction_amount AS amount, transaction_currency AS ccy, running_balance AS balance,
        COALESCE(merchant_name, counterparty_acct, '--') AS payee, description_text AS description, reference_number AS ref_no FROM fact_transaction JOIN dim_account USING (account_key) WHERE customer_key = 7 AND {_WINDOW} ORDER BY transaction_ts DESC, transaction_id DESC LIMIT 1000""",
        "fact_transaction", "dim_account",
    ),
    "aml_structuring": _sql(
        f"""SELECT 'STRUCTURING' AS pattern_type, c.customer_id, first_name || ' ' || last_name AS customer_name, kyc_status, account_id, COUNT(*) AS txn_count, CAST(SUM(base_currency_amount) AS DECIMAL(38,2)) AS total_amount,
        {_mean("SUM(base_currency_amount)", "COUNT(*)")} AS avg_amount, MAX(transaction_date) AS last_txn_date FROM fact_transaction f JOIN dim_account USING (account_key) JOIN dim_customer c ON c.customer_key = f.customer_key AND c.current_flag = 'Y'
        WHERE {_WINDOW} AND transaction_type IN ('CREDIT', 'DEBIT') AND base_currency_amount BETWEEN 40000 AND 50000 GROUP BY ALL HAVING COUNT(*) >= 3""",
        "fact_transaction", "dim_account", "dim_customer",
    ),
    "aml_rapid_movement": _sql(
        f"""SELECT 'RAPID_MOVEMENT' AS pattern_type, c.customer_id, first_name || ' ' || last_name AS customer_name, account_id, x.transaction_date AS credit_date, x.base_currency_amount AS credit_amount, y.transaction_date AS debit_date, y.base_currency_amount AS debit_amount,
        CAST(y.transaction_date - x.transaction_date AS INT) AS days_between FROM fact_transaction x JOIN fact_transaction y ON x.account_key = y.account_key AND y.transaction_date BETWEEN x.transaction_date AND x.transaction_date + 3
        JOIN dim_account a ON a.account_key = x.account_key JOIN dim_customer c ON c.customer_id = a.customer_id AND c.current_flag = 'Y'
        WHERE x.{_WINDOW} AND y.{_WINDOW} AND x.transaction_type = 'CREDIT' AND x.base_currency_amount >= 50000 AND y.transaction_type IN ('DEBIT', 'TRANSFER') AND y.base_currency_amount >= 45000""",
        "fact_transaction", "dim_account", "dim_customer",
    ),
    "aml_new_customer_intl": _sql(
        f"""SELECT 'NEW_CUSTOMER_INTL' AS pattern_type, c.customer_id, first_name || ' ' || last_name AS customer_name, onboarding_date, CAST(DATE '{AS_OF}' - onboarding_date AS INT) AS days_since_onboard, kyc_status, COUNT(*) AS intl_txn_count, CAST(SUM(base_currency_amount) AS DECIMAL(38,2)) AS total_intl_amount
        FROM fact_transaction f JOIN dim_customer c ON c.customer_key = f.customer_key AND c.current_flag = 'Y' WHERE {_WINDOW} AND is_international = 1 AND onboarding_date >= DATE '{AS_OF}' - 90 GROUP BY ALL HAVING SUM(base_currency_amount) >= 50000""",
        "fact_transaction", "dim_customer",
    ),
    "load_rejects": _sql("SELECT *, 'INVALID_ACCOUNT' AS error_reason, CAST(3 AS BIGINT) AS batch_id FROM stg_transactions WHERE account_id NOT IN (SELECT account_id FROM dim_account)", "stg_transactions", "dim_account"),
    "load_enriched": with_clause("duckdb", "stg_transactions", "dim_account", "dim_customer", "dim_exchange_rates")
    + f""", {_LOADED} SELECT transaction_id, transaction_date, CAST(CAST(transaction_date AS VARCHAR) || ' ' || transaction_time AS TIMESTAMP) AS transaction_ts, account_key, customer_key, product_id, branch_id, CAST(strftime(transaction_date, '%Y%m%d') AS INT) AS date_key, transaction_type,
    transaction_amount, currency_code AS transaction_currency, CAST(CASE WHEN currency_code <> 'NOK' THEN transaction_amount * rate ELSE transaction_amount END AS DECIMAL(15,2)) AS base_currency_amount, CAST(rate AS DECIMAL(12,6)) AS exchange_rate, CAST(CASE WHEN currency_code <> 'NOK' THEN 1 ELSE 0 END AS TINYINT) AS is_international,
    CAST(0 AS TINYINT) AS is_flagged, CAST(3 AS BIGINT) AS etl_batch_id, transaction_time, transaction_subtype, channel, CAST(NULL AS DECIMAL(15,2)) AS running_balance, merchant_id, merchant_name, merchant_category, counterparty_acct,
    reference_number, description_text, CAST(NULL AS VARCHAR) AS flag_reason, posting_date, value_date, TIMESTAMP '2024-02-01 02:00:00' AS etl_insert_ts FROM loaded""",
    "recon_report": with_clause("duckdb", "stg_transactions", "dim_account", "dim_customer", "dim_exchange_rates")
    + f""", {_LOADED} SELECT 'DAILY_RECONCILIATION' AS report_type, DATE '{LOAD_DATE}' AS report_date, CAST(3 AS BIGINT) AS batch_id, *, staged_rows - loaded_rows - error_rows AS dropped_rows FROM (SELECT (SELECT COUNT(*) FROM stg_transactions) AS staged_rows, (SELECT COUNT(*) FROM loaded) AS loaded_rows,
    (SELECT COUNT(*) FROM stg_transactions WHERE account_id NOT IN (SELECT account_id FROM dim_account)) AS error_rows, (SELECT COUNT(*) FROM loaded WHERE currency_code <> 'NOK' AND rate = 0) AS missing_fx_rows)""",
    "staging_check": _sql("SELECT 'STAGING_CHECK' AS step_name, COUNT(*) AS row_count, MIN(load_date) AS min_date, MAX(load_date) AS max_date, COUNT(DISTINCT account_id) AS distinct_accounts FROM stg_transactions", "stg_transactions"),
    "next_batch_id": _sql("SELECT COALESCE(MAX(etl_batch_id), 0) + 1 AS batch_id FROM fact_transaction", "fact_transaction"),
    "monthly_snapshot_agg": with_clause("duckdb", "fact_transaction", "dim_account", "dim_customer", "fact_monthly_account_snapshot")
    + f""", {_SNAP} SELECT account_key, CAST(total_debits AS DECIMAL(38,2)) AS total_debits, CAST(total_credits AS DECIMAL(38,2)) AS total_credits, debit_count, credit_count, CAST(interest_earned AS DECIMAL(38,2)) AS interest_earned, CAST(interest_charged AS DECIMAL(38,2)) AS interest_charged, CAST(fees_charged AS DECIMAL(38,2)) AS fees_charged,
    minimum_balance, maximum_balance, CAST(average_balance AS DECIMAL(38,2)) AS average_balance, days_in_overdraft FROM act""",
    "monthly_snapshot_merge": with_clause("duckdb", "fact_transaction", "dim_account", "dim_customer", "fact_monthly_account_snapshot")
    + f""", {_SNAP}, old AS (SELECT * FROM fact_monthly_account_snapshot WHERE snapshot_month_key = 200103)
    SELECT COALESCE(f.account_key, o.account_key) AS account_key, 200103 AS snapshot_month_key, {_merge()}
    FROM fresh f FULL JOIN old o USING (account_key) WHERE CASE WHEN o.account_key IS NULL THEN f.customer_key ELSE o.customer_key END IS NOT NULL""",
    "scd2_expired": with_clause("duckdb", "dim_customer", "stg_customer") + f", {_CHANGED} SELECT customer_key, customer_id, 'N' AS current_flag, TIMESTAMP '2024-02-01 02:00:00' AS effective_to, CAST(3 AS BIGINT) AS etl_batch_id FROM changed",
    "scd2_inserted": with_clause("duckdb", "dim_customer", "stg_customer")
    + f""", {_CHANGED} SELECT n.* REPLACE (COALESCE(n.country_code, 'NOR') AS country_code), COALESCE(b.onboarding_date, DATE '2024-02-01') AS onboarding_date, DATE '2024-02-01' AS last_review_date, 1 AS is_active, TIMESTAMP '2024-02-01 02:00:00' AS effective_from, TIMESTAMP '9999-12-31 23:59:59' AS effective_to,
    'Y' AS current_flag, CAST(3 AS BIGINT) AS etl_batch_id, TIMESTAMP '2024-02-01 02:00:00' AS etl_insert_ts, TIMESTAMP '2024-02-01 02:00:00' AS etl_update_ts FROM stg_customer n
    LEFT JOIN dim_customer b ON b.customer_id = n.customer_id WHERE n.customer_id NOT IN (SELECT customer_id FROM dim_customer WHERE current_flag = 'Y' AND customer_key NOT IN (SELECT customer_key FROM changed))""",
    "row_counts": _sql(
        " UNION ALL ".join(f"SELECT '{n.upper()}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in ("dim_customer", "dim_account", "dim_product", "dim_branch", "fact_transaction", "fact_monthly_account_snapshot"))
        + " UNION ALL SELECT 'DIM_DATE', COUNT(*) FROM range(DATE '1995-01-01', DATE '2030-01-01', INTERVAL 1 DAY)",
        "dim_customer", "dim_account", "dim_product", "dim_branch", "fact_transaction", "fact_monthly_account_snapshot",
    ),
    "customer_checksum": _sql("SELECT COUNT(*) AS row_count, COUNT(DISTINCT customer_id) AS distinct_customers, MIN(onboarding_date) AS min_onboard_date, MAX(onboarding_date) AS max_onboard_date, COUNT(*) FILTER (is_active = 1) AS active_count FROM dim_customer WHERE current_flag = 'Y'", "dim_customer"),
    "txn_monthly_checksum": _sql(
        """SELECT CAST(year(transaction_date) AS INT) AS txn_year, CAST(month(transaction_date) AS INT) AS txn_month, COUNT(*) AS txn_count, CAST(SUM(transaction_amount) AS DECIMAL(38,2)) AS total_amount, CAST(SUM(base_currency_amount) AS DECIMAL(38,2)) AS total_base_amount, COUNT(DISTINCT account_key) AS distinct_accounts,
        COUNT(DISTINCT customer_key) AS distinct_customers, COUNT(*) FILTER (transaction_type = 'DEBIT') AS debit_count, COUNT(*) FILTER (transaction_type = 'CREDIT') AS credit_count, COUNT(*) FILTER (is_international = 1) AS intl_count FROM fact_transaction GROUP BY 1, 2""",
        "fact_transaction",
    ),
    "balance_reconciliation": _sql(
        """SELECT snapshot_month_key, CAST(SUM(closing_balance) AS DECIMAL(38,2)) AS total_deposits, CAST(SUM(total_debits) AS DECIMAL(38,2)) AS total_debits, CAST(SUM(total_credits) AS DECIMAL(38,2)) AS total_credits, CAST(SUM(interest_earned) AS DECIMAL(38,2)) AS total_interest,
        CAST(SUM(fees_charged) AS DECIMAL(38,2)) AS total_fees, COUNT(*) AS account_count FROM fact_monthly_account_snapshot GROUP BY 1""",
        "fact_monthly_account_snapshot",
    ),
    "orphan_checks": _sql(
        """SELECT 'FACT_TXN -> DIM_ACCOUNT' AS check_name, (SELECT COUNT(*) FROM fact_transaction WHERE account_key NOT IN (SELECT account_key FROM dim_account)) AS orphan_count
        UNION ALL SELECT 'FACT_TXN -> DIM_CUSTOMER', (SELECT COUNT(*) FROM fact_transaction WHERE customer_key NOT IN (SELECT customer_key FROM dim_customer))
        UNION ALL SELECT 'SNAPSHOT -> DIM_ACCOUNT', (SELECT COUNT(*) FROM fact_monthly_account_snapshot WHERE account_key NOT IN (SELECT account_key FROM dim_account))""",
        "fact_transaction", "dim_account", "dim_customer", "fact_monthly_account_snapshot",
    ),
    "dim_date": """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS calendar_date, CAST(isodow(d) AS TINYINT) AS day_of_week, strftime(d, '%A') AS day_name, CAST(day(d) AS TINYINT) AS day_of_month, CAST(dayofyear(d) AS SMALLINT) AS day_of_year, CAST(weekofyear(d) AS TINYINT) AS iso_week,
        CAST(month(d) AS TINYINT) AS month_num, strftime(d, '%B') AS month_name, strftime(d, '%b') AS month_short, CAST(quarter(d) AS TINYINT) AS quarter_num, 'Q' || CAST(quarter(d) AS VARCHAR) AS quarter_name, CAST(year(d) AS SMALLINT) AS calendar_year, CAST(CASE WHEN isodow(d) > 5 THEN 1 ELSE 0 END AS TINYINT) AS is_weekend,
        CAST(CASE WHEN day(d + INTERVAL 1 DAY) = 1 THEN 1 ELSE 0 END AS TINYINT) AS is_month_end, CAST(d - INTERVAL 1 DAY AS DATE) AS prior_day_date, CAST(d + INTERVAL 1 DAY AS DATE) AS next_day_date, CAST(d - INTERVAL 12 MONTH AS DATE) AS same_day_prev_year,
        CAST(weekofyear(d) AS TINYINT) AS week_of_year, CAST(CASE WHEN month(d) <= 6 THEN 1 ELSE 2 END AS TINYINT) AS half_year, CAST(year(d) AS SMALLINT) AS fiscal_year, CAST(quarter(d) AS TINYINT) AS fiscal_quarter, CAST(0 AS TINYINT) AS is_norwegian_holiday, CAST(NULL AS VARCHAR) AS holiday_name,
        CAST(CASE WHEN isodow(d) > 5 THEN 0 ELSE 1 END AS TINYINT) AS is_business_day, CAST(CASE WHEN day(d + INTERVAL 1 DAY) = 1 AND month(d) IN (3, 6, 9, 12) THEN 1 ELSE 0 END AS TINYINT) AS is_quarter_end, CAST(CASE WHEN month(d) = 12 AND day(d) = 31 THEN 1 ELSE 0 END AS TINYINT) AS is_year_end
        FROM range(DATE '1995-01-01', DATE '2030-01-01', INTERVAL 1 DAY) t(d)""",
    "export_large_txn": _sql(
        f"""SELECT lpad(CAST(transaction_id AS VARCHAR), 19, ' ') AS transaction_id, strftime(transaction_date, '%Y-%m-%d') AS transaction_date, lpad(CAST(customer_id AS VARCHAR), 10, ' ') AS customer_id, rpad(last_name, 50, ' ') AS last_name, rpad(reporting_category, 25, ' ') AS reporting_category, CAST(is_international AS VARCHAR) AS is_international,
        {', '.join(f"rpad(COALESCE({c}, ''), {w}, ' ') AS {c}" for c, w in (("first_name", 50), ("kyc_status", 15), ("account_id", 20), ("account_type", 20), ("transaction_type", 20), ("transaction_currency", 3), ("merchant_name", 100), ("reference_number", 30)))},
        {_amount("transaction_amount", 15, True)} AS transaction_amount, {_amount("base_currency_amount", 15, True)} AS base_currency_amount
        FROM ({_V2}) WHERE transaction_date BETWEEN DATE '{AS_OF}' - INTERVAL 1 MONTH AND DATE '{AS_OF}'""",
        "fact_transaction", "dim_account", "dim_customer", "dim_branch",
    ),
    "export_branch_performance": with_clause("duckdb", "fact_monthly_account_snapshot", "dim_branch")
    + ", " + _V3 + f""" SELECT rpad(branch_name, 40, ' ') AS "Branch", rpad(region, 15, ' ') AS "Region", rpad(month_label, 20, ' ') AS "Month", lpad(CAST(accounts_serviced AS VARCHAR), 7, ' ') AS "Accounts", lpad(CAST(region_deposit_rank AS VARCHAR), 2, ' ') AS "Rank",
    {_amount("total_deposits", 18)} AS "Total Deposits (NOK)", {_amount("total_fees_earned", 14)} AS "Fees Earned", {_amount("pct_of_region_deposits", 6)} AS "% Region" FROM v3 WHERE snapshot_month_key = 200107""",
    "batch_durations": _sql("SELECT batch_id, batch_date, batch_status, date_sub('second', start_ts, end_ts) AS seconds FROM etl_batch_control", "etl_batch_control"),
}
