"""Banking tables derived from the star-schema test tables, as SQL that both engines run.

History comes from orders, January 2024 from events; a twentieth of the transactions stands in a second batch too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = ("customer", "orders", "events", "nation", "region", "part")
LOAD_DATE = "2024-01-15"


def definitions(dialect: str) -> dict[str, str]:
    """Each table's SQL over the raw tables and earlier definitions. dialect: spark or duckdb; only the addition of days, times of day and the rows of an array differ."""
    plus = (lambda d, n: f"date_add({d}, CAST({n} AS INT))") if dialect == "spark" else (lambda d, n: f"({d} + CAST({n} AS INT))")
    clock = (lambda c: f"date_format({c}, 'HH:mm:ss')") if dialect == "spark" else (lambda c: f"strftime({c}, '%H:%M:%S')")
    each, both, once = ("explode", "array(1L, 2L)", "array(1L)") if dialect == "spark" else ("unnest", "[1::BIGINT, 2::BIGINT]", "[1::BIGINT]")
    money = "DECIMAL(15,2)"
    version = "TIMESTAMP '2018-01-01 00:00:00' AS effective_from, TIMESTAMP '9999-12-31 23:59:59' AS effective_to"
    if dialect == "spark":
        version = version.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    kinds = "CASE {x} % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(("CHECKING", "SAVINGS", "CREDIT_CARD", "LOAN", "MORTGAGE", "INVESTMENT", "FX"))) + " END"
    channels = "CASE {x} % 6 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(("ONLINE", "MOBILE", "BRANCH", "ATM", "POS", "API"))) + " END"
    kyc = "CASE {x} % 4 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(("VERIFIED", "PENDING", "REVIEW", "EXPIRED"))) + " END"
    rest = f"CAST(NULL AS STRING) AS merchant_name, CAST(NULL AS STRING) AS counterparty_acct, {channels.format(x='id')} AS channel, CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS TINYINT) AS is_international, CAST(CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END AS TINYINT) AS is_flagged"
    if dialect == "duckdb":
        rest = rest.replace("STRING", "VARCHAR")
    text = "STRING" if dialect == "spark" else "VARCHAR"
    return {
        "dim_customer": f"""SELECT c_custkey AS customer_key, CAST(c_custkey AS INT) AS customer_id, 'Customer' AS first_name, c_name AS last_name,
            c_mktsegment AS customer_segment, CAST(c_custkey % 100 AS DECIMAL(5,2)) AS risk_score, 'AA' AS credit_rating, {kyc.format(x='c_custkey')} AS kyc_status,
            {plus("DATE '2018-01-01'", 'c_custkey * 37 % 2200')} AS onboarding_date, CAST(1 AS TINYINT) AS is_active, 'City ' || CAST(c_nationkey AS {text}) AS city, 'NOR' AS country_code,
            CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'SINGLE' END AS marital_status, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'c' || CAST(c_custkey AS {text}) || '@mail.no' END AS email_address, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '47' || CAST(c_custkey AS {text}) END AS phone_number,
            'Street ' || CAST(c_custkey AS {text}) AS address_line_1, CAST(NULL AS {text}) AS state_province, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '0' || CAST(c_custkey % 900 + 100 AS {text}) END AS postal_code,
            CASE WHEN c_custkey % 11 = 0 THEN 'N' ELSE 'Y' END AS current_flag, {version}, CAST(0 AS BIGINT) AS etl_batch_id, CAST(NULL AS TIMESTAMP) AS etl_update_ts FROM customer""",
        "dim_account": f"""SELECT account_key, 'ACCT-' || CAST(account_key AS {text}) AS account_id, CAST(c_custkey AS INT) AS customer_id, {kinds.format(x='account_key')} AS account_type, 'NOK' AS currency_code,
            CASE account_key % 9 WHEN 0 THEN 'DORMANT' WHEN 1 THEN 'CLOSED' ELSE 'ACTIVE' END AS account_status, CAST((account_key % 5) * 1000 AS {money}) AS overdraft_limit,
            c_nationkey AS branch_id, CAST(1 + account_key % 10 AS INT) AS product_id, 'Y' AS current_flag
            FROM (SELECT c_custkey, c_nationkey, c_custkey * 2 + d AS account_key FROM customer CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1 AS d) ds)""",
        "dim_branch": f"""SELECT n_nationkey AS branch_id, n_name AS branch_name, CASE WHEN n_nationkey % 3 = 0 THEN 'HEAD_OFFICE' ELSE 'FULL_SERVICE' END AS branch_type, r_name AS region,
            'City ' || CAST(n_nationkey AS {text}) AS city, CAST(CASE WHEN n_nationkey % 8 = 7 THEN 0 ELSE 1 END AS TINYINT) AS is_active FROM nation JOIN region ON n_regionkey = r_regionkey""",
        "dim_product": "SELECT CAST(p_partkey AS INT) AS product_id, p_name AS product_name FROM part WHERE p_partkey <= 10",
        "txn_once": f"""SELECT id AS transaction_id, CAST(ts AS DATE) AS transaction_date, ts AS transaction_ts, account_key, customer_key, transaction_type, CAST(NULL AS {text}) AS transaction_subtype,
            amount AS transaction_amount, 'NOK' AS transaction_currency, amount AS base_currency_amount, {rest}, 'REF-' || CAST(id AS {text}) AS reference_number, CAST(NULL AS {text}) AS description_text,
            CAST(account_key % 25 AS INT) AS branch_id, CAST(1 + account_key % 10 AS INT) AS product_id, CAST(1 AS DECIMAL(12,6)) AS exchange_rate,
            CAST(SUM(CASE WHEN transaction_type IN ('CREDIT', 'INTEREST') THEN amount ELSE -amount END) OVER (PARTITION BY account_key ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {money}) AS running_balance
            FROM (SELECT o_orderkey AS id, o_orderdate AS ts, o_custkey * 2 + o_orderkey % 2 AS account_key, o_custkey AS customer_key,
                    CASE o_orderstatus WHEN 'F' THEN 'DEBIT' WHEN 'O' THEN 'CREDIT' ELSE CASE o_orderkey % 3 WHEN 0 THEN 'FEE' WHEN 1 THEN 'INTEREST' ELSE 'TRANSFER' END END AS transaction_type,
                    CAST(CASE WHEN (o_orderstatus = 'F' AND o_orderkey % 6 = 0) OR (o_orderstatus = 'P' AND o_orderkey % 15 = 1) THEN -o_totalprice ELSE o_totalprice END AS {money}) AS amount FROM orders
                  UNION ALL
                  SELECT 1000000000 + event_id, ts, user_id * 2 + event_id % 2, user_id,
                    CASE event_type WHEN 'purchase' THEN 'DEBIT' WHEN 'signup' THEN 'CREDIT' WHEN 'click' THEN 'TRANSFER' WHEN 'view' THEN 'INTEREST' ELSE 'FEE' END, CAST(ROUND(value * 1000, 2) AS {money}) FROM events) u""",
        "fact_transaction": f"""SELECT t.*, {each}(CASE WHEN transaction_id % 20 = 0 THEN {both} ELSE {once} END) AS etl_batch_id FROM txn_once t""",
        "fact_monthly_account_snapshot": f"""SELECT {'last_day(month_start)'} AS snapshot_date, CAST(YEAR(month_start) * 100 + MONTH(month_start) AS INT) AS snapshot_month_key, account_key, customer_key, branch_id, product_id, 'NOK' AS currency_code,
            CAST(SUM(credits - debits) OVER (PARTITION BY account_key ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - credits + debits AS {money}) AS opening_balance,
            CAST(SUM(credits - debits) OVER (PARTITION BY account_key ORDER BY month_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {money}) AS closing_balance,
            CAST(debits AS {money}) AS total_debits, CAST(credits AS {money}) AS total_credits, CAST(fees AS DECIMAL(12,2)) AS fees_charged, CAST(interest AS DECIMAL(12,2)) AS interest_earned, CAST(charged AS DECIMAL(12,2)) AS interest_charged,
            CAST(n_debits AS INT) AS debit_count, CAST(n_credits AS INT) AS credit_count, least_balance AS minimum_balance, most_balance AS maximum_balance, CAST(NULL AS {money}) AS average_balance, CAST(0 AS SMALLINT) AS days_in_overdraft, CAST(0 AS SMALLINT) AS days_dormant,
            CAST(NULL AS {money}) AS base_currency_closing, CAST(1 AS BIGINT) AS etl_batch_id
            FROM (SELECT account_key, customer_key, branch_id, product_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month_start,
                    SUM(CASE WHEN transaction_type IN ('DEBIT', 'FEE') THEN ABS(transaction_amount) ELSE 0 END) AS debits, SUM(CASE WHEN transaction_type IN ('CREDIT', 'INTEREST') THEN transaction_amount ELSE 0 END) AS credits,
                    SUM(CASE WHEN transaction_type = 'FEE' THEN transaction_amount ELSE 0 END) AS fees, SUM(CASE WHEN transaction_type = 'INTEREST' AND transaction_amount > 0 THEN transaction_amount ELSE 0 END) AS interest,
                    SUM(CASE WHEN transaction_type = 'INTEREST' AND transaction_amount < 0 THEN -transaction_amount ELSE 0 END) AS charged, SUM(CASE WHEN transaction_type IN ('DEBIT', 'FEE') THEN 1 ELSE 0 END) AS n_debits,
                    SUM(CASE WHEN transaction_type IN ('CREDIT', 'INTEREST') THEN 1 ELSE 0 END) AS n_credits, MIN(running_balance) AS least_balance, MAX(running_balance) AS most_balance
                    FROM txn_once WHERE transaction_date < DATE '2024-01-01' GROUP BY 1, 2, 3, 4, 5) m""",
        "stg_transactions": f"""SELECT CAST(ts AS DATE) AS load_date, 2000000000 + event_id AS transaction_id, CAST(ts AS DATE) AS transaction_date, {clock('ts')} AS transaction_time,
            CASE WHEN event_id % 13 = 0 THEN 'ACCT-UNKNOWN' ELSE 'ACCT-' || CAST(user_id * 2 + event_id % 2 AS {text}) END AS account_id, CASE WHEN event_type = 'purchase' THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type,
            CAST(NULL AS {text}) AS transaction_subtype, 'ONLINE' AS channel, CAST(ROUND(value * 1000, 2) AS {money}) AS transaction_amount,
            CASE event_id % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'SEK' WHEN 4 THEN NULL ELSE 'NOK' END AS currency_code, CAST(NULL AS {text}) AS merchant_id, CAST(NULL AS {text}) AS merchant_name, CAST(NULL AS {text}) AS merchant_category,
            CAST(NULL AS {text}) AS counterparty_acct, 'STG-' || CAST(event_id AS {text}) AS reference_number, CAST(NULL AS {text}) AS description_text, CAST(ts AS DATE) AS posting_date, CAST(ts AS DATE) AS value_date
            FROM events WHERE CAST(ts AS DATE) = DATE '{LOAD_DATE}'""",
        "dim_exchange_rates": f"""SELECT 'EUR' AS from_currency, 'NOK' AS to_currency, DATE '{LOAD_DATE}' AS rate_date, CAST(11.25 AS DECIMAL(12,6)) AS exchange_rate
            UNION ALL SELECT 'USD', 'NOK', DATE '{LOAD_DATE}', CAST(10.375 AS DECIMAL(12,6)) UNION ALL SELECT 'NOK', 'EUR', DATE '{LOAD_DATE}', CAST(0.089 AS DECIMAL(12,6))""",
        "etl_batch_control": """SELECT CAST(day(ts) AS BIGINT) AS batch_id, CAST(ts AS DATE) AS batch_date, CASE WHEN day(ts) % 5 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS batch_status, MIN(ts) AS start_ts, MAX(ts) AS end_ts FROM events GROUP BY 1, 2, 3""",
        "stg_customer": f"""SELECT customer_id, first_name, last_name, CAST(NULL AS DATE) AS date_of_birth, CAST(NULL AS {text}) AS gender,
            CASE customer_id % 8 WHEN 1 THEN NULL WHEN 4 THEN 'MARRIED' ELSE marital_status END AS marital_status,
            CASE customer_id % 10 WHEN 0 THEN '' WHEN 5 THEN 'new@mail.no' WHEN 1 THEN UPPER(email_address) WHEN 7 THEN NULL ELSE email_address END AS email_address,
            CASE WHEN customer_id % 21 = 0 THEN '' WHEN customer_id % 33 = 0 THEN '00' ELSE phone_number END AS phone_number,
            CASE WHEN customer_id % 9 = 0 THEN UPPER(address_line_1) ELSE address_line_1 END AS address_line_1, CAST(NULL AS {text}) AS address_line_2, CASE WHEN customer_id % 15 = 0 THEN 'Elsewhere' ELSE city END AS city,
            CASE WHEN customer_id % 27 = 0 THEN 'North' ELSE state_province END AS state_province, CASE WHEN customer_id % 12 = 0 THEN '0155' WHEN customer_id % 39 = 0 THEN NULL ELSE postal_code END AS postal_code, country_code,
            CASE WHEN customer_id % 6 = 0 AND customer_id % 4 = 0 THEN 'PREMIUM' ELSE LOWER(customer_segment) END AS customer_segment, risk_score, credit_rating, kyc_status FROM dim_customer WHERE customer_id % 3 = 0
            UNION ALL SELECT customer_id + 10000000, 'New', last_name, CAST(NULL AS DATE), CAST(NULL AS {text}), marital_status, email_address, phone_number, address_line_1, CAST(NULL AS {text}), city, state_province, postal_code, CAST(NULL AS {text}), customer_segment, risk_score, credit_rating, kyc_status
            FROM dim_customer WHERE customer_id % 50 = 0""",
    }


def _needed(name: str, found: dict[str, str]) -> list[str]:
    """The definitions that name rests on, in order, itself last."""
    import re

    out: list[str] = []
    for other in found:
        if other != name and re.search(rf"\b{other}\b", found[name]):
            out += [x for x in _needed(other, found) if x not in out]
    return [*out, name]


def with_clause(dialect: str, *names: str) -> str:
    """WITH ... for the given tables and what they rest on."""
    found, order = definitions(dialect), []
    for n in names:
        order += [x for x in _needed(n, found) if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({found[n]})" for n in order)


class Mapped(dict):
    """The banking tables of a folder of test tables, each made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str, **extra: DataFrame):
        super().__init__(extra)
        self.spark, self.dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        import re

        raw = {r: self.spark.read.parquet(f"{self.dir}/{r}.parquet") for r in RAW}
        query = with_clause("spark", name)
        used = [r for r in RAW if re.search(rf"\b(FROM|JOIN) {r}\b", query)]
        query = re.sub(rf"\b(FROM|JOIN) ({'|'.join(RAW)})\b", r"\1 {\2}", query) + f" SELECT * FROM {name}"
        self[name] = self.spark.sql(query, **{r: raw[r] for r in used})
        return self[name]
