"""Typed tables of the warehouse: columns, defaults, keys, and whether duplicate rows are refused."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The end of a version that is still open, and the home currency and country.
OPEN_END = "9999-12-31 23:59:59"
HOME_CURRENCY = "NOK"
HOME_COUNTRY = "NOR"
NOW = "now"

_VERSION = "effective_from timestamp_ntz, effective_to timestamp_ntz, current_flag string, etl_batch_id bigint, etl_insert_ts timestamp_ntz, etl_update_ts timestamp_ntz"
_VERSION_DEFAULTS = {"effective_from": NOW, "effective_to": OPEN_END, "current_flag": "Y", "etl_insert_ts": NOW, "etl_update_ts": NOW}


@dataclass(frozen=True)
class Table:
    name: str
    ddl: str
    key: tuple[str, ...]
    unique: bool = True
    distinct_rows: bool = False
    identity: str | None = None
    month_of: str | None = None
    by: str | None = None
    defaults: dict = field(default_factory=dict)
    ignore_case: tuple[str, ...] = ()
    comment: str = ""

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


TABLES = {
    t.name: t
    for t in (
        Table(
            "dim_customer",
            "customer_id int not null, customer_key bigint not null, first_name string not null, last_name string not null, date_of_birth date, gender string, marital_status string, email_address string, phone_number string, address_line_1 string, address_line_2 string, city string, state_province string, postal_code string, country_code string, customer_segment string, risk_score decimal(5,2), credit_rating string, kyc_status string, onboarding_date date not null, last_review_date date, is_active tinyint, " + _VERSION,
            ("customer_key",), distinct_rows=True, identity="customer_key",
            defaults={"country_code": HOME_COUNTRY, "kyc_status": "PENDING", "is_active": 1} | _VERSION_DEFAULTS,
            ignore_case=("first_name", "last_name", "email_address", "address_line_1", "address_line_2", "city", "state_province", "country_code", "customer_segment", "kyc_status"),
            comment="a version of a customer",
        ),
        Table(
            "dim_account",
            "account_key bigint not null, account_id string not null, customer_id int not null, account_type string not null, account_subtype string, currency_code string, opening_date date not null, closing_date date, account_status string, interest_rate decimal(7,4), credit_limit decimal(15,2), overdraft_limit decimal(15,2), branch_id int, relationship_mgr_id int, product_id int not null, is_joint_account tinyint, tax_reporting_flag tinyint, " + _VERSION,
            ("account_key",), identity="account_key",
            defaults={"currency_code": HOME_CURRENCY, "account_status": "ACTIVE", "overdraft_limit": 0, "is_joint_account": 0, "tax_reporting_flag": 1} | _VERSION_DEFAULTS,
            comment="a version of an account",
        ),
        Table(
            "dim_product",
            "product_id int not null, product_code string not null, product_name string not null, product_category string not null, product_subcategory string, base_interest_rate decimal(7,4), min_balance decimal(15,2), max_balance decimal(15,2), fee_structure string, monthly_fee decimal(10,2), is_regulated tinyint, regulatory_code string, launch_date date, discontinue_date date, is_active tinyint, etl_batch_id bigint, etl_insert_ts timestamp_ntz",
            ("product_id",), distinct_rows=True, defaults={"min_balance": 0, "monthly_fee": 0, "is_regulated": 1, "is_active": 1, "etl_insert_ts": NOW}, comment="a product",
        ),
        Table(
            "dim_branch",
            "branch_id int not null, branch_code string not null, branch_name string not null, branch_type string, city string, county string, region string, postal_code string, country_code string, latitude decimal(10,7), longitude decimal(10,7), manager_id int, opening_date date, closing_date date, is_active tinyint, employee_count smallint, etl_batch_id bigint, etl_insert_ts timestamp_ntz",
            ("branch_id",), distinct_rows=True, defaults={"country_code": HOME_COUNTRY, "is_active": 1, "etl_insert_ts": NOW}, comment="a branch",
        ),
        Table(
            "dim_date",
            "date_key int not null, calendar_date date not null, day_of_week tinyint not null, day_name string not null, day_of_month tinyint not null, day_of_year smallint not null, week_of_year tinyint not null, iso_week tinyint not null, month_num tinyint not null, month_name string not null, month_short string not null, quarter_num tinyint not null, quarter_name string not null, half_year tinyint not null, calendar_year smallint not null, fiscal_year smallint not null, fiscal_quarter tinyint not null, is_weekend tinyint not null, is_norwegian_holiday tinyint, holiday_name string, is_business_day tinyint not null, is_month_end tinyint not null, is_quarter_end tinyint not null, is_year_end tinyint not null, prior_day_date date, next_day_date date, same_day_prev_year date",
            ("date_key",), distinct_rows=True, defaults={"is_norwegian_holiday": 0}, comment="a calendar day",
        ),
        Table(
            "fact_transaction",
            "transaction_id bigint not null, transaction_date date not null, transaction_time string, transaction_ts timestamp_ntz, account_key bigint not null, customer_key bigint not null, product_id int not null, branch_id int, date_key int not null, transaction_type string not null, transaction_subtype string, channel string, transaction_amount decimal(15,2) not null, transaction_currency string, base_currency_amount decimal(15,2), exchange_rate decimal(12,6), running_balance decimal(15,2), merchant_id string, merchant_name string, merchant_category string, counterparty_acct string, reference_number string, description_text string, is_international tinyint, is_flagged tinyint, flag_reason string, posting_date date, value_date date, etl_batch_id bigint, etl_insert_ts timestamp_ntz",
            ("account_key", "transaction_date"), unique=False, month_of="transaction_date",
            defaults={"transaction_currency": HOME_CURRENCY, "exchange_rate": 1, "is_international": 0, "is_flagged": 0, "etl_insert_ts": NOW}, comment="one transaction",
        ),
        Table(
            "fact_monthly_account_snapshot",
            "snapshot_date date not null, snapshot_month_key int not null, account_key bigint not null, customer_key bigint not null, product_id int not null, branch_id int, opening_balance decimal(15,2) not null, closing_balance decimal(15,2) not null, average_balance decimal(15,2), minimum_balance decimal(15,2), maximum_balance decimal(15,2), total_debits decimal(15,2), total_credits decimal(15,2), debit_count int, credit_count int, interest_earned decimal(12,2), interest_charged decimal(12,2), fees_charged decimal(12,2), days_in_overdraft smallint, days_dormant smallint, currency_code string, base_currency_closing decimal(15,2), etl_batch_id bigint, etl_insert_ts timestamp_ntz",
            ("account_key", "snapshot_month_key"), unique=False, month_of="snapshot_date",
            defaults=dict.fromkeys(("total_debits", "total_credits", "debit_count", "credit_count", "interest_earned", "interest_charged", "fees_charged", "days_in_overdraft", "days_dormant"), 0) | {"currency_code": HOME_CURRENCY, "etl_insert_ts": NOW},
            comment="an account in a month",
        ),
        Table("dim_exchange_rates", "from_currency string, to_currency string, rate_date date, exchange_rate decimal(12,6)", ("from_currency", "to_currency", "rate_date"), comment="a currency's rate on a day"),
        Table("stg_transactions", "load_date date, transaction_id bigint, transaction_date date, transaction_time string, account_id string, transaction_type string, transaction_subtype string, channel string, transaction_amount decimal(15,2), currency_code string, merchant_id string, merchant_name string, merchant_category string, counterparty_acct string, reference_number string, description_text string, posting_date date, value_date date", (), unique=False, by="load_date"),
        Table("stg_transaction_errors", "load_date date, transaction_id bigint, transaction_date date, transaction_time string, account_id string, transaction_type string, transaction_subtype string, channel string, transaction_amount decimal(15,2), currency_code string, merchant_id string, merchant_name string, merchant_category string, counterparty_acct string, reference_number string, description_text string, posting_date date, value_date date, error_reason string, batch_id bigint", (), unique=False, by="load_date"),
        Table("stg_customer", "customer_id int, first_name string, last_name string, date_of_birth date, gender string, marital_status string, email_address string, phone_number string, address_line_1 string, address_line_2 string, city string, state_province string, postal_code string, country_code string, customer_segment string, risk_score decimal(5,2), credit_rating string, kyc_status string", ("customer_id",)),
        Table("etl_log", "procedure_name string, batch_id bigint, log_level string, log_message string, log_ts timestamp_ntz", (), unique=False),
        Table("etl_batch_control", "batch_id bigint, batch_date date, batch_status string, start_ts timestamp_ntz, end_ts timestamp_ntz", (), unique=False),
    )
}


def _literal(value: object, run_ts: Column) -> Column:
    return run_ts if value == NOW else F.lit(value)


def align(df: DataFrame, table: Table, run_ts: Column | None = None) -> DataFrame:
    """df with exactly the table's columns and types. A column that df lacks takes its default, or null; an explicit null stays."""
    run_ts = F.current_timestamp() if run_ts is None else run_ts
    have = {c.lower() for c in df.columns}
    out = []
    for f in table.schema.fields:
        value = F.col(f.name) if f.name in have else _literal(table.defaults[f.name], run_ts) if f.name in table.defaults else F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name, metadata={"comment": table.comment}))
    out = df.select(*out)
    return out.dropDuplicates() if table.distinct_rows else out


def violations(df: DataFrame, table: Table) -> DataFrame:
    """One row: how many nulls stand in columns that forbid them, and how many keys occur more than once."""
    required = [f.name for f in table.schema.fields if not f.nullable]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required] or [F.lit(0).alias("null_none")])
    if not (table.unique and table.key):
        return nulls.withColumn("repeated_keys", F.lit(0).cast("long"))
    repeated = df.groupBy(*table.key).count().where("count > 1").agg(F.count("*").alias("repeated_keys"))
    return nulls.crossJoin(repeated)


def assign_identity(df: DataFrame, existing: DataFrame, table: Table, order: list[str]) -> DataFrame:
    """df with the table's identity column numbered after the largest existing value, in a stable order.

    Ranges are numbered in parallel: rows are range-partitioned by the order, and each takes its partition's start (from one count a
    partition) plus its place in the partition."""
    column = table.identity
    assert column
    top = existing.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    ranged = df.drop(column).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)).persist()
    sizes = {r[0]: r[1] for r in ranged.groupBy("__p").count().collect()}
    start, starts = top + 1, []
    for p in sorted(sizes):
        starts.append((p, start))
        start += sizes[p]
    offsets = df.sparkSession.createDataFrame(starts or [(0, top + 1)], "__p int, __s long")
    return ranged.join(F.broadcast(offsets), "__p").withColumn(column, F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")
