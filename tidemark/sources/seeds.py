"""Seed files: pipe-separated text with a header, read with declared types, since postal codes have leading zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import TABLES

#: The columns of each seed file, in order; types are the table's.
COLUMNS = {
    "dim_customer": "customer_id first_name last_name date_of_birth gender marital_status email_address phone_number address_line_1 address_line_2 city state_province postal_code country_code customer_segment risk_score credit_rating kyc_status onboarding_date is_active",
    "dim_account": "account_id customer_id account_type account_subtype currency_code opening_date account_status interest_rate credit_limit overdraft_limit branch_id product_id is_joint_account",
    "dim_product": "product_id product_code product_name product_category product_subcategory base_interest_rate min_balance fee_structure monthly_fee is_regulated launch_date is_active",
    "dim_branch": "branch_id branch_code branch_name branch_type city county region postal_code country_code latitude longitude opening_date is_active employee_count",
}
EXPECTED = "table_name string, expected_row_count bigint, as_of_date date, notes string"


def read_seed(spark: SparkSession, path: str, table: str) -> DataFrame:
    types = {f.name: f.dataType for f in TABLES[table].schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in COLUMNS[table].split()])
    return spark.read.csv(path, sep="|", header=True, schema=schema, enforceSchema=True)


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", header=True, schema=EXPECTED)
