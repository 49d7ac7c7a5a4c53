"""Deterministic loan-application table derived from the driver's tables.

One application per order (orders joined to its customer). Values are pure
functions of the order key and the customer's balance / segment, so the
table grows with ``orders`` and needs no randomness. ``APPLICATIONS_SQL`` is
the same table in plain SQL, used by the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affordspark.sources.io import ingest_snapshot, read_table


def applications_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw applications: 27 loan columns plus ``application_id``, as a lazy
    plan over orders x customer. Built with one parameterised ``spark.sql``
    call: the parquet DataFrames are passed in (no session-global views)."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return spark.sql(APPLICATIONS_TEMPLATE, orders=orders, customer=customer)


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw applications as an ingested snapshot table (the ingestion
    stage): written once per source version into the shared checkpoint
    folder with enough files for every core, then scanned by every stage.
    Cleaning filters push down onto this parallel scan."""
    sources = [f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet"]
    return ingest_snapshot(spark, "applications", sources, lambda: applications_view(spark, sf_dir))


# The table in SQL; ``{orders}`` / ``{customer}`` are filled with DataFrames
# on Spark and with the view names on DuckDB.
APPLICATIONS_TEMPLATE = r"""
WITH b AS (
  SELECT o.o_orderkey AS k, o.o_totalprice AS price, c.c_acctbal AS bal, c.c_mktsegment AS seg,
         15000 + (o.o_orderkey * 7919) % 185000 AS sal,
         1000 + (o.o_orderkey * 6151) % 800000 AS bank,
         CASE WHEN o.o_orderkey % 2 = 0 THEN (o.o_orderkey * 2503) % 30000 ELSE 0 END AS cur
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
), e AS (
  SELECT b.*, round(CAST(sal AS DOUBLE) * CAST(0.4 AS DOUBLE) - CAST(cur AS DOUBLE), 2) AS emi FROM b
)
SELECT
  k AS application_id,
  CASE WHEN k % 97 = 0 THEN '58.0.0' WHEN k % 89 = 0 THEN NULL
       ELSE concat(CAST(25 + k % 36 AS STRING), ' years') END AS age,
  CASE WHEN k % 101 = 0 THEN ' ' WHEN k % 5 = 0 THEN ' male ' WHEN k % 5 = 1 THEN 'Female'
       WHEN k % 5 = 2 THEN 'F' WHEN k % 5 = 3 THEN 'm' ELSE 'M' END AS gender,
  CASE WHEN k % 3 = 0 THEN 'Single' ELSE 'Married' END AS marital_status,
  CASE WHEN k % 4 = 0 THEN 'High School' WHEN k % 4 = 1 THEN 'Graduate'
       WHEN k % 4 = 2 THEN 'Post Graduate' ELSE 'Professional' END AS education,
  CASE WHEN k % 103 = 0 THEN '₹ 5,000' ELSE CAST(sal AS STRING) END AS monthly_salary,
  CASE WHEN k % 3 = 0 THEN 'Private' WHEN k % 3 = 1 THEN 'Government' ELSE 'Self-employed' END AS employment_type,
  CAST((k * 7) % 82 AS DOUBLE) * CAST(0.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS years_of_employment,
  CASE WHEN (k * 3) % 5 = 0 THEN 'Large Indian' WHEN (k * 3) % 5 = 1 THEN 'MNC'
       WHEN (k * 3) % 5 = 2 THEN 'Mid-size' WHEN (k * 3) % 5 = 3 THEN 'Startup' ELSE 'Small' END AS company_type,
  CASE WHEN k % 7 < 3 THEN 'Rented' WHEN k % 7 < 5 THEN 'Own' ELSE 'Family' END AS house_type,
  CAST(CASE WHEN k % 7 < 3 THEN 5000 + (k * 11) % 20000 ELSE 0 END AS DOUBLE) AS monthly_rent,
  CAST(1 + k % 6 AS DOUBLE) AS family_size,
  CAST(k % 4 AS DOUBLE) AS dependents,
  CAST((k * 13) % 10000 AS DOUBLE) AS school_fees,
  CAST((k * 17) % 15000 AS DOUBLE) AS college_fees,
  CAST(500 + (k * 19) % 8000 AS DOUBLE) AS travel_expenses,
  CAST(3000 + (k * 23) % 20000 AS DOUBLE) AS groceries_utilities,
  CAST(500 + (k * 29) % 9000 AS DOUBLE) AS other_monthly_expenses,
  CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'No' END AS existing_loans,
  CAST(cur AS DOUBLE) AS current_emi_amount,
  CAST(250 + (k * 41) % 650 AS DOUBLE) AS credit_score,
  concat('₹ ', CAST(CAST((bank - bank % 1000) / 1000 AS BIGINT) AS STRING), ',',
         lpad(CAST(bank % 1000 AS STRING), 3, '0')) AS bank_balance,
  round(bal * 30, 2) AS emergency_fund,
  CASE WHEN seg = 'MACHINERY' THEN 'Vehicle EMI' WHEN seg = 'FURNITURE' THEN 'Home Appliances EMI'
       WHEN seg = 'BUILDING' THEN 'Personal Loan EMI' WHEN seg = 'AUTOMOBILE' THEN 'Education EMI'
       ELSE 'E-commerce Shopping EMI' END AS emi_scenario,
  round(price * 3, 2) AS requested_amount,
  CAST(1 + (k * 47) % 130 AS DOUBLE) AS requested_tenure,
  emi AS max_monthly_emi,
  CASE WHEN emi >= 30000 THEN 'Eligible' WHEN emi >= 10000 THEN 'High_Risk' ELSE 'Not_Eligible' END AS emi_eligibility
FROM e
"""

APPLICATIONS_SQL = APPLICATIONS_TEMPLATE.format(orders="orders", customer="customer")
