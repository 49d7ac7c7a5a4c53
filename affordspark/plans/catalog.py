"""Registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``
over the driver's tables (or tables Spark derives from them), with the
matching DuckDB oracle SQL where SQL can express the operator.

Column names are identical on both sides; doubles are rounded to
``common.ROUND`` decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affordspark.functions.scalar import extract_number, to_numeric_safe
from affordspark.operators import clean, features
from affordspark.plans import sqlparts as S
from affordspark.plans.common import round_doubles
from affordspark.schema import COLS_TO_DROP
from affordspark.sources.fixtures import applications
from affordspark.session import prepare
from affordspark.sources.io import read_table, scan_na_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = f"query_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared Spark-side stages over the applications table
# ---------------------------------------------------------------------------

def raw_apps(spark, sf_dir) -> DataFrame:
    return applications(spark, sf_dir)


def parsed_apps(spark, sf_dir) -> DataFrame:
    """drop_na -> names -> parse -> drop_na."""
    df = clean.drop_na_rows(raw_apps(spark, sf_dir))
    df = clean.parse_and_cast(clean.normalize_columns(df))
    return clean.drop_na_rows(df, subset=clean.parsed_columns(df))


def clipped_apps(spark, sf_dir) -> DataFrame:
    return clean.domain_clip(clean.scenario_cap(parsed_apps(spark, sf_dir)))


def cleaned_apps(spark, sf_dir) -> DataFrame:
    return clean.clean_applications(raw_apps(spark, sf_dir))


def engineered_apps(spark, sf_dir) -> DataFrame:
    return features.drop_redundant(features.engineered_features(cleaned_apps(spark, sf_dir)))


# ---------------------------------------------------------------------------
# flagship: rule caps -> engineered features -> per-scenario means
# ---------------------------------------------------------------------------

def scenario_means(spark, sf_dir) -> DataFrame:
    df = features.engineered_features(clean.scenario_cap(parsed_apps(spark, sf_dir)))
    aggs = [F.avg(c).alias(f"avg_{c}") for c in S.ENG_COLS]
    out = df.groupBy("Emi_Scenario").agg(F.count(F.lit(1)).alias("n"), *aggs)
    return round_doubles(out)


register("scenario_means", S.with_(
    S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, S.CAPPED_CTE, S.engineered_cte("capped"),
    select="SELECT Emi_Scenario, count(*) AS n, "
           + ", ".join(f"{S.R(f'avg({c})')} AS avg_{c}" for c in S.ENG_COLS)
           + " FROM eng GROUP BY Emi_Scenario"))(scenario_means)


# ---------------------------------------------------------------------------
# parse group
# ---------------------------------------------------------------------------

def _na_sql(x: str) -> str:
    from affordspark.schema import NA_TOKENS
    toks = ", ".join("'" + t + "'" for t in NA_TOKENS)
    return f"CASE WHEN {x} IN ({toks}) THEN NULL ELSE {x} END"


@register("scan_na_tokens", S.with_(S.RAW_CTE, select=f"""
SELECT application_id, {_na_sql('age')} AS age, {_na_sql('gender')} AS gender,
  {_na_sql('monthly_salary')} AS monthly_salary, {_na_sql('bank_balance')} AS bank_balance,
  {_na_sql('c_name')} AS c_name
FROM raw JOIN (SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey) oc
  ON raw.application_id = oc.o_orderkey"""))
def q_scan_na_tokens(spark, sf_dir):
    names = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey") \
        .join(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
              F.col("o_custkey") == F.col("c_custkey")) \
        .select(F.col("o_orderkey").alias("application_id"), "c_name")
    raw = raw_apps(spark, sf_dir).select("application_id", "age", "gender", "monthly_salary",
                                         "bank_balance")
    return scan_na_tokens(raw.join(names, "application_id"))


@register("extract_number", S.with_(S.RAW_CTE, select=f"""
SELECT application_id, {S.extract('age')} AS age_text, {S.extract('bank_balance')} AS bank_text,
  {S.extract('monthly_salary')} AS salary_text FROM raw"""))
def q_extract_number(spark, sf_dir):
    return raw_apps(spark, sf_dir).select(
        "application_id", extract_number("age").alias("age_text"),
        extract_number("bank_balance").alias("bank_text"),
        extract_number("monthly_salary").alias("salary_text"))


@register("extract_number_props", f"""
SELECT event_id, {S.extract('props')} AS props_text,
  {S.num(S.extract('props'))} AS props_value FROM events""")
def q_extract_number_props(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return round_doubles(ev.select("event_id", extract_number("props").alias("props_text"),
                                   to_numeric_safe(extract_number("props")).alias("props_value")))


@register("to_numeric_safe", S.with_(S.RAW_CTE, select=f"""
SELECT application_id, {S.R(S.num('monthly_salary'))} AS salary,
  {S.R(S.num('age'))} AS age_strict, {S.R(S.num(S.extract('age')))} AS age_value
FROM raw"""))
def q_to_numeric_safe(spark, sf_dir):
    return round_doubles(raw_apps(spark, sf_dir).select(
        "application_id", to_numeric_safe("monthly_salary").alias("salary"),
        to_numeric_safe("age").alias("age_strict"),
        to_numeric_safe(extract_number("age")).alias("age_value")))


@register("parse_and_cast", S.with_(S.RAW_CTE, select=f"""
SELECT application_id, {S.R(S.num(S.extract('age')))} AS Age,
  {S.R(S.num(S.extract('bank_balance')))} AS Bank_Balance,
  {S.R(S.num('monthly_salary'))} AS Monthly_Salary, {S.gender('gender')} AS Gender
FROM raw"""))
def q_parse_and_cast(spark, sf_dir):
    df = clean.normalize_columns(raw_apps(spark, sf_dir))
    return round_doubles(clean.parse_and_cast(df).select("application_id", "Age", "Bank_Balance",
                                                         "Monthly_Salary", "Gender"))


@register("drop_na_rows", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE,
                                  select=f"SELECT {S.rnd(S.CLEAN_COLS)} FROM dropped"))
def q_drop_na_rows(spark, sf_dir):
    return round_doubles(parsed_apps(spark, sf_dir))


@register("normalize_columns", S.with_(S.RAW_CTE, select="""
SELECT application_id, age AS Age, gender AS Gender, marital_status AS Marital_Status,
  education AS Education, monthly_salary AS Monthly_Salary, employment_type AS Employment_Type,
  round(CAST(years_of_employment AS DOUBLE) + 1e-7, 4) AS Years_Of_Employment, company_type AS Company_Type,
  house_type AS House_Type, existing_loans AS Existing_Loans, bank_balance AS Bank_Balance,
  emi_scenario AS Emi_Scenario, emi_eligibility AS Emi_Eligibility
FROM raw"""))
def q_normalize_columns(spark, sf_dir):
    df = clean.normalize_columns(raw_apps(spark, sf_dir))
    return round_doubles(df.select("application_id", "Age", "Gender", "Marital_Status", "Education",
                                   "Monthly_Salary", "Employment_Type", "Years_Of_Employment",
                                   "Company_Type", "House_Type", "Existing_Loans", "Bank_Balance",
                                   "Emi_Scenario", "Emi_Eligibility"))


# ---------------------------------------------------------------------------
# cap group
# ---------------------------------------------------------------------------

@register("scenario_cap", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, S.CAPPED_CTE, select="""
SELECT application_id, Emi_Scenario, round(CAST(Requested_Amount AS DOUBLE) + 1e-7, 4) AS Requested_Amount,
  round(CAST(Requested_Tenure AS DOUBLE) + 1e-7, 4) AS Requested_Tenure FROM capped"""))
def q_scenario_cap(spark, sf_dir):
    df = clean.scenario_cap(parsed_apps(spark, sf_dir))
    return round_doubles(df.select("application_id", "Emi_Scenario", "Requested_Amount",
                                   "Requested_Tenure"))


@register("cap_audit", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, select=f"""
SELECT d.Emi_Scenario,
  CAST(count(*) FILTER (WHERE d.Requested_Amount < r.amount_min) AS BIGINT) AS amount_low,
  CAST(count(*) FILTER (WHERE d.Requested_Amount > r.amount_max) AS BIGINT) AS amount_high,
  CAST(count(*) FILTER (WHERE d.Requested_Tenure < r.tenure_min) AS BIGINT) AS tenure_low,
  CAST(count(*) FILTER (WHERE d.Requested_Tenure > r.tenure_max) AS BIGINT) AS tenure_high
FROM dropped d JOIN {S.RULES_VALUES} ON d.Emi_Scenario = r.scen
GROUP BY d.Emi_Scenario"""))
def q_cap_audit(spark, sf_dir):
    return clean.cap_audit(parsed_apps(spark, sf_dir))


@register("domain_clip", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, S.CAPPED_CTE,
                                 S.CLIPPED_CTE, select="""
SELECT application_id, round(CAST(Credit_Score AS DOUBLE) + 1e-7, 4) AS Credit_Score,
  round(CAST(Years_Of_Employment AS DOUBLE) + 1e-7, 4) AS Years_Of_Employment,
  round(CAST(Requested_Tenure AS DOUBLE) + 1e-7, 4) AS Requested_Tenure, round(CAST(Max_Monthly_Emi AS DOUBLE) + 1e-7, 4) AS Max_Monthly_Emi
FROM clipped"""))
def q_domain_clip(spark, sf_dir):
    return round_doubles(clipped_apps(spark, sf_dir).select(
        "application_id", "Credit_Score", "Years_Of_Employment", "Requested_Tenure",
        "Max_Monthly_Emi"))


@register("quantile_exact", """
SELECT round(CAST(quantile_cont(o_totalprice, 0.99) AS DOUBLE) + 1e-7, 4) AS p99_totalprice,
  round(CAST(quantile_cont(o_totalprice, 0.5) AS DOUBLE) + 1e-7, 4) AS p50_totalprice,
  round(CAST(quantile_cont(o_totalprice, 0.25) AS DOUBLE) + 1e-7, 4) AS p25_totalprice FROM orders""")
def q_quantile_exact(spark, sf_dir):
    """Exact linear-interpolated quantiles by distributed narrowing; the
    three values are combined with the row count of the same table."""
    o = read_table(spark, sf_dir, "orders")
    got = clean.select_quantiles_multi(o, [("o_totalprice", q) for q in (0.99, 0.5, 0.25)])
    return round_doubles(o.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(got[("o_totalprice", 0.99)]).cast("double").alias("p99_totalprice"),
        F.lit(got[("o_totalprice", 0.5)]).cast("double").alias("p50_totalprice"),
        F.lit(got[("o_totalprice", 0.25)]).cast("double").alias("p25_totalprice")))


@register("winsorize_p99", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, S.CAPPED_CTE,
                                   S.CLIPPED_CTE, S.winsor_ctes(),
                                   select=f"SELECT application_id, {S.rnd(S.P99)} FROM cleaned"))
def q_winsorize_p99(spark, sf_dir):
    df = clean.winsorize_p99(clipped_apps(spark, sf_dir))
    return round_doubles(df.select("application_id", *S.P99))


@register("clean_full", S.with_(S.CLEAN_CTES, select=f"SELECT {S.rnd(S.CLEAN_COLS)} FROM cleaned"))
def q_clean_full(spark, sf_dir):
    return round_doubles(cleaned_apps(spark, sf_dir))


@register("scan_csv", S.with_(S.CLEAN_CTES, select=f"SELECT {S.rnd(S.CLEAN_COLS)} FROM cleaned"))
def q_scan_csv(spark, sf_dir):
    """Raw applications as a headered CSV (derived once per source version),
    scanned back with every column as text, then cleaned with the strict
    parser on all numeric columns."""
    from affordspark.schema import RAW_CSV_SCHEMA
    from affordspark.sources.fixtures import applications_view
    from affordspark.sources.io import ingest_snapshot, scan_csv
    path = ingest_snapshot(spark, "applications", [f"{sf_dir}/orders.parquet",
                                                   f"{sf_dir}/customer.parquet"],
                           lambda: applications_view(spark, sf_dir), fmt="csv")
    raw = scan_csv(spark, path, RAW_CSV_SCHEMA)
    raw = raw.withColumn("application_id", F.col("application_id").cast("bigint"))
    return round_doubles(clean.clean_applications(raw, parse_all_numeric=True))


# ---------------------------------------------------------------------------
# features group
# ---------------------------------------------------------------------------

_ENG_KEEP = [c for c in S.CLEAN_COLS if c not in COLS_TO_DROP]


@register("engineered_features", S.with_(S.CLEAN_CTES, S.engineered_cte("cleaned"), select=f"""
SELECT application_id, {S.rnd(S.ENG_COLS)} FROM eng"""))
def q_engineered_features(spark, sf_dir):
    df = features.engineered_features(cleaned_apps(spark, sf_dir))
    return round_doubles(df.select("application_id", *S.ENG_COLS))


@register("drop_redundant", S.with_(S.CLEAN_CTES, S.engineered_cte("cleaned"), select=f"""
SELECT {S.rnd(_ENG_KEEP + S.ENG_COLS)} FROM eng"""))
def q_drop_redundant(spark, sf_dir):
    return round_doubles(engineered_apps(spark, sf_dir))
