"""Registered queries: profiling panels."""

from __future__ import annotations

from affordspark.operators import profile
from affordspark.plans import sqlparts as S
from affordspark.plans.catalog import parsed_apps, raw_apps, register
from affordspark.plans.common import round_doubles
from affordspark.schema import NUMERIC_COLS
from affordspark.sources.io import materialize, read_table

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
APP_CATS = ["gender", "marital_status", "education", "employment_type", "company_type",
            "house_type", "existing_loans", "emi_scenario", "emi_eligibility"]
COERCE = ["monthly_salary", "years_of_employment", "monthly_rent", "family_size", "dependents",
          "school_fees", "college_fees", "travel_expenses", "groceries_utilities",
          "other_monthly_expenses", "current_emi_amount", "bank_balance", "emergency_fund",
          "requested_amount", "requested_tenure", "max_monthly_emi"]


def _describe_sql(cols, source):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS count, {S.R(f'avg({c})')} AS mean, "
        f"{S.R(f'stddev_samp({c})')} AS std, {S.R(f'min({c})')} AS min, "
        f"{S.R(f'quantile_cont({c}, 0.25)')} AS p25, {S.R(f'quantile_cont({c}, 0.5)')} AS p50, "
        f"{S.R(f'quantile_cont({c}, 0.75)')} AS p75, {S.R(f'max({c})')} AS max FROM {source}"
        for c in cols)


@register("describe_numeric", _describe_sql(LI_NUM, "lineitem"))
def q_describe_numeric(spark, sf_dir):
    return round_doubles(profile.describe_numeric(read_table(spark, sf_dir, "lineitem"), LI_NUM))


@register("value_counts", S.with_(S.RAW_CTE, select=" UNION ALL ".join(
    f"SELECT '{c}' AS column, {c} AS value, count(*) AS count FROM raw WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in APP_CATS)))
def q_value_counts(spark, sf_dir):
    return profile.value_counts(raw_apps(spark, sf_dir), APP_CATS)


@register("histogram", f"""
WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 50 ELSE 1.0 END AS width FROM mm),
c AS (SELECT least(CAST(floor((l_extendedprice - w.lo) / w.width) AS INTEGER), 49) AS bin, count(*) AS n
      FROM lineitem CROSS JOIN w WHERE l_extendedprice IS NOT NULL GROUP BY 1)
SELECT CAST(b.range AS INTEGER) AS bin, {S.R('w.lo + b.range * w.width')} AS bin_lo,
  {S.R('w.lo + (b.range + 1) * w.width')} AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM range(50) b CROSS JOIN w LEFT JOIN c ON c.bin = b.range""")
def q_histogram(spark, sf_dir):
    return round_doubles(profile.histogram(read_table(spark, sf_dir, "lineitem"), "l_extendedprice", 50))


def _corr_sql(cols, source) -> str:
    """One pass for all pairs, then a row for each."""
    cell = {}
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i:], start=i):
            cell[i, j] = cell[j, i] = f"corr({a}, {b})" if i != j else f"CASE WHEN min({a}) < max({a}) THEN 1.0 END"
    picks = ", ".join(f"{cell[i, j]} AS c{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols)))
    rows = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {S.R(f'c{min(i, j)}_{max(i, j)}')} AS corr FROM pairs"
                              for i, a in enumerate(cols) for j, b in enumerate(cols))
    return f"pairs AS (SELECT {picks} FROM {source})", rows


@register("corr_matrix", "WITH {} {}".format(*_corr_sql(LI_NUM, "lineitem")))
def q_corr_matrix(spark, sf_dir):
    return round_doubles(profile.corr_matrix(read_table(spark, sf_dir, "lineitem"), LI_NUM))


@register("describe_applications", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, select=_describe_sql(NUMERIC_COLS, "dropped")))
def q_describe_applications(spark, sf_dir):
    return round_doubles(profile.describe_numeric(materialize(parsed_apps(spark, sf_dir).select(*NUMERIC_COLS), "panel"), NUMERIC_COLS))


@register("corr_applications", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, _corr_sql(NUMERIC_COLS, "dropped")[0],
                                       select=_corr_sql(NUMERIC_COLS, "dropped")[1]))
def q_corr_applications(spark, sf_dir):
    return round_doubles(profile.corr_matrix(materialize(parsed_apps(spark, sf_dir).select(*NUMERIC_COLS), "panel"), NUMERIC_COLS))


@register("dataset_overview", """
SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, CAST(8 AS BIGINT) AS n_numeric,
  CAST(2 AS BIGINT) AS n_text FROM lineitem""")
def q_dataset_overview(spark, sf_dir):
    return profile.dataset_overview(read_table(spark, sf_dir, "lineitem"))


@register("sample_n", f"""
SELECT o_orderkey, o_custkey, {S.R('o_totalprice')} AS o_totalprice FROM orders
ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000""")
def q_sample_n(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return round_doubles(profile.sample_n(o, "o_orderkey", 1000, seed=42))


@register("head_n", f"""
SELECT o_orderkey, o_custkey, {S.R('o_totalprice')} AS o_totalprice FROM orders
ORDER BY o_orderkey LIMIT 10""")
def q_head_n(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return round_doubles(profile.head_n(o, "o_orderkey", 10))


@register("coerce_columns", S.with_(S.RAW_CTE, select="SELECT application_id, " + ", ".join(
    f"{S.R(S.num(f'CAST({c} AS VARCHAR)'))} AS {c}" for c in COERCE) + " FROM raw"))
def q_coerce_columns(spark, sf_dir):
    df = profile.coerce_columns(raw_apps(spark, sf_dir), COERCE)
    return round_doubles(df.select("application_id", *COERCE))
