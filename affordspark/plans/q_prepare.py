"""Registered queries: split, encoders, model-ready table."""

from __future__ import annotations

from pyspark.sql import functions as F

from affordspark.operators import encode, split
from affordspark.plans import prepare
from affordspark.plans import sqlparts as S
from affordspark.plans.catalog import raw_apps, register
from affordspark.plans.common import round_doubles
from affordspark.schema import CATEGORICAL_COLS, LABELS, TARGET_CLF
from affordspark.sources.io import read_table

NUM9 = ["Age", "Monthly_Salary", "Years_Of_Employment", "Current_Emi_Amount", "Credit_Score",
        "Bank_Balance", "Emergency_Fund", "Requested_Amount", "Requested_Tenure"]

# FIXED VALUES: category domains of the eight categorical columns after cleaning
CATS = {
    "Gender": ["F", "M"],
    "Marital_Status": ["Married", "Single"],
    "Education": ["Graduate", "High School", "Post Graduate", "Professional"],
    "Employment_Type": ["Government", "Private", "Self-employed"],
    "Company_Type": ["Large Indian", "MNC", "Mid-size", "Small", "Startup"],
    "House_Type": ["Family", "Own", "Rented"],
    "Existing_Loans": ["No", "Yes"],
    "Emi_Scenario": ["E-commerce Shopping EMI", "Education EMI", "Home Appliances EMI",
                     "Personal Loan EMI", "Vehicle EMI"],
}
OHE_COLS = [f"{c}_{v}" for c in CATEGORICAL_COLS for v in CATS[c]]


def _bucket_sql(key: str = "application_id") -> str:
    return f"(CAST(('0x' || substr(md5('42|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % 10000)"


SPLIT_SQL = (f"CASE WHEN {_bucket_sql()} < 7000 THEN 'train' "
             f"WHEN {_bucket_sql()} < 8500 THEN 'val' ELSE 'test' END")

ENG_SPLIT_CTES = S.with_(S.CLEAN_CTES, S.engineered_cte("cleaned"),
                         f"sp AS (SELECT *, {SPLIT_SQL} AS split FROM eng)",
                         select="").removesuffix("\n")[len("WITH "):]

PARAMS_CTE = "params AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, "
    f"CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 "
    f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in NUM9) \
    + " FROM sp WHERE split = 'train')"


def engineered_split(spark, sf_dir):
    from affordspark.operators import features
    cleaned = prepare.clean_stage(raw_apps(spark, sf_dir))
    eng = features.drop_redundant(features.engineered_features(cleaned))
    return split.split_70_15_15(eng)


@register("split_70_15_15", S.with_(S.RAW_CTE, select=f"""
SELECT application_id, {SPLIT_SQL} AS split FROM raw"""))
def q_split(spark, sf_dir):
    return split.split_70_15_15(raw_apps(spark, sf_dir).select("application_id"))


@register("split_exact", S.with_(S.RAW_CTE, select="""
SELECT application_id, CASE WHEN rn < n - CAST(ceil(n * 0.3) AS BIGINT) THEN 'train'
  WHEN rn < n - CAST(ceil(CAST(ceil(n * 0.3) AS BIGINT) * 0.5) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM (SELECT application_id, count(*) OVER () AS n,
        row_number() OVER (ORDER BY md5('42|' || CAST(application_id AS VARCHAR)), application_id) - 1 AS rn
      FROM raw) t"""))
def q_split_exact(spark, sf_dir):
    return split.split_70_15_15(raw_apps(spark, sf_dir).select("application_id"), exact=True)


@register("union_train_val", S.with_(S.RAW_CTE, select=f"""
SELECT application_id, split FROM (SELECT application_id, {SPLIT_SQL} AS split FROM raw) t
WHERE split IN ('train', 'val')"""))
def q_union_train_val(spark, sf_dir):
    return split.union_train_val(split.split_70_15_15(raw_apps(spark, sf_dir).select("application_id")))


@register("robust_fit", "WITH " + ENG_SPLIT_CTES + ",\n" + PARAMS_CTE + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {S.R(f'm_{c}')} AS center, {S.R(f's_{c}')} AS scale FROM params"
    for c in NUM9))
def q_robust_fit(spark, sf_dir):
    df = engineered_split(spark, sf_dir)
    return round_doubles(encode.robust_fit(df.where(F.col("split") == "train"), NUM9))


@register("robust_scale", "WITH " + ENG_SPLIT_CTES + ",\n" + PARAMS_CTE + "\nSELECT application_id, "
          + ", ".join(f"{S.R(f'(sp.{c} - params.m_{c}) / params.s_{c}')} AS {c}" for c in NUM9)
          + " FROM sp CROSS JOIN params")
def q_robust_scale(spark, sf_dir):
    df = engineered_split(spark, sf_dir)
    params = encode.robust_fit(df.where(F.col("split") == "train"), NUM9)
    return round_doubles(encode.robust_scale(df, params, NUM9).select("application_id", *NUM9))


@register("onehot_fit", "WITH " + ENG_SPLIT_CTES + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS idx, v AS category "
    f"FROM (SELECT DISTINCT {c} AS v FROM sp WHERE split = 'train' AND {c} IS NOT NULL) t{i}"
    for i, c in enumerate(CATEGORICAL_COLS)))
def q_onehot_fit(spark, sf_dir):
    df = engineered_split(spark, sf_dir)
    return encode.onehot_fit(df.where(F.col("split") == "train"), CATEGORICAL_COLS)


@register("onehot_encode", "WITH " + ENG_SPLIT_CTES + "\nSELECT application_id, " + ", ".join(
    f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS \"{c}_{v}\""
    for c in CATEGORICAL_COLS for v in CATS[c]) + " FROM sp")
def q_onehot_encode(spark, sf_dir):
    df = engineered_split(spark, sf_dir)
    cats = encode.onehot_fit(df.where(F.col("split") == "train"), CATEGORICAL_COLS)
    return encode.onehot_encode(df, cats, CATEGORICAL_COLS).select("application_id", *OHE_COLS)


LABEL_SQL = ("CAST(CASE Emi_Eligibility WHEN 'Eligible' THEN 0 WHEN 'High_Risk' THEN 1 "
              "WHEN 'Not_Eligible' THEN 2 END AS INTEGER)")


@register("label_encode", "WITH " + ENG_SPLIT_CTES + f"""
SELECT application_id, Emi_Eligibility, {LABEL_SQL} AS label FROM sp""")
def q_label_encode(spark, sf_dir):
    df = engineered_split(spark, sf_dir)
    classes = encode.label_fit(df.where(F.col("split") == "train"), TARGET_CLF)
    return encode.label_encode(df, TARGET_CLF, classes).select("application_id", TARGET_CLF, "label")


@register("label_fit", "WITH " + ENG_SPLIT_CTES + """
SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx, label
FROM (SELECT DISTINCT Emi_Eligibility AS label FROM sp WHERE split = 'train') t""")
def q_label_fit(spark, sf_dir):
    df = engineered_split(spark, sf_dir)
    return encode.label_fit(df.where(F.col("split") == "train"), TARGET_CLF)


_ORDERS = f"o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust, o_orderpriority, {SPLIT_SQL.replace('application_id', 'o_orderkey')} AS split FROM orders)"


def _places(col, name):
    return f"{name} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT {col} AS v FROM o WHERE split = 'train'))"


def _orders(spark, sf_dir):
    df = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"), "o_orderpriority")
    return split.split_70_15_15(df, "o_orderkey")


@register("index_encode", f"WITH {_ORDERS}, {_places('cust', 'd')} SELECT o_orderkey, cust, coalesce(i, -1) AS idx FROM o LEFT JOIN d ON v = cust")
def q_index_encode(spark, sf_dir):
    """Sorted-label index of a column with thousands of values, fitted on the
    training rows; values that these lack have none (-1 here)."""
    df = _orders(spark, sf_dir)
    classes = encode.label_fit(df.where(F.col("split") == "train"), "cust")
    return encode.label_encode(df, "cust", classes, "idx").select("o_orderkey", "cust", F.coalesce("idx", F.lit(-1)).alias("idx"))


@register("onehot_indices", f"""WITH {_ORDERS}, {_places('cust', 'd')}, {_places('o_orderpriority', 'p')}
SELECT o_orderkey, concat_ws(',', d.i, (SELECT count(*) FROM d) + p.i) AS places FROM o LEFT JOIN d ON d.v = cust LEFT JOIN p ON p.v = o_orderpriority""")
def q_onehot_indices(spark, sf_dir):
    """Sparse one-hot places over a column with thousands of values and a small one."""
    df = _orders(spark, sf_dir)
    cols = ["cust", "o_orderpriority"]
    out, _ = encode.onehot_indices(df, encode.onehot_fit(df.where(F.col("split") == "train"), cols), cols)
    return out.select("o_orderkey", F.array_join(F.col("indices").cast("array<string>"), ",").alias("places"))


@register("label_decode", S.with_(S.RAW_CTE, select="""
SELECT application_id, CAST(application_id % 4 AS INTEGER) AS class_idx,
  CASE application_id % 4 WHEN 0 THEN 'Eligible' WHEN 1 THEN 'High_Risk' WHEN 2 THEN 'Not_Eligible'
  ELSE 'Unknown' END AS eligibility_label FROM raw"""))
def q_label_decode(spark, sf_dir):
    df = raw_apps(spark, sf_dir).select("application_id",
                                       (F.col("application_id") % 4).cast("int").alias("class_idx"))
    return encode.label_decode(df, "class_idx", LABELS)


@register("unseen_labels", "WITH " + ENG_SPLIT_CTES + """
SELECT application_id, Emi_Eligibility FROM sp
WHERE split <> 'train' AND Emi_Eligibility NOT IN (SELECT Emi_Eligibility FROM sp WHERE split = 'train')""")
def q_unseen_labels(spark, sf_dir):
    df = engineered_split(spark, sf_dir)
    classes = encode.label_fit(df.where(F.col("split") == "train"), TARGET_CLF)
    return encode.unseen_labels(df.where(F.col("split") != "train"), TARGET_CLF, classes) \
        .select("application_id", TARGET_CLF)


_REMAINDER = S.ENG_COLS


@register("fe_full", "WITH " + ENG_SPLIT_CTES + ",\n" + PARAMS_CTE + "\nSELECT application_id, split, "
          + ", ".join(f"{S.R(f'(sp.{c} - params.m_{c}) / params.s_{c}')} AS {c}" for c in NUM9) + ", "
          + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS \"{c}_{v}\""
                      for c in CATEGORICAL_COLS for v in CATS[c]) + ", "
          + ", ".join(f"{S.R(c)} AS {c}" for c in _REMAINDER)
          + f", {S.R('Max_Monthly_Emi')} AS Max_Monthly_Emi, {LABEL_SQL} AS label"
          + " FROM sp CROSS JOIN params")
def q_fe_full(spark, sf_dir):
    cleaned = prepare.clean_stage(raw_apps(spark, sf_dir))
    return round_doubles(prepare.prepare_features(cleaned).table)


@register("cv_folds", S.with_(S.RAW_CTE, select="""
SELECT application_id,
  CAST((CAST(('0x' || substr(md5('43|' || CAST(application_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10000) % 3 AS INTEGER) AS fold
FROM raw"""))
def q_cv_folds(spark, sf_dir):
    return split.cv_folds(raw_apps(spark, sf_dir).select("application_id"), k=3)


@register("cv_folds_stratified", S.with_(S.RAW_CTE, select="""
SELECT application_id, emi_eligibility,
  CAST((row_number() OVER (PARTITION BY emi_eligibility
        ORDER BY md5('42|' || CAST(application_id AS VARCHAR)), application_id) - 1) % 3 AS INTEGER) AS fold
FROM raw"""))
def q_cv_folds_stratified(spark, sf_dir):
    df = raw_apps(spark, sf_dir).select("application_id", "emi_eligibility")
    return split.cv_folds(df, k=3, label="emi_eligibility", exact=True)
