"""Registered queries: sinks written and scanned back, deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from affordspark.operators import clean, encode, selection, split
from affordspark.plans import sqlparts as S
from affordspark.plans.catalog import ORACLE, parsed_apps, raw_apps, register
from affordspark.plans.common import round_doubles
from affordspark.plans.q_prepare import NUM9, SPLIT_SQL, engineered_split
from affordspark.schema import NA_TOKENS, RAW_CSV_SCHEMA
from affordspark.session import checkpoint_dir
from affordspark.sources import io

FIRST = 500  # rows of the limited scan: the feature
FILE_BYTES = 4 << 20  # of the tables that one sorted CSV file is made from: some 400,000 orders


def _folder(spark, name: str) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    io.delete_at_exit(spark, path)
    return path


@register("limit_scan", S.with_(S.RAW_CTE, select=f"""
SELECT application_id, CASE WHEN age IN ('', 'NULL') THEN NULL ELSE age END AS age, marital_status, emi_scenario, emi_eligibility
FROM raw ORDER BY application_id LIMIT {FIRST}"""))
def q_limit_scan(spark, sf_dir):
    """First rows of a headered CSV that is sorted by the key, over several files."""
    path = _folder(spark, "limit")
    size, _ = io.input_bytes(spark, [f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet"])
    raw_apps(spark, sf_dir).repartitionByRange(max(4, -(-size // FILE_BYTES)), "application_id").sortWithinPartitions("application_id") \
        .write.option("header", True).csv(path)
    out = io.scan_csv(spark, path, RAW_CSV_SCHEMA, nrows=FIRST)
    return out.select(F.col("application_id").cast("bigint").alias("application_id"), "age", "marital_status",
                      "emi_scenario", "emi_eligibility")


def _raw_csv(spark, sf_dir, name):
    """The raw applications as a headered CSV of several files, blanks kept."""
    path = _folder(spark, name)
    raw_apps(spark, sf_dir).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


_TEXT_RAW = "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in S.RAW_COLS) + " FROM raw"
_NA_SQL = ", ".join(f"'{x}'" for x in NA_TOKENS)


def _kind_sql(c: str) -> str:
    """Type of a column by counts of what its values are."""
    v = f"CASE WHEN {c} NOT IN ({_NA_SQL}) THEN {c} END"
    return f"""SELECT '{c}' AS col, count(v) AS n, CASE WHEN count(*) = 0 THEN 'string' WHEN count(v) = 0 THEN 'double'
    WHEN count(v) = count(*) AND count(*) FILTER (WHERE regexp_matches(v, '^[+-]?[0-9]+$') AND TRY_CAST(v AS BIGINT) IS NOT NULL) = count(*) THEN 'bigint'
    WHEN count({S.num('v')}) = count(v) THEN 'double' ELSE 'string' END AS type FROM (SELECT {v} AS v FROM t)"""


@register("scan_csv_types", S.with_(S.RAW_CTE, f"t AS ({_TEXT_RAW})", select=" UNION ALL ".join(_kind_sql(c) for c in S.RAW_COLS)))
def q_scan_csv_types(spark, sf_dir):
    """Inferred type and number of values of every column of the raw CSV."""
    df = io.scan_csv(spark, _raw_csv(spark, sf_dir, "types"), infer=True)
    n = df.agg(*[F.count(c).alias(c) for c in df.columns])
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return n.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("col", "n")).withColumn("type", F.element_at(types, F.col("col")))


@register("scan_csv_typed", S.with_(S.RAW_CTE, select="SELECT application_id, CASE WHEN age IN ('', 'NULL') THEN NULL ELSE age END AS age, "
          "CASE WHEN gender IN ('') THEN NULL ELSE gender END AS gender, monthly_salary, "
          + ", ".join(f"{S.R(c)} AS {c}" for c in ("years_of_employment", "credit_score", "emergency_fund", "requested_amount", "requested_tenure", "max_monthly_emi"))
          + " FROM raw"))
def q_scan_csv_typed(spark, sf_dir):
    """The raw CSV with inferred types: numbers come back as numbers."""
    df = io.scan_csv(spark, _raw_csv(spark, sf_dir, "typed"), infer=True)
    return round_doubles(df.select("application_id", "age", "gender", "monthly_salary", "years_of_employment", "credit_score", "emergency_fund",
                                   "requested_amount", "requested_tenure", "max_monthly_emi"))


@register("sink_snapshot", S.with_(S.RAW_CTE, S.PARSED_CTE, S.DROPPED_CTE, select=f"SELECT {S.rnd(S.CLEAN_COLS)} FROM dropped"))
def q_sink_snapshot(spark, sf_dir):
    path = io.sink_snapshot(parsed_apps(spark, sf_dir), _folder(spark, "snapshot"))
    return round_doubles(io.scan_stage(spark, path, "parser"))


@register("sink_splits", S.with_(S.RAW_CTE, select=f"""
SELECT * FROM (SELECT application_id, emi_scenario, {SPLIT_SQL} AS split FROM raw) WHERE split IN ('val', 'test')"""))
def q_sink_splits(spark, sf_dir):
    df = split.split_70_15_15(raw_apps(spark, sf_dir).select("application_id", "emi_scenario"))
    path = io.sink_splits(df, _folder(spark, "splits"))
    return io.scan_splits(spark, path, "val", "test").select("application_id", "emi_scenario", "split")


@register("sink_preprocessor", ORACLE.get("robust_fit"))
def q_sink_preprocessor(spark, sf_dir):
    """Fitted scaler parameters, written and reloaded."""
    train = io.materialize(engineered_split(spark, sf_dir).where(F.col("split") == "train").select(*NUM9, "Emi_Scenario"), "fit")
    path = io.sink_preprocessor({"scaler_params": encode.robust_fit(train, NUM9), "ohe_categories": encode.onehot_fit(train, ["Emi_Scenario"])},
                                _folder(spark, "preprocessor"))
    return round_doubles(io.scan_preprocessor(spark, path, ("scaler_params", "ohe_categories"))["scaler_params"])


@register("metrics_log", S.with_(S.RAW_CTE, select=f"""
SELECT 'run' AS run_id, CAST(NULL AS VARCHAR) AS parent_run_id, 'profile' AS stage, 'means' AS task, 'raw' AS model, 'all' AS split,
  concat('avg_', emi_scenario) AS metric, {S.R('avg(requested_amount)')} AS value FROM raw WHERE emi_scenario IS NOT NULL GROUP BY emi_scenario
UNION ALL SELECT 'run', NULL, 'profile', 'means', 'raw', 'all', 'n', CAST(count(*) AS DOUBLE) FROM raw"""))
def q_metrics_log(spark, sf_dir):
    """Metrics of two appends to one log, read back."""
    raw, path = raw_apps(spark, sf_dir), _folder(spark, "log")
    means = raw.where("emi_scenario IS NOT NULL").groupBy("emi_scenario").agg(F.avg("requested_amount").alias("value")) \
        .select(F.concat(F.lit("avg_"), "emi_scenario").alias("metric"), "value")
    selection.metrics_log(spark, path, means, "run", None, "profile", "means", "raw", "all")
    selection.metrics_log(spark, path, {"n": raw.count()}, "run", None, "profile", "means", "raw", "all")
    return round_doubles(spark.read.parquet(path))


DEDUP = ["gender", "marital_status", "education", "company_type", "house_type", "emi_scenario"]


@register("dedup_exact", S.with_(S.RAW_CTE, select=f"""
SELECT min(application_id) AS application_id, {', '.join(DEDUP)} FROM raw GROUP BY {', '.join(DEDUP)}"""))
def q_dedup_exact(spark, sf_dir):
    return clean.dedup_exact(raw_apps(spark, sf_dir).select("application_id", *DEDUP))
