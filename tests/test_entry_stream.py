"""Driver contract, oracle agreement at sf0.001, streaming scoring."""

from __future__ import annotations

import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# a spread of operators from every group (the full list runs in scripts/check_oracle.py)
ORACLE_SAMPLE = ["scenario_means", "extract_number", "parse_and_cast", "scenario_cap", "cap_audit",
                 "clean_full", "engineered_features", "split_70_15_15", "robust_fit", "onehot_fit",
                 "describe_numeric", "corr_matrix", "histogram", "cls_metrics", "roc_auc_ovr",
                 "reg_metrics", "leaderboard", "validate_input", "report_text", "limit_scan", "sink_snapshot", "sink_splits", "sink_preprocessor",
                 "metrics_log", "dedup_exact", "corr_applications", "describe_applications"]


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert set(df.columns) >= {"Emi_Scenario", "n", "avg_Total_Expenses"}


def test_contract_names():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
    from affordspark.plans.registry import all_queries
    assert set(all_queries()) <= set(q)
    for name in all_queries():
        assert "pipeline" not in name and not name.startswith("op")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted(repr(tuple(_norm(x) for x in r)) for r in pdf[cols].itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_agreement(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert _digest(sp) == _digest(dd)


@pytest.fixture(scope="module")
def fitted(spark):
    from affordspark.operators import models
    from affordspark.plans import prepare
    from affordspark.plans import train as T
    from affordspark.plans.catalog import raw_apps
    raw = raw_apps(spark, SF_SMALL)
    p = prepare.prepare_features(prepare.clean_stage(raw))
    cls_in = T.model_input(p, T.CLS, ["train", "val"], None)
    reg_in = T.model_input(p, T.REG, ["train", "val"], None)
    fit = lambda name, task, df, **k: models.model_factory(name, task, k).fit(df)
    return {"raw": raw, "prepared": p, "trees": (fit("Decision_Tree", T.CLS, cls_in, max_depth=4), fit("Decision_Tree", T.REG, reg_in, max_depth=4)),
            "linear": (fit("Logistic_Regression", T.CLS, cls_in, max_iter=20), fit("Linear_Regression", T.REG, reg_in))}


def test_linear_models_as_one_expression(spark, fitted):
    """The compiled expressions give what the Spark ML models give, and the plan
    has neither a join nor a Python worker."""
    from affordspark.operators.linear import linear_parts
    from affordspark.streaming.score import score_frame
    p, models_ = fitted["prepared"], fitted["linear"]
    want = {r["application_id"]: r for r in score_frame(fitted["raw"], p, *models_).collect()}
    compiled = score_frame(fitted["raw"], p, *[linear_parts(m, p.feature_cols) for m in models_])
    got = {r["application_id"]: r for r in compiled.collect()}
    assert set(got) == set(want) and len(got) > 1000
    for k, r in got.items():
        assert (r["eligibility_class"], r["eligibility_label"]) == (want[k]["eligibility_class"], want[k]["eligibility_label"])
        assert all(math.isclose(r[c], want[k][c], rel_tol=1e-6, abs_tol=1e-6) for c in compiled.columns if isinstance(r[c], float))
    plan = compiled._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan


def test_discriminant_and_slopes(spark):
    import random

    import numpy as np
    from affordspark.operators import linear
    r = random.Random(2)
    rows = [(float(c + r.gauss(0, 1)), float(r.gauss(0, 2)), 5.0, c) for c in (0, 1) for _ in range(50)]
    df = spark.createDataFrame([(*x, 3 * x[0] + 1) for x in rows], "a double, b double, k double, c int, y double")
    m = linear.diagonal_discriminant(df, ["a", "b", "k"], "c", 3)
    x, c = np.array([x[:2] for x in rows]), np.array([x[3] for x in rows])
    var = np.mean([x[c == i].var(axis=0) for i in (0, 1)], axis=0)
    for i in (0, 1):
        assert np.allclose(m.coefficients[i], [*(x[c == i].mean(axis=0) / var), 0.0])
    assert m.intercepts[2] == -1e30 and m.coefficients[2] == [0.0] * 3  # a class without rows never wins
    s = linear.averaged_slopes(df, ["a", "k"], "y")  # the constant has no say
    assert np.allclose(s.coefficients, [[3.0, 0.0]]) and np.allclose(s.intercepts, [1.0])


@pytest.mark.parametrize("kind", ["trees", "linear"])
def test_score_stream_restarts(spark, tmpdir_path, fitted, kind, monkeypatch):
    """Three files, three micro-batches; the second batch fails after its scored
    table was written. After the restart and a fourth file every row is there
    once, scored or rejected."""
    from affordspark.operators.linear import linear_parts
    from affordspark.streaming import score
    raw, p, models_ = fitted["raw"], fitted["prepared"], fitted[kind]
    if kind == "linear":
        models_ = [linear_parts(m, p.feature_cols) for m in models_]
    source, out, checkpoint = (os.path.join(tmpdir_path, x) for x in ("incoming", "out", "checkpoint"))
    part = lambda i: raw.where(F.col("application_id") % 4 == i).coalesce(1).write.mode("append").parquet(source)
    for i in range(3):
        part(i)
    args = (spark, source, raw.schema, p, *models_, out, checkpoint)
    with pytest.raises(ValueError):
        score.score_stream(*args[:-1], "")
    rejected = score.reject_frame
    calls = []

    def failing(*a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return rejected(*a, **k)
    monkeypatch.setattr(score, "reject_frame", failing)
    q = score.score_stream(*args, query_name=f"first_{kind}", files_per_batch=1)
    with pytest.raises(Exception):
        q.awaitTermination(300)
    monkeypatch.setattr(score, "reject_frame", rejected)
    part(3)
    q = score.score_stream(*args, query_name=f"second_{kind}", files_per_batch=1)
    q.awaitTermination(300)
    scored, bad = (spark.read.parquet(os.path.join(out, x)) for x in ("scored", "rejected"))
    assert scored.select("batch").distinct().count() == 4
    ids = [r["application_id"] for r in scored.select("application_id").union(bad.select("application_id")).collect()]
    assert len(ids) == len(set(ids)) == raw.count() and bad.count() > 0
    want = score.score_frame(raw, p, *models_)
    assert scored.drop("batch").exceptAll(want).count() == 0 and scored.count() == want.count()
    some = bad.first()
    assert some["errors"] and f'"application_id":{some["application_id"]}' in some["raw"]


def test_checks_parse_once(spark):
    """The validity filter must not stand below the parse with a copy of the
    regular expressions for each mention of a parsed column."""
    from affordspark.sources.fixtures import applications_view
    from affordspark.streaming.score import checked
    raw = applications_view(spark, "/root/testdata/sf0.001")
    valid = checked(raw, ["Age", "Bank_Balance", "Monthly_Salary"]).where("is_valid").drop("raw")
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    checks = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter") and "Missing" in line]
    assert checks and not any("regexp" in line for line in checks)


def test_linear_fits_in_small_aggregates(spark, monkeypatch):
    """42 features in one aggregate make code too long to be compiled."""
    from affordspark.operators import linear
    names = [f"x{i}" for i in range(20)]
    df = spark.range(300).select((F.col("id") % 3).cast("int").alias("c"), F.col("id").cast("double").alias("y"),
                                 *[((F.col("id") * (i + 3)) % 17).cast("double").alias(n) for i, n in enumerate(names)])
    widths, group = [], type(df.groupBy())
    agg = group.agg
    monkeypatch.setattr(group, "agg", lambda self, *e: widths.append(len(e)) or agg(self, *e))
    s = linear.averaged_slopes(df, names, "y")
    d = linear.diagonal_discriminant(df, names, "c", 3)
    assert max(widths) <= 20
    want = df.select(F.regr_slope("y", "x7").alias("b"), F.avg("x7").alias("m")).first()
    assert abs(s.coefficients[0][7] * 19 - want["b"]) < 1e-12  # x14 is constant
    assert len(d.coefficients) == 3 and len(d.coefficients[2]) == 20 and all(any(w) for w in d.coefficients)


def test_limited_scan_makes_files_by_size(spark, monkeypatch):
    from affordspark.plans import q_stages
    monkeypatch.setattr(q_stages, "FILE_BYTES", 2000)
    seen, scan = [], q_stages.io.scan_csv
    monkeypatch.setattr(q_stages.io, "scan_csv", lambda s, path, *a, **k: seen.append(path) or scan(s, path, *a, **k))
    got = [r["application_id"] for r in q_stages.q_limit_scan(spark, "/root/testdata/sf0.001").collect()]
    assert len(q_stages.io.data_files(spark, seen[0])) > 4  # four tasks sorted everything, whatever the size
    orders = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey").orderBy("o_orderkey").limit(500).collect()]
    assert sorted(got) == orders
