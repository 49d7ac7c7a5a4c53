"""Metrics, selection, validation: edge rows and invariants."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from affordspark.operators import metrics, selection, validate


def test_auc_ties_and_absent_class(spark):
    # class 1 scores: pos 0.8, 0.4 ; neg 0.4, 0.2 -> pairs: (0.8>0.4),(0.8>0.2),(0.4=0.4 half),(0.4>0.2) = 3.5/4
    df = spark.createDataFrame([(1, 0.8, 0.2), (1, 0.4, 0.6), (0, 0.4, 0.6), (0, 0.2, 0.8)],
                               "y int, p1 double, p0 double")
    out = {r["class"]: r["auc"] for r in metrics.roc_auc_ovr(df, "y", {0: "p0", 1: "p1", 2: "p1"}).collect()}
    assert abs(out["1"] - 0.875) < 1e-12
    assert abs(out["0"] - 0.875) < 1e-12
    assert out["2"] is None
    assert abs(out["weighted"] - 0.875) < 1e-12


def test_auc_matches_bruteforce(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = {r["class"]: r["auc"] for r in metrics.roc_auc_ovr(df, "y", {1: "s"}).collect()}["1"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12


def test_prefix_sum_bruteforce(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 2), i, rnd.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "p int, o int, v bigint").repartition(4)
    got = {(r["p"], r["o"]): r["v_below"] for r in metrics.prefix_sum(df, "p", "o", ["v"]).collect()}
    for p, o, _ in rows:
        assert got[(p, o)] == sum(v for p2, o2, v in rows if p2 == p and o2 < o)


def test_cls_metrics(spark):
    # class 2 never predicted -> precision 0 for it
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 0)], "a int, p int")
    m = metrics.cls_metrics(df, "a", "p").first()
    assert abs(m["accuracy"] - 0.4) < 1e-12
    assert abs(m["recall"] - m["accuracy"]) < 1e-12  # weighted recall == accuracy
    pc = {r["class"]: r for r in metrics.per_class(df, "a", "p").collect()}
    assert pc[2]["precision"] == 0.0 and pc[2]["f1"] == 0.0
    cm = metrics.confusion_matrix(df, "a", "p", [0, 1, 2]).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 5


def test_reg_metrics_constant_y(spark):
    same = spark.createDataFrame([(5.0, 5.0), (5.0, 5.0)], "y double, p double")
    off = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "y double, p double")
    assert metrics.reg_metrics(same, "y", "p").first()["r2_score"] == 1.0
    r = metrics.reg_metrics(off, "y", "p").first()
    assert r["r2_score"] == 0.0 and r["rmse"] == 1.0 and r["mae"] == 1.0
    assert abs(r["mape"] - 20.0) < 1e-6


def test_promotion_gate_strict(spark):
    m = spark.createDataFrame([("classification", "a", "accuracy", 0.90), ("classification", "b", "accuracy", 0.91),
                               ("regression", "c", "rmse", 2000.0), ("regression", "d", "rmse", 1999.0)],
                              "task string, model string, metric string, value double")
    got = {r["model"]: r["promoted"] for r in selection.promotion_gate(m).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True}


def test_leaderboard_ties(spark):
    m = spark.createDataFrame([("classification", "x", "f1_score", 0.5, 1), ("classification", "y", "f1_score", 0.5, 0),
                               ("classification", "z", "f1_score", 0.4, 2)],
                              "task string, model string, metric string, value double, seq int")
    top = [r["model"] for r in selection.leaderboard(m, n=2).orderBy("rank").collect()]
    assert top == ["y", "x"]
    best = selection.select_best(m).collect()
    assert [r["model"] for r in best] == ["y"]


def test_tuned_replaces_strict(spark):
    base = spark.createDataFrame([("regression", "a", "r2_score", 0.5), ("regression", "b", "r2_score", 0.5)],
                                 "task string, model string, metric string, value double")
    tuned = spark.createDataFrame([("regression", "a", "r2_score", 0.5), ("regression", "b", "r2_score", 0.6)],
                                  "task string, model string, metric string, value double")
    got = {r["model"]: (r["improved"], r["chosen_value"]) for r in selection.tuned_replaces(base, tuned).collect()}
    assert got == {"a": (False, 0.5), "b": (True, 0.6)}


def test_validate_input(spark):
    df = spark.createDataFrame([(30.0, 100.0, 10.0, 12.0), (None, 0.0, -1.0, 12.0), (120.0, 5.0, 5.0, None)],
                               "Age double, Monthly_Salary double, Requested_Amount double, Requested_Tenure double")
    r = validate.validate_input(df).collect()
    assert r[0]["is_valid"] and r[0]["errors"] == ""
    assert r[1]["errors"] == ("Missing required field: Age; Income must be greater than 0; "
                              "Loan amount must be greater than 0")
    assert r[2]["errors"] == "Missing required field: Loan_Tenure_Months; Age must be between 18 and 100"
    ok, bad = validate.split_valid_invalid(df.withColumn("Gender", F.lit("M")))
    assert ok.count() + bad.count() == 3
