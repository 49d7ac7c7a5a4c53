"""Edge rows for parsing and cleaning (FIXTURES F5) and cleaning invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from affordspark.functions.scalar import extract_number, gender_code, na_to_null, to_numeric_safe
from affordspark.operators import clean
from affordspark.sources.io import materialize


def _col(spark, values, f, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_extract_number(spark):
    vals = ["₹ 12,345", "45 years", "58.0.0", "-5", "1,200.50", ",", ".", "", "abc", "1e5", "12L"]
    got = _col(spark, vals, lambda c: to_numeric_safe(extract_number(c)))
    assert got == [12345.0, 45.0, None, 5.0, 1200.5, None, None, None, None, 1.0, 12.0]


def test_to_numeric_safe(spark):
    vals = ["-5", "1e5", " 12 ", "+7", "1.0d", "1.0f", "1e400", "0x10", "1_000", "1,200.50", "NaN"]
    got = _col(spark, vals, to_numeric_safe)
    assert got == [-5.0, 100000.0, 12.0, 7.0] + [None] * 7


def test_na_tokens(spark):
    got = _col(spark, ["NA", "null", "N/A", "None", "", " "], na_to_null)
    assert got == [None] * 5 + [" "]


def test_gender(spark):
    got = _col(spark, ["  male ", "Female", "f", "", " ", "m/f"], gender_code)
    assert got == ["M", "F", "F", None, None, "M"]


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "application_id int, years_of_employment double, `monthly salary` double")
    assert clean.normalize_columns(df).columns == ["application_id", "Years_Of_Employment", "Monthly_Salary"]
    bad = spark.createDataFrame([(1, 2)], "`a b` int, a_b int")
    with pytest.raises(ValueError):
        clean.normalize_columns(bad)


def test_scenario_cap_edges(spark):
    rows = []
    i = 0
    for scen, (amin, amax, tmin, tmax) in clean.EMI_RULES.items():
        for a, t in ((amin - 1, tmin - 1), (amin, tmin), (amax, tmax), (amax + 1, tmax + 1)):
            rows.append((i, scen, float(a), float(t)))
            i += 1
    rows.append((i, "Vehicle EMI", None, None))
    rows.append((i + 1, "Unknown EMI", 1.0, 999.0))
    df = spark.createDataFrame(rows, "id int, Emi_Scenario string, Requested_Amount double, Requested_Tenure double")
    out = {r["id"]: (r["Requested_Amount"], r["Requested_Tenure"]) for r in clean.scenario_cap(df).collect()}
    i = 0
    for scen, (amin, amax, tmin, tmax) in clean.EMI_RULES.items():
        assert out[i] == (amin, tmin) and out[i + 1] == (amin, tmin)
        assert out[i + 2] == (amax, tmax) and out[i + 3] == (amax, tmax)
        i += 4
    assert out[i] == (None, None)
    assert out[i + 1] == (1.0, 999.0)


def test_domain_clip(spark):
    df = spark.createDataFrame(
        [(299.0, 0.0, -0.5, 499.0), (300.0, 121.0, 1.0, 50001.0), (851.0, 5.0, 2.0, 600.0)],
        "Credit_Score double, Requested_Tenure double, Years_Of_Employment double, Max_Monthly_Emi double")
    got = [tuple(r) for r in clean.domain_clip(df).collect()]
    assert got == [(300.0, 1.0, 0.0, 500.0), (300.0, 120.0, 1.0, 50000.0), (850.0, 5.0, 2.0, 600.0)]


def test_winsorize_p99(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "Monthly_Rent double")
    out = clean.winsorize_p99(df, cols=["Monthly_Rent"])
    assert abs(out.agg(F.max("Monthly_Rent")).first()[0] - 99.01) < 1e-9
    neg = spark.createDataFrame([(-5.0,), (3.0,)], "Emergency_Fund double")
    assert clean.winsorize_p99(neg, cols=["Emergency_Fund"]).agg(F.min("Emergency_Fund")).first()[0] == 0.0
    approx = clean.quantiles(df, ["Monthly_Rent"], 0.99, method="approx")["Monthly_Rent"]
    assert 98 <= approx <= 100


def test_clean_invariants(spark):
    from affordspark.plans.catalog import raw_apps
    from affordspark.schema import DOMAIN_CLIPS, EMI_RULES
    from tests.conftest import SF_SMALL
    c = clean.clean_applications(raw_apps(spark, SF_SMALL)).cache()
    assert c.count() > 0
    assert c.dropna().count() == c.count()  # no NULL left
    for col, (lo, hi) in DOMAIN_CLIPS.items():
        r = c.agg(F.min(col), F.max(col)).first()
        assert lo is None or r[0] >= lo
        assert hi is None or r[1] <= hi
    for scen, (amin, amax, tmin, tmax) in EMI_RULES.items():
        r = c.where(F.col("Emi_Scenario") == scen).agg(F.min("Requested_Tenure"), F.max("Requested_Tenure")).first()
        if r[0] is not None:
            assert r[0] >= tmin and r[1] <= tmax
    # a second pass changes nothing except possibly tightening the p99 caps
    again = clean.clean_applications(c.select(*c.columns))
    assert again.count() == c.count()
    c.unpersist()


def test_select_quantiles_duplicates_and_rounds(spark):
    """Exact against Spark's percentile with heavy duplicates and forced
    multi-round narrowing (few bins)."""
    rows = [(float(i % 3), float((i * 7919) % 1000) / 7.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double")
    targets = [(c, q) for c in ("a", "b") for q in (0.0, 0.25, 0.5, 0.99, 1.0)]
    got = clean.select_quantiles_multi(df, targets, bins=8)
    for c, q in targets:
        exp = df.agg(F.percentile(c, F.lit(q))).first()[0]
        assert abs(got[(c, q)] - exp) <= 1e-9 * max(1.0, abs(exp)), (c, q, got[(c, q)], exp)


def test_select_quantiles_half_zeros_in_few_rounds(spark, monkeypatch):
    """A rank on a heavy value ends the search; nothing falls back to a map of
    all values."""
    df = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise((F.col("id") * 7919 % 1_000_003) / 13.0).alias("x"))
    df = materialize(df.withColumn("one", F.lit(4.5)).withColumn("none", F.lit(None).cast("double")), "halfzero")
    targets = [("x", q) for q in (0.1, 0.25, 0.5, 0.75, 0.99)] + [("one", 0.5), ("none", 0.5)]
    exp = {q: df.agg(F.percentile("x", F.lit(q))).first()[0] for _, q in targets}
    rounds = []
    explode = F.explode
    monkeypatch.setattr(clean.F, "explode", lambda c: rounds.append(1) or explode(c))
    monkeypatch.setattr(clean.F, "percentile", None)
    got = clean.select_quantiles_multi(df, targets)
    assert len(rounds) <= 6
    assert all(abs(got[("x", q)] - exp[q]) < 1e-9 for c, q in targets if c == "x")
    assert got[("one", 0.5)] == 4.5 and got[("none", 0.5)] is None


def test_select_quantiles_odd_values(spark):
    inf = float("inf")
    rows = [(v,) for v in (-inf, -inf, -1e308, -1.0, 0.0, 5e-324, 1e-323, 1.0, 1e308, inf, inf, float("nan"))]
    df = spark.createDataFrame(rows, "x double")
    got = clean.select_quantiles_multi(df, [("x", i / 11) for i in range(11)], bins=4)
    assert [got[("x", i / 11)] for i in (0, 1, 9, 10)] == [-inf, -inf, inf, inf]
    assert got[("x", 2 / 11)] == -1e308 and abs(got[("x", 3 / 11)] + 1.0) < 1e-9 and got[("x", 0.0)] == -inf


def test_cap_without_its_columns_passes_through(spark):
    """require_columns: a table without the three columns is left as it is, with a warning."""
    df = spark.createDataFrame([(1, 5.0)], "application_id long, Requested_Amount double")
    with pytest.warns(UserWarning):
        assert clean.scenario_cap(df).collect() == df.collect()


def test_separate_targets(spark):
    from affordspark.operators import features
    df = spark.createDataFrame([(1, 2.0, 3.0, "Eligible"), (2, 4.0, 5.0, "High_Risk")], "application_id long, Age double, Max_Monthly_Emi double, Emi_Eligibility string")
    x, y_reg, y_clf = features.separate_targets(df)
    assert (x.columns, y_reg.columns, y_clf.columns) == (["application_id", "Age"], ["application_id", "Max_Monthly_Emi"], ["application_id", "Emi_Eligibility"])
    assert x.join(y_reg, "application_id").join(y_clf, "application_id").select(*df.columns).exceptAll(df).count() == 0
