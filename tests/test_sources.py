"""Scans and sinks: CSV with missing tokens, stage / split / params /
preprocessor / model round trips, run-metrics log."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from affordspark.operators import encode, selection
from affordspark.sources import io


def test_scan_csv_tokens_and_limit(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "raw.csv")
    with open(p, "w") as f:
        f.write("application_id,age,gender\n1,45 years,M\n2,NA,F\n3,null, \n4,N/A,m\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("application_id", "age", "gender")])
    df = io.scan_csv(spark, p, schema)
    rows = {r["application_id"]: (r["age"], r["gender"]) for r in df.collect()}
    assert rows["1"] == ("45 years", "M")
    assert rows["2"][0] is None and rows["3"][0] is None and rows["4"][0] is None
    assert io.scan_csv(spark, p, schema, nrows=2).count() == 2


def test_inferred_types(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "typed.csv")
    with open(p, "w") as f:
        f.write("i,with missing,d,big,b,b2,t,none,mixed,spaces\n"
                "1,1,1.5,1,True,true,x,NA,1, 7\n"
                "-2,NA,2e3,99999999999999999999,false,,2,,True,8 \n"
                "+3,3,.5,3,TRUE,FALSE,3,null,2,9\n")
    df = io.scan_csv(spark, p, infer=True)
    assert dict(df.dtypes) == {"i": "bigint", "with missing": "double", "d": "double", "big": "double", "b": "boolean", "b2": "string",
                               "t": "string", "none": "double", "mixed": "string", "spaces": "bigint"}
    assert sorted(tuple(r) for r in df.select("i", "with missing", "d", "b", "spaces").collect()) == [(-2, None, 2000.0, False, 8), (1, 1.0, 1.5, True, 7), (3, 3.0, 0.5, True, 9)]
    # the kinds of any two parts merge to those of the whole
    parts = [io.scan_csv(spark, p, infer=True, nrows=n) for n in (1, 2)]
    assert dict(parts[0].dtypes)["with missing"] == "bigint" and dict(parts[1].dtypes)["with missing"] == "double"
    with open(p, "w") as f:
        f.write("a,b\n")
    assert set(dict(io.scan_csv(spark, p, infer=True).dtypes).values()) == {"string"}


def test_first_rows_open_no_further_file(spark, tmpdir_path):
    schema = "a long, b string"
    for i in range(5):
        with open(os.path.join(tmpdir_path, f"part-{i}.csv"), "w") as f:
            f.write("a,b\n" + "".join(f"{i * 10 + j},x\n" for j in range(10)))
    os.makedirs(os.path.join(tmpdir_path, "_temporary"))
    with open(os.path.join(tmpdir_path, "_temporary", "part-0.csv"), "w") as f:
        f.write("a,b\n-1,x\n")
    opened = []

    def read(paths):
        opened.extend([paths] if isinstance(paths, str) else paths)
        return spark.read.option("header", True).schema(schema).csv(paths)
    for n, last in ((3, 0), (10, 0), (11, 1), (25, 2), (500, 4), (0, 0)):
        opened.clear()
        got = io.first_rows(spark, read, tmpdir_path, n)
        assert sorted(r["a"] for r in got.collect()) == list(range(min(n, 50)))
        assert {os.path.basename(f) for f in opened} == {f"part-{i}.csv" for i in range(last + 1)}
        assert {os.path.basename(f) for f in got.inputFiles()} <= {f"part-{i}.csv" for i in range(last + 1)}


def test_stage_and_split_round_trip(spark, tmpdir_path):
    df = spark.range(100).select(F.col("id").alias("application_id"),
                                 F.when(F.col("id") < 70, "train").when(F.col("id") < 85, "val")
                                 .otherwise("test").alias("split"))
    io.sink_snapshot(df, os.path.join(tmpdir_path, "stage"))
    assert io.scan_stage(spark, os.path.join(tmpdir_path, "stage")).count() == 100
    with pytest.raises(FileNotFoundError):
        io.scan_stage(spark, os.path.join(tmpdir_path, "missing"), "cleaner")
    io.sink_splits(df, os.path.join(tmpdir_path, "splits"))
    tv = io.scan_splits(spark, os.path.join(tmpdir_path, "splits"), "train", "val")
    assert tv.count() == 85
    import contextlib
    import io as _io
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        tv.explain()
    assert "PartitionFilters: [split" in buf.getvalue()  # directory pruning, not a row filter


def test_params_and_preprocessor(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "params")
    io.sink_params(spark, path, "classification", "Random_Forest", {"n_estimators": 20},
                   {"f1_score": 0.9}, smote_applied=True)
    got = io.scan_params(spark, path)
    assert got["model_name"] == "Random_Forest" and got["parameters"]["n_estimators"] == "20"
    assert got["smote_applied"] is True and got["timestamp"]
    with pytest.raises(FileNotFoundError):
        io.scan_params(spark, os.path.join(tmpdir_path, "nope"))
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b")], "x double, c string")
    pre = {"scaler_params": encode.robust_fit(df, ["x"]), "ohe_categories": encode.onehot_fit(df, ["c"]),
           "label_classes": encode.label_classes(spark)}
    io.sink_preprocessor(pre, os.path.join(tmpdir_path, "pre"))
    back = io.scan_preprocessor(spark, os.path.join(tmpdir_path, "pre"))
    assert back["ohe_categories"].count() == 2
    with pytest.warns(UserWarning):
        assert io.scan_preprocessor(spark, os.path.join(tmpdir_path, "none")) is None


def test_model_and_metrics_log(spark, tmpdir_path):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.classification import DecisionTreeClassificationModel
    from pyspark.ml.linalg import Vectors
    train = spark.createDataFrame([(Vectors.dense([float(i % 2)]), float(i % 2)) for i in range(20)],
                                  ["features", "label"])
    m = DecisionTreeClassifier().fit(train)
    io.sink_model(m, os.path.join(tmpdir_path, "model"))
    assert DecisionTreeClassificationModel.load(os.path.join(tmpdir_path, "model")).numNodes == m.numNodes
    log = os.path.join(tmpdir_path, "run_metrics")
    selection.metrics_log(spark, log, {"accuracy": 0.9}, "r1", None, "final", "classification", "m", "test",
                          prefix="test_")
    selection.metrics_log(spark, log, {"rmse": 10.0}, "r2", "r1", "final", "regression", "m", "test")
    rows = spark.read.parquet(log).orderBy("run_id").collect()
    assert [(r["metric"], r["value"]) for r in rows] == [("test_accuracy", 0.9), ("rmse", 10.0)]
