"""Batch preparation: raw applications -> cleaned -> engineered -> split ->
fitted encoders -> model-ready table (survey ids ``clean_pipeline`` and
``fe_pipeline``).

Stage outputs that are read more than once are written as tables into the
shared checkpoint folder, so each source scan and parse runs once
and a lost executor recomputes from the last cut, not from the raw CSV.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affordspark.operators import clean, encode, features, split
from affordspark.schema import (CATEGORICAL_COLS, KEY, NUMERIC_COLS, RANDOM_STATE, TARGET_CLF,
                                TARGET_REG)
from affordspark.sources.io import materialize


def cut(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    if not enabled:
        return df
    return materialize(df)


def clean_stage(raw: DataFrame, rules: dict | None = None, quantile_method: str = "select",
                materialize: bool = True) -> DataFrame:
    """The cleaning chain as a stage of the preparation."""
    return clean.clean_applications(raw, rules, quantile_method, cut=materialize)


@dataclass
class Prepared:
    table: DataFrame          # key, split, features..., TARGET_REG, label
    feature_cols: list
    num_cols: list
    cat_cols: list
    remainder_cols: list
    scaler_params: DataFrame
    ohe_categories: DataFrame
    label_classes: DataFrame

    def params(self) -> dict:
        return {"scaler_params": self.scaler_params, "ohe_categories": self.ohe_categories,
                "label_classes": self.label_classes}


def prepare_features(cleaned: DataFrame, key: str = KEY, seed: int = RANDOM_STATE,
                     exact_split: bool = False, materialize: bool = False,
                     check_unseen: bool = True) -> Prepared:
    """create -> drop -> split -> labels -> fit(train) -> transform all.

    The split table feeds two small fits and the transform. Upstream of it
    is the written clipped table plus cheap projections (caps, ratios, an
    md5 bucket), so by default it is recomputed from that table rather than
    written again (a full-size write costs more than two projection scans);
    ``materialize=True`` writes it when the input is not already cut."""
    eng = features.drop_redundant(features.engineered_features(cleaned))
    df = cut(split.split_70_15_15(eng, key, seed, exact=exact_split), materialize)
    train = df.where(F.col("split") == "train")

    num_cols = [c for c in NUMERIC_COLS if c in eng.columns and c not in (TARGET_REG, TARGET_CLF)]
    cat_cols = [c for c in CATEGORICAL_COLS if c in eng.columns]
    # one pass for label classes, one-hot categories and the unseen-label check
    seen = encode.category_presence(df, cat_cols + [TARGET_CLF], F.col("split") == "train")
    spark = df.sparkSession
    labels = sorted(r["category"] for r in seen if r["col"] == TARGET_CLF and r["in_train"])
    if check_unseen and any(r["col"] == TARGET_CLF and not r["in_train"] for r in seen):
        raise ValueError("val/test contain labels not seen in train")
    classes = spark.createDataFrame(list(enumerate(labels)), encode.LABEL_SCHEMA)
    cat_rows = [(c, i, v) for c in cat_cols for i, v in enumerate(
        sorted(r["category"] for r in seen if r["col"] == c and r["in_train"]))]
    cats = spark.createDataFrame(cat_rows, encode.OHE_SCHEMA)
    scaler = encode.robust_fit(train, num_cols)

    out = encode.label_encode(df, TARGET_CLF, classes)
    out = encode.robust_scale(out, scaler, num_cols)
    out = encode.onehot_encode(out, cats, cat_cols)
    ohe_cols = encode.onehot_columns(cats, cat_cols)
    skip = set(num_cols) | set(cat_cols) | {key, "split", TARGET_REG, TARGET_CLF, "label"}
    remainder = [c for c in eng.columns if c not in skip]
    feats = num_cols + ohe_cols + remainder
    table = out.select(key, "split", *[F.col(c).cast("double").alias(c) for c in feats],
                       F.col(TARGET_REG).cast("double").alias(TARGET_REG), "label")
    return Prepared(table, feats, num_cols, cat_cols, remainder, scaler, cats, classes)


def prepared_stage(spark, sf_dir: str, raw_builder) -> Prepared:
    """The model-ready table as a stage hand-off (like the original's
    processed split files + preprocessor): written once per source and code
    version, partitioned by ``split`` (a split read prunes directories), with
    the three parameter tables beside it; later stages scan it."""
    from affordspark.schema import ENGINEERED_COLS
    from affordspark.sources import io
    sources = [f"{sf_dir}/orders.parquet", f"{sf_dir}/customer.parquet"]
    path, _ = io.stage_path(spark, "prepared", sources)
    fs, marker = io._fs(spark, f"{path}/table/_SUCCESS")  # table is written last
    if not fs.exists(marker):
        p = prepare_features(clean_stage(raw_builder()))

        def write(tmp):
            io.sink_preprocessor(p.params(), f"{tmp}/params")
            io.sink_splits(p.table, f"{tmp}/table")
        io.publish(spark, path, write, marker="table/_SUCCESS")
    table = spark.read.parquet(f"{path}/table")
    params = io.scan_preprocessor(spark, f"{path}/params")
    cols = [c for c in table.columns if c not in (KEY, "split", TARGET_REG, "label")]
    num = [c for c in NUMERIC_COLS if c in cols]
    rem = [c for c in ENGINEERED_COLS if c in cols]
    table = table.select(KEY, "split", *cols, TARGET_REG, "label")
    return Prepared(table, cols, num, list(CATEGORICAL_COLS), rem, params["scaler_params"],
                    params["ohe_categories"], params["label_classes"])
