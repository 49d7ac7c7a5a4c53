"""Scoring of raw applications, as a table or a stream.

Every step is a projection, so the same functions serve both: names and parse ->
``validate_input`` -> engineered features -> fitted scaler and one-hot ->
vector -> classifier and regressor. No row is lost: applications that fail the
validation or lack a number that the models need are rejected with the reasons.

The stream writes each micro-batch to two tables, scored and rejected, in a
folder of the batch's id. A batch that runs again after a failure overwrites its
own folder, so with the checkpoint, which is required, a row is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.operators import clean, encode, features, linear, models, validate
from affordspark.schema import KEY, LABELS


def checked(df: DataFrame, needed, apply_caps: bool = False, rules: dict | None = None) -> DataFrame:
    """Raw applications -> engineered columns, is_valid, errors and raw (the
    input row as JSON). ``needed``: columns that must be numbers. Scoring skips
    the cleaning caps by default, as the original form does; ``apply_caps``
    clamps with the scenario rules and domain clips first."""
    out = clean.normalize_columns(df.select("*", F.to_json(F.struct("*")).alias("raw")))
    out = clean.parse_and_cast(out.withColumnRenamed("Raw", "raw"))
    out = clean.parsed_once(out, clean.PARSED_COLS)  # the checks and features mention them dozens of times
    if apply_caps:
        out = clean.domain_clip(clean.scenario_cap(out, rules))
    out = validate.validate_input(out)
    out = features.drop_redundant(features.engineered_features(out))
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in needed])
    errors = F.concat_ws("; ", F.when(F.col("errors") != "", F.col("errors")), F.when(missing != "", F.concat(F.lit("Missing value: "), missing)))
    out = out.withColumn("errors", errors)
    return out.withColumn("is_valid", F.col("errors") == "")


def _needed(prepared) -> list:
    dummies = set(encode.onehot_columns(encode._ohe_map(prepared.ohe_categories), prepared.cat_cols))
    return [c for c in prepared.feature_cols if c not in dummies]


def score_features(df: DataFrame, prepared, apply_caps: bool = False, rules: dict | None = None) -> DataFrame:
    """Raw applications -> key, is_valid, errors, raw and the model's feature
    columns with the fitted parameters."""
    out = checked(df, _needed(prepared), apply_caps, rules)
    out = encode.robust_scale(out, encode._scaler_map(prepared.scaler_params), prepared.num_cols)
    out = encode.onehot_encode(out, encode._ohe_map(prepared.ohe_categories), prepared.cat_cols)
    return out.select(KEY, "is_valid", "errors", "raw", *[F.col(c).cast("double").alias(c) for c in prepared.feature_cols])


def score_frame(df: DataFrame, prepared, classifier, regressor, labels=None, **caps) -> DataFrame:
    """The valid applications, scored by Spark ML models, or by two ``Linear``
    ones in a single projection."""
    if isinstance(classifier, linear.Linear):
        valid = checked(df, _needed(prepared), **caps).where("is_valid")
        return linear.linear_score(valid, classifier, regressor, encode._scaler_map(prepared.scaler_params),
                                   encode._ohe_map(prepared.ohe_categories), labels or LABELS)
    valid = score_features(df, prepared, **caps).where("is_valid")
    return models.score_batch(models.assembler(prepared.feature_cols).transform(valid), classifier, regressor, labels or LABELS)


def reject_frame(df: DataFrame, prepared, **caps) -> DataFrame:
    """The other applications: key, errors and the raw row as JSON."""
    return checked(df, _needed(prepared), **caps).where("NOT is_valid").select(KEY, "errors", "raw")


def batch_writer(prepared, classifier, regressor, path: str, labels=None, **caps):
    """``foreachBatch`` body: a micro-batch into ``{path}/scored`` and
    ``{path}/rejected``, folders ``batch=<id>``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            score_frame(batch, prepared, classifier, regressor, labels, **caps).write.mode("overwrite").parquet(f"{path}/scored/batch={batch_id}")
            reject_frame(batch, prepared, **caps).write.mode("overwrite").parquet(f"{path}/rejected/batch={batch_id}")
        finally:
            batch.unpersist()
    return write


def score_stream(spark: SparkSession, source_dir: str, schema: T.StructType, prepared, classifier, regressor, path: str, checkpoint: str,
                 query_name: str = "scored", labels=None, files_per_batch: int | None = None, trigger_once: bool = True, **caps):
    """Start the scoring stream over parquet files landing in ``source_dir``.
    Fitted parameters are read once (bounded), before the stream starts."""
    if not checkpoint:
        raise ValueError("a scoring stream needs a checkpoint folder: without one a restart would score rows again")
    src = spark.readStream.schema(schema)
    if files_per_batch:
        src = src.option("maxFilesPerTrigger", files_per_batch)
    w = (src.parquet(source_dir).writeStream.queryName(query_name).option("checkpointLocation", checkpoint)
         .foreachBatch(batch_writer(prepared, classifier, regressor, path, labels, **caps)))
    return (w.trigger(availableNow=True) if trigger_once else w).start()
