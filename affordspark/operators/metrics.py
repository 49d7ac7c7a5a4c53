"""Model metrics as DataFrame aggregates.

Every metric reduces the scored rows once (a partial aggregate per task,
then a small final aggregate); the heavy side never goes to the driver.
Grouped variants (``by=[...]``) give per-segment metrics in the same pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _by(by) -> list:
    return list(by or [])


# ---- classification -----------------------------------------------------------

def confusion_counts(df: DataFrame, actual: str, predicted: str, by=None) -> DataFrame:
    """(by..., actual, predicted, count) for the non-empty cells."""
    return df.groupBy(*_by(by), F.col(actual).alias("actual"), F.col(predicted).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels=None) -> DataFrame:
    """Every (actual, predicted) cell of the label grid, 0 where empty."""
    counts = confusion_counts(df, actual, predicted)
    if labels is None:  # bounded: one row per class
        labels = sorted({r[0] for r in counts.select("actual").union(counts.select("predicted"))
                         .distinct().collect() if r[0] is not None})
    dt = df.schema[actual].dataType
    grid = df.sparkSession.createDataFrame(
        [(a, p) for a in labels for p in labels],
        T.StructType([T.StructField("actual", dt), T.StructField("predicted", dt)]))
    return grid.join(F.broadcast(counts), ["actual", "predicted"], "left") \
        .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def per_class(df: DataFrame, actual: str, predicted: str, by=None) -> DataFrame:
    """(by..., class, support, predicted_n, tp, precision, recall, f1) with 0
    for an empty denominator (a class never predicted has precision 0)."""
    by = _by(by)
    c = confusion_counts(df, actual, predicted, by)
    a = c.groupBy(*by, F.col("actual").alias("class")).agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp"))
    p = c.groupBy(*by, F.col("predicted").alias("class")).agg(F.sum("count").alias("predicted_n"))
    j = a.join(p, [*by, "class"], "full_outer").select(
        *by, "class", F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("predicted_n", F.lit(0)).alias("predicted_n"), F.coalesce("tp", F.lit(0)).alias("tp"))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted_n")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return j.withColumn("f1", f1)


def cls_metrics(df: DataFrame, actual: str, predicted: str, by=None) -> DataFrame:
    """accuracy and support-weighted precision / recall / F1, plus macro
    averages (weighted recall equals accuracy by definition)."""
    by = _by(by)
    pc = per_class(df, actual, predicted, by)
    n = F.sum("support")
    w = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), n)
    present = F.col("support") > 0
    return pc.groupBy(*by).agg(
        n.cast("bigint").alias("n"),
        F.try_divide(F.sum("tp").cast("double"), n).alias("accuracy"),
        w("precision").alias("precision"), w("recall").alias("recall"), w("f1").alias("f1_score"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.count_if(present).cast("bigint").alias("n_classes"))


def prefix_sum(df: DataFrame, part: str, order: str, values, suffix: str = "_below") -> DataFrame:
    """For each row, the sum of ``values`` over rows of the same ``part``
    with a smaller ``order`` (rows must be unique per (part, order)).

    Distributed: a range-partitioned sort splits even one huge ``part``
    across many tasks; each task's totals (one small row per task and part)
    give the offsets, and a window inside each task adds the local sums."""
    from affordspark.sources.io import materialize
    tagged = materialize(df.orderBy(part, order).withColumn("_pid", F.spark_partition_id()), "prefix")
    tot = tagged.groupBy("_pid", part).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w_off = Window.partitionBy(part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (task, part): tiny, safe to window and broadcast
    offs = tot.select("_pid", part, *[F.coalesce(F.sum(f"_t_{v}").over(w_off), F.lit(0))
                                      .alias(f"_o_{v}") for v in values])
    w_loc = Window.partitionBy("_pid", part).orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(F.broadcast(offs), ["_pid", part])
    return out.select(*df.columns, *[
        (F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(w_loc), F.lit(0))).alias(f"{v}{suffix}")
        for v in values])


def roc_auc_ovr(df: DataFrame, actual: str, prob_cols: dict) -> DataFrame:
    """One-vs-rest AUC per class with ties counted half, plus the
    prevalence-weighted average (row with class 'weighted'). ``class`` is text. ``prob_cols`` maps class
    value -> probability column. A class absent from ``actual`` gets NULL.

    Rows are first reduced to (class, score) -> (pos, neg) counts, so the
    ordered part only sees distinct scores."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(p).cast("double").alias("score"),
                 (F.col(actual) == F.lit(c)).cast("int").alias("is_pos"))
        for c, p in prob_cols.items()])).alias("r")).select("r.*")
    agg = long.groupBy("class", "score").agg(F.sum("is_pos").cast("bigint").alias("pos"),
                                             F.sum(1 - F.col("is_pos")).cast("bigint").alias("neg"))
    ps = prefix_sum(agg, "class", "score", ["neg"])
    per = ps.groupBy("class").agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("_num"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    per = per.select(F.col("class").cast("string").alias("class"),
                     F.try_divide(F.col("_num"), F.col("n_pos") * F.col("n_neg")).alias("auc"),
                     F.col("n_pos").cast("bigint").alias("support"))
    total = per.agg(F.try_divide(F.sum(F.col("auc") * F.col("support")),
                                 F.sum(F.when(F.col("auc").isNotNull(), F.col("support"))))
                    .alias("auc"), F.sum("support").cast("bigint").alias("support"))
    return per.unionByName(total.select(F.lit("weighted").alias("class"), "auc", "support"))


# ---- regression ---------------------------------------------------------------

def reg_metrics(df: DataFrame, y: str, yhat: str, by=None) -> DataFrame:
    """RMSE, MAE, R^2, MAPE (%) in one pass. Constant y: R^2 = 1 if every
    residual is 0 else 0 (instead of a division error)."""
    e = F.col(y) - F.col(yhat)
    agg = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.sum(F.abs(e)).alias("_sae"),
        F.var_pop(F.col(y)).alias("_var"),
        F.avg(F.abs(e / (F.col(y) + F.lit(1e-10)))).alias("_mape"))
    sst = F.col("_var") * F.col("n")
    r2 = F.when(sst == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))) \
        .otherwise(1 - F.col("_sse") / sst)
    return agg.select(*_by(by), F.col("n").cast("bigint").alias("n"),
                      F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
                      (F.col("_sae") / F.col("n")).alias("mae"), r2.alias("r2_score"),
                      (F.col("_mape") * 100).alias("mape"))


def residuals(df: DataFrame, key: str, y: str, yhat: str) -> DataFrame:
    return df.select(key, F.col(yhat).alias("predicted"), (F.col(y) - F.col(yhat)).alias("residual"))


def pred_range(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Common [min, max] of actual and predicted (the diagonal of the plot)."""
    return df.agg(F.least(F.min(y), F.min(yhat)).alias("min_val"),
                  F.greatest(F.max(y), F.max(yhat)).alias("max_val"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("count"))


def target_summary(df: DataFrame, reg: str, clf: str) -> DataFrame:
    """min / max of the regression target, row count, sorted distinct classes
    (not NULL). Reduced to a row a class first."""
    per = df.groupBy(F.col(clf).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min(reg).alias("reg_min"), F.max(reg).alias("reg_max"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("reg_min").alias("reg_min"), F.max("reg_max").alias("reg_max"),
                   F.array_sort(F.collect_list("class")).alias("classes"))


def metric_rows(wide: DataFrame, id_cols, metric_cols) -> DataFrame:
    """Wide metrics -> long (id..., metric, value)."""
    return wide.select(*id_cols, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metric_cols])).alias("m")).select(*id_cols, "m.metric", "m.value")
