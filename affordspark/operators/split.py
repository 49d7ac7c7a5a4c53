"""Repeatable splits and folds.

The default split is a pure function of (seed, key): no shuffle, no
dependence on partitioning, and the same bucket in any engine that has md5.
The exact-size split and the stratified folds need a global position; it is
computed with a range-partitioned sort plus per-partition offsets (what
``zipWithIndex`` does), never with a window over a single partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.schema import KEY, RANDOM_STATE, TEMP_FRACTION, TEST_FRACTION

BUCKETS = 10_000


def hash_bucket(key, seed: int = RANDOM_STATE, buckets: int = BUCKETS) -> Column:
    """First 32 bits of md5('seed|key') modulo ``buckets``."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string"))), 1, 8), 16, 10)
    return (h.cast("bigint") % F.lit(buckets)).cast("bigint")


def split_70_15_15(df: DataFrame, key: str = KEY, seed: int = RANDOM_STATE,
                   exact: bool = False) -> DataFrame:
    """Add ``split`` in {train, val, test}: 70 % / 15 % / 15 %, not stratified.

    Default: bucket of md5(seed|key) (sizes exact in expectation). With
    ``exact`` the sizes are exact: the held-out side gets ceil(0.30 n) rows,
    test gets ceil(half of it), ordered by the same hash."""
    if not exact:
        b = hash_bucket(key, seed)
        train_cut = int(round(BUCKETS * (1 - TEMP_FRACTION)))
        val_cut = train_cut + int(round(BUCKETS * TEMP_FRACTION * (1 - TEST_FRACTION)))
        return df.withColumn("split", F.when(b < train_cut, "train")
                             .when(b < val_cut, "val").otherwise("test"))
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    idx = ordered_index(df.withColumn("_h", h), ["_h", key])
    n = idx.count()
    n_temp = math.ceil(n * TEMP_FRACTION)
    n_train = n - n_temp
    n_test = math.ceil(n_temp * TEST_FRACTION)
    n_val = n_temp - n_test
    i = F.col("_idx")
    return idx.withColumn("split", F.when(i < n_train, "train")
                          .when(i < n_train + n_val, "val").otherwise("test")) \
              .drop("_idx", "_h")


def ordered_index(df: DataFrame, order_cols, name: str = "_idx") -> DataFrame:
    """0-based global position in ``order_cols`` order, computed distributed:
    range-partitioned sort, per-partition counts (one small row per
    partition), offsets broadcast back. The sorted rows are written with
    their (partition, position) tags first, so both passes see the same
    positions even if an executor is lost in between."""
    from affordspark.sources.io import materialize
    tagged = materialize(df.orderBy(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "ordered")
    counts = tagged.groupBy("_pid").count().collect()  # one row per partition
    offsets, acc = [], 0
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((r["_pid"], acc))
        acc += r["count"]
    off = df.sparkSession.createDataFrame(
        offsets, T.StructType([T.StructField("_pid", T.IntegerType()),
                               T.StructField("_off", T.LongType())]))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return tagged.join(F.broadcast(off), "_pid") \
        .withColumn(name, F.col("_off") + local).drop("_pid", "_mid", "_off")


def union_train_val(df: DataFrame) -> DataFrame:
    """Train and validation rows together (bag semantics) via partition pruning."""
    return df.where(F.col("split").isin("train", "val"))


def cv_folds(df: DataFrame, k: int = 3, label: str | None = None, key: str = KEY,
             seed: int = RANDOM_STATE, exact: bool = False) -> DataFrame:
    """Add an int ``fold`` in [0, k).

    Without ``label``: contiguous-equivalent folds by hash bucket. With
    ``label`` (stratified): by default the hash bucket as well (each class is
    spread evenly in expectation, no shuffle); with ``exact`` every class is
    split into folds whose sizes differ by at most one, using the position of
    the row inside its class in hash order."""
    if label is None or not exact:
        return df.withColumn("fold", (hash_bucket(key, seed + 1) % k).cast("int"))
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    idx = ordered_index(df.withColumn("_h", h), [label, "_h", key])
    first = idx.groupBy(label).agg(F.min("_idx").alias("_first"))  # one row per class
    return idx.join(F.broadcast(first), label) \
        .withColumn("fold", ((F.col("_idx") - F.col("_first")) % k).cast("int")) \
        .drop("_idx", "_first", "_h")
