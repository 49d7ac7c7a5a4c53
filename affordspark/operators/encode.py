"""Fitted encoders as parameter tables.

``*_fit`` runs one aggregate over the (train) rows. Scaler tables have one row
per column and are applied as literals, a map-only projection. Dictionaries
(categories, labels) have one row per value, however many there are: their
ranks come from a range sort and partition counts, never from the driver. A
small dictionary goes into the expression, a larger one is joined, broadcast or
shuffled as its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.schema import LABELS

MAX_CATEGORIES = 10_000  # columns that onehot_encode may make; onehot_indices has no such bound
MAP_ROWS = 64  # dictionary rows that go into an expression

SCALER_SCHEMA = T.StructType([T.StructField("col", T.StringType()),
                              T.StructField("center", T.DoubleType()),
                              T.StructField("scale", T.DoubleType())])
OHE_SCHEMA = T.StructType([T.StructField("col", T.StringType()),
                           T.StructField("idx", T.IntegerType()),
                           T.StructField("category", T.StringType())])
LABEL_SCHEMA = T.StructType([T.StructField("idx", T.IntegerType()),
                             T.StructField("label", T.StringType())])


# ---- robust scaler ------------------------------------------------------------

def robust_fit(df: DataFrame, cols, method: str = "select") -> DataFrame:
    """Median and IQR (25-75, linear interpolation) of each column; a zero
    IQR scales by 1. ``select``: exact quantiles by distributed narrowing
    (all columns and quartiles in the same passes, bounded per task);
    ``exact``: Spark ``percentile`` in one pass (single-task value map)."""
    if method == "select":
        from affordspark.operators.clean import select_quantiles_multi
        got = select_quantiles_multi(df, [(c, q) for c in cols for q in (0.25, 0.5, 0.75)])
        row = {c: (None if got[(c, 0.5)] is None else
                   [got[(c, 0.25)], got[(c, 0.5)], got[(c, 0.75)]]) for c in cols}
    else:
        aggs = [F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c)
                for c in cols]
        row = df.agg(*aggs).first()
    rows = []
    for c in cols:
        q = row[c]
        if q is None:
            rows.append((c, 0.0, 1.0))
            continue
        iqr = q[2] - q[0]
        rows.append((c, float(q[1]), float(iqr) if abs(iqr) > 1e-300 else 1.0))
    return df.sparkSession.createDataFrame(rows, SCALER_SCHEMA)


def _scaler_map(params) -> dict:
    if isinstance(params, dict):
        return params
    return {r["col"]: (r["center"], r["scale"]) for r in params.collect()}


def robust_scale(df: DataFrame, params, cols=None) -> DataFrame:
    """(x - median) / IQR for the fitted columns, in place."""
    p = _scaler_map(params)
    cols = [c for c in (cols or p) if c in df.columns]
    return df.select(*[((F.col(c) - F.lit(p[c][0])) / F.lit(p[c][1])).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


# ---- one-hot ------------------------------------------------------------------

def distinct_values(df: DataFrame, cols) -> DataFrame:
    """(col, category) for every distinct non-NULL value of every column, in
    one pass: each row is exploded into (col, value) pairs and deduplicated
    with a map-side partial aggregate before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"),
                                         F.col(c).cast("string").alias("category"))
                                for c in cols]))
    return df.select(pairs.alias("p")).select("p.col", "p.category") \
        .where(F.col("category").isNotNull()).distinct()


def category_presence(df: DataFrame, cols, train_flag) -> list:
    """One pass over all rows: every (col, category) with ``in_train`` =
    whether it occurs in a row where ``train_flag`` holds. Bounded output
    (one row per category), deduplicated map-side before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"),
                                         F.col(c).cast("string").alias("category"))
                                for c in cols]))
    rows = df.select(pairs.alias("p"), train_flag.cast("int").alias("t")) \
        .select("p.col", "p.category", "t").where(F.col("category").isNotNull()) \
        .groupBy("col", "category").agg(F.max("t").alias("in_train"))
    return bounded_rows(rows, "categories")


def bounded_rows(df: DataFrame, what: str, most: int = MAX_CATEGORIES) -> list:
    """The rows of a fitted table, at most ``most`` of them: each becomes a
    column or a branch of an expression, so a larger table is an error, and
    never more than ``most + 1`` rows are sent to the driver."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def dictionary(df: DataFrame, cols) -> DataFrame:
    """(col, idx, category): the distinct non-NULL values of every column as
    text, numbered in their sorted order. Written once, of any size."""
    from affordspark.operators.split import ordered_index
    placed = ordered_index(distinct_values(df, cols), ["col", "category"])
    first = placed.groupBy("col").agg(F.min("_idx").alias("_first"))  # one row per column
    return placed.join(F.broadcast(first), "col").select("col", (F.col("_idx") - F.col("_first")).cast("int").alias("idx"), "category")


def onehot_fit(df: DataFrame, cols) -> DataFrame:
    """Sorted distinct categories per column -> (col, idx, category)."""
    return dictionary(df, cols)


def looked_up(df: DataFrame, value, table: DataFrame, out: str) -> DataFrame:
    """df plus ``out``: the second column of ``table`` where its first (unique,
    not NULL) equals ``value``; NULL where there is none."""
    few = table.take(MAP_ROWS + 1)
    if len(few) <= MAP_ROWS:
        kind = table.schema[1].dataType
        pairs = [x for k, v in few for x in (F.lit(k), F.lit(v).cast(kind))]
        found = F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast(kind)
        return df.withColumn(out, found)
    import uuid
    k, v = (f"{x}_{uuid.uuid4().hex[:8]}" for x in "kv")
    return df.join(table.toDF(k, v), value == F.col(k), "left").select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col(v).alias(out))


def onehot_indices(df: DataFrame, cats: DataFrame, cols, out: str = "indices") -> tuple[DataFrame, int]:
    """(df plus ``out``, width): the one-hot vector of ``cols`` in sparse form,
    the ascending places of its ones among ``width`` columns, in the order of
    ``onehot_columns``. Unknown or NULL values have no place."""
    import uuid
    sizes = {r["col"]: r["count"] for r in cats.groupBy("col").count().collect()}  # one row per column
    at, made = 0, []
    for c in cols:
        made.append(f"i_{uuid.uuid4().hex[:8]}")
        table = cats.where(F.col("col") == c).select("category", (F.col("idx") + at).cast("int").alias("place"))
        df = looked_up(df, F.col(f"`{c}`").cast("string"), table, made[-1])
        at += sizes.get(c, 0)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made and c != out], F.array_compact(F.array(*made)).alias(out)), at


def _ohe_map(cats) -> dict:
    if isinstance(cats, dict):
        return cats
    m: dict = {}
    for r in sorted(bounded_rows(cats, "categories; onehot_indices has no such bound"), key=lambda r: (r["col"], r["idx"])):
        m.setdefault(r["col"], []).append(r["category"])
    return m


def onehot_columns(cats, cols) -> list:
    m = _ohe_map(cats)
    return [f"{c}_{v}" for c in cols for v in m.get(c, [])]


def onehot_encode(df: DataFrame, cats, cols, keep_source: bool = False) -> DataFrame:
    """Full dummy set ``Col_Value`` (nothing dropped); unknown or NULL -> all 0."""
    m = _ohe_map(cats)
    dummies = [F.when(F.col(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}")
               for c in cols for v in m.get(c, [])]
    base = [F.col(c) for c in df.columns if keep_source or c not in cols]
    return df.select(*base, *dummies)


# ---- labels -------------------------------------------------------------------

def label_fit(df: DataFrame, target: str) -> DataFrame:
    """Sorted distinct labels -> (idx, label), however many."""
    return dictionary(df, [target]).select("idx", F.col("category").alias("label"))


def label_classes(spark: SparkSession, labels=None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(labels or LABELS)), LABEL_SCHEMA)


def _classes(df: DataFrame, classes) -> DataFrame:
    return classes if isinstance(classes, DataFrame) else label_classes(df.sparkSession, list(classes))


def label_encode(df: DataFrame, target: str, classes, out: str = "label") -> DataFrame:
    """Label text -> int index of the sorted label list (NULL if unseen)."""
    return looked_up(df, F.col(target).cast("string"), _classes(df, classes).select("label", "idx"), out)


def label_decode(df: DataFrame, idx_col: str, classes, out: str = "eligibility_label") -> DataFrame:
    """Class index -> label; an index outside the table gives 'Unknown'."""
    found = looked_up(df, F.col(idx_col).cast("int"), _classes(df, classes).select("idx", "label"), out)
    return found.withColumn(out, F.coalesce(out, F.lit("Unknown")))


def unseen_labels(df: DataFrame, target: str, classes: DataFrame) -> DataFrame:
    """Rows whose label is not in the fitted classes: a left anti join that
    Spark broadcasts or shuffles by the size of the class table."""
    return df.join(classes.select(F.col("label").alias(target)).distinct(), target, "left_anti")
