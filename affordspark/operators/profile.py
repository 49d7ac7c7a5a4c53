"""Data profiling: summary statistics, counts, histograms, correlations,
samples. Each panel is one aggregate job whose output size is bounded by the
number of columns / categories / bins, never by the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.functions.scalar import MAX_DOUBLE, to_numeric_safe

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def columns_by_kind(df: DataFrame) -> dict:
    """{'numeric': [...], 'text': [...]} from the schema (no job)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
    txt = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return {"numeric": num, "text": txt}


def dataset_overview(df: DataFrame) -> DataFrame:
    """rows, columns, numeric and text column counts (one count job)."""
    kinds = columns_by_kind(df)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(kinds["numeric"])).cast("bigint").alias("n_numeric"),
        F.lit(len(kinds["text"])).cast("bigint").alias("n_text"))


def coerce_columns(df: DataFrame, cols) -> DataFrame:
    """Numeric-or-NULL on the listed columns that exist. Numeric columns only
    lose what is no finite number; text is parsed."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)}

    def number(c):
        x = F.col(c).cast("double")
        return F.when(F.abs(x) <= F.lit(MAX_DOUBLE), x) if c in numeric else to_numeric_safe(c)

    return df.select(*[number(c).alias(c) if c in set(cols) else F.col(c) for c in df.columns])


def describe_numeric(df: DataFrame, cols, method: str = "select") -> DataFrame:
    """count, mean, std (sample), min, 25/50/75 % (exact, linear), max per
    column; NULLs skipped. Moments in one aggregate pass; quartiles exact by
    distributed narrowing (``select``, bounded per task) or Spark
    ``percentile`` (``exact``). Reshaped to one row per column on the
    executors (``inline``)."""
    aggs, quart = [], None
    if method == "select":
        from affordspark.operators.clean import select_quantiles_multi
        quart = select_quantiles_multi(df, [(c, q) for c in cols for q in (0.25, 0.5, 0.75)])
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max")]
        if quart is None:
            aggs.append(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}__q"))
    wide = df.agg(*aggs)

    def quartile(c, i):
        # found before: an aggregate over such an array would turn all of them into object aggregates
        return F.col(f"{c}__q")[i] if quart is None else F.lit(quart[(c, (0.25, 0.5, 0.75)[i])]).cast("double")

    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"),
                     F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                     F.col(f"{c}__min").alias("min"), quartile(c, 0).alias("p25"),
                     quartile(c, 1).alias("p50"), quartile(c, 2).alias("p75"),
                     F.col(f"{c}__max").alias("max")) for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, cols) -> DataFrame:
    """(column, value, count) for every non-NULL value, most frequent first.
    A hot value is fine: counts are combined map-side before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                         F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).select("p.column", "p.value") \
        .where(F.col("value").isNotNull()) \
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy("column", F.desc("count"), "value")


def histogram(df: DataFrame, col: str, nbins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed); every bin is
    returned, empty ones with 0. One min/max job, one count job."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, count bigint")
    width = (hi - lo) / nbins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(nbins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = spark.range(nbins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation for every ordered pair, pairwise-complete rows.
    A constant column (or pair with < 2 rows) gives NULL.

    Two passes whatever the number of columns: the means, then one Gramian
    matrix of the vectors (x - mean, (x - mean)^2, x is present) of each row,
    whose entries are all counts, sums, squares and products of the pairs. It
    is added up on the executors; the driver gets 3 x 3 numbers per pair."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    cols = list(cols)
    if len(cols) < 2:
        raise ValueError("corr_matrix needs at least two numeric columns")
    x = {c: F.col(c).cast("double") for c in cols}
    row = df.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cols)], *[F.max(F.abs(x[c])).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    mean = [0.0 if row[f"m{i}"] is None else row[f"m{i}"] for i in range(len(cols))]
    top = [row[f"a{i}"] or 0.0 for i in range(len(cols))]
    n = len(cols)
    g = None
    if any(row[f"m{i}"] is not None for i in range(n)):
        # divided by the largest magnitude, so that squares neither overflow nor vanish
        z = [(x[c] - F.lit(mean[i])) / F.lit(top[i] or 1.0) for i, c in enumerate(cols)]
        parts = [F.coalesce(v, F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(z)]
        parts += [F.coalesce(v * v, F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(z)]
        parts += [x[c].isNotNull().cast("double").alias(f"p{i}") for i, c in enumerate(cols)]
        names = [f"{k}{i}" for k in "vsp" for i in range(n)]
        vectors = VectorAssembler(inputCols=names, outputCol="w").transform(df.select(*parts)).select("w")
        g = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "w")).computeGramianMatrix().toArray()
    out = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = None
            k = 0.0 if g is None else g[2 * n + i, 2 * n + j]
            if k >= 2:
                sa, sb = g[i, 2 * n + j], g[j, 2 * n + i]
                va, vb = g[n + i, 2 * n + j] - sa * sa / k, g[n + j, 2 * n + i] - sb * sb / k
                # below the rounding of the sums: constant
                if va > 1e-24 * k and vb > 1e-24 * k:
                    r = 1.0 if i == j else max(-1.0, min(1.0, float((g[i, j] - sa * sb / k) / (va * vb) ** 0.5)))
            out.append((a, b, r))
    return df.sparkSession.createDataFrame(out, "col_a string, col_b string, corr double")


def sample_n(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """Repeatable uniform sample of min(n, rows) rows: the n smallest
    md5(seed|key). Planned as a per-partition top-n then a merge
    (``TakeOrderedAndProject``), so no full sort."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return df.orderBy(h, F.col(key)).limit(n)


def head_n(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First n rows by key (Spark tables have no file order)."""
    return df.orderBy(key).limit(n)
