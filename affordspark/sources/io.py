"""Scans and sinks.

Stage hand-offs are parquet tables (typed, columnar, splittable); the split
table is written ``partitionBy("split")`` so a read of one split prunes the
others at planning time. Every writer overwrites atomically per path, so a
re-run after a lost executor or a failed job produces the same files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affordspark.functions.scalar import NUMBER_PATTERN, PLAIN_NUMBER, na_to_null, to_numeric_safe
from affordspark.schema import RAW_CSV_SCHEMA, TRUE_FALSE


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``{sf_dir}/{name}.parquet``, spread over all cores
    when the file has fewer splits than the cluster has task slots."""
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Make sure CPU-heavy row work (parsing, distances) runs on every core.

    A scan yields one task per file split; a small file with one row group
    is one task. If the input has fewer partitions than the cluster's
    default parallelism it is redistributed round-robin (even sizes, no key
    skew); a large input that already has enough splits is returned as is,
    so no shuffle is added at scale. A plan that is more than a scan is
    returned as is too: counting its partitions would run its joins."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    if plan.children().size() or df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def input_bytes(spark: SparkSession, paths) -> tuple:
    """(total bytes, version key) of the inputs, from the file system
    metadata (works for any Hadoop file system; no job)."""
    import hashlib
    total, parts = 0, []
    for path in paths:
        fs, p = _fs(spark, path)
        listed = []  # a directory's own time says nothing on object stores
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            listed.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        total += sum(n for _, n, _ in listed)
        parts.append(f"{path}:{hashlib.sha1(repr(sorted(listed)).encode()).hexdigest()}")
    return total, "|".join(parts)


_CODE_VERSION = None


def code_version() -> str:
    """Hash of this package's source, so stage tables written by other code
    are never reused."""
    global _CODE_VERSION
    if _CODE_VERSION is None:
        import hashlib
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        h = hashlib.sha1()
        for d, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    with open(os.path.join(d, f), "rb") as fh:
                        h.update(f.encode() + fh.read())
        _CODE_VERSION = h.hexdigest()[:12]
    return _CODE_VERSION


def stage_path(spark: SparkSession, name: str, sources) -> tuple:
    """(path, done) of a derived stage table under the shared checkpoint
    folder, keyed by the sources' sizes / modification times and the code
    version; ``done`` says a complete copy (``_SUCCESS``) exists."""
    import hashlib

    from affordspark.session import checkpoint_dir
    _, version = input_bytes(spark, sources)
    key = hashlib.sha1((version + code_version()).encode()).hexdigest()[:16]
    path = f"{checkpoint_dir(spark).rstrip('/')}/stages/{name}-{key}"
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return path, fs.exists(p)


def publish(spark: SparkSession, path: str, write, marker: str = "_SUCCESS") -> str:
    """Write a stage into a unique temporary sibling, then rename it into
    place. A failed or concurrent writer never leaves a half-written table
    at ``path``; if another writer published first, its copy is kept."""
    import uuid
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    write(tmp)
    fs, src = _fs(spark, tmp)
    _, dst = _fs(spark, path)
    if fs.exists(dst):
        if fs.exists(_fs(spark, f"{path}/{marker}")[1]):
            fs.delete(src, True)  # someone else published the same stage first
            return path
        fs.delete(dst, True)  # an old incomplete copy
    # (renaming onto an existing directory would nest inside it, hence the checks)
    if not fs.rename(src, dst):
        if not fs.exists(_fs(spark, f"{path}/{marker}")[1]):
            raise OSError(f"could not publish {path}; the complete copy is {tmp}")
        fs.delete(src, True)  # another writer was first
    return path


def stage_table(spark: SparkSession, name: str, sources, build) -> DataFrame:
    """A derived stage written once per source and code version under the
    shared checkpoint folder (``build()`` is only called when no complete
    copy exists), then scanned."""
    path, done = stage_path(spark, name, sources)
    if not done:
        publish(spark, path, lambda t: build().write.parquet(t))
    return spark.read.parquet(path)


def ingest_snapshot(spark: SparkSession, name: str, sources, build, file_bytes: int = 64 << 20,
                    fmt: str = "parquet"):
    """Materialise ``build()`` once per source version as parquet under the
    shared checkpoint folder and return a scan of it.

    The snapshot gets at least max(default parallelism, input bytes /
    ``file_bytes``) files: an input plan with fewer partitions is spread
    round-robin, a large one is written as it is partitioned (no extra
    shuffle). A complete snapshot (``_SUCCESS``) is reused; an incomplete
    one is rewritten."""
    size, _ = input_bytes(spark, sources)
    path, _ = stage_path(spark, name, sources)
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    if fmt == "csv":
        path += "-csv"
        fs, p = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        n = max(spark.sparkContext.defaultParallelism, -(-size // file_bytes))
        if fmt == "csv":
            publish(spark, path, lambda t: spread(build(), n).write.option("header", True).csv(t))
        else:
            publish(spark, path, lambda t: spread(build(), n).write.parquet(t))
    return path if fmt == "csv" else spark.read.parquet(path)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` once as parquet into the shared checkpoint
    folder and return a scan of it. One pass (a reliable ``checkpoint()`` of
    an unpersisted plan computes it twice), columnar, prunable on re-read,
    and a lost executor recomputes from this table, not from the source."""
    import uuid

    from affordspark.session import checkpoint_dir
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


_made: dict = {}


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables belong to the application that made them: they are
    deleted when its driver ends (lazy results may read them until then)."""
    import atexit
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made[key] = []
        atexit.register(_delete_made, spark, key)
    _made[key].append(path)


def _delete_made(spark: SparkSession, key: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped before; the folder is the cluster's to clear
        return
    for path in _made.pop(key, []):
        fs, p = _fs(spark, path)
        fs.delete(p, True)


# ---- scan_csv / scan_na_tokens ------------------------------------------------

def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             nrows: int | None = None, infer: bool = False) -> DataFrame:
    """Headered CSV read. By default every column is text (no pass over the
    data) and typing is the cleaner's job; with ``infer`` the columns are those
    of the header and get the types of ``inferred_types``, found in one pass
    over the whole of what is read. ``nrows`` keeps the first rows in file order
    (``limit_scan``). A missing path is an error raised by Spark at planning."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema or not infer:
        reader = reader.schema(schema or RAW_CSV_SCHEMA)
    df = reader.csv(path) if nrows is None else first_rows(spark, reader.csv, path, nrows)
    df = scan_na_tokens(spread(df))
    return typed(df, inferred_types(df)) if infer else df


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The data files under a path, in order of their paths."""
    fs, p = _fs(spark, path)
    if fs.getFileStatus(p).isFile():
        return [path]
    root, out = fs.makeQualified(p).toString().rstrip("/"), []
    files = fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath().toString()
        if not any(x.startswith(("_", ".")) for x in f[len(root):].strip("/").split("/")):
            out.append(f)
    return sorted(out)


def first_rows(spark: SparkSession, read, path: str, n: int) -> DataFrame:
    """The first n rows of the files under ``path``, files in order of their
    paths. Files are counted in that order only until n rows are found, none
    beyond them is opened; their rows are put in order by (path, block, row in
    the block), a top-n that is partial per task."""
    files, used, found = data_files(spark, path), [], 0
    for f in files:
        used.append(f)
        found += read([f]).limit(n - found).count()
        if found >= n:
            break
    df = read(used or path)
    if n <= 0:
        return df.limit(0)
    placed = df.select("*", F.col("_metadata.file_path").alias("path_"), F.col("_metadata.file_block_start").alias("block_"),
                       F.monotonically_increasing_id().alias("row_"))
    return placed.orderBy("path_", "block_", "row_").limit(n).select(*df.columns)


# what the values of a text column are, as bits: the kinds of two parts of a
# file are merged by bitwise or
_MISSING, _INTEGER, _DOUBLE, _BOOLEAN, _TEXT = 1, 2, 4, 8, 16


def value_kind(c) -> "F.Column":
    """Bit of one value of a text column."""
    c = F.col(c) if isinstance(c, str) else c
    whole = c.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(c).try_cast("bigint").isNotNull()
    # a plain number takes one match, text two that fail early
    plain = F.when(~c.contains(".") & c.try_cast("bigint").isNotNull(), _INTEGER).otherwise(_DOUBLE)
    other = F.when(whole, _INTEGER).when(to_numeric_safe(c).isNotNull(), _DOUBLE).otherwise(_TEXT)
    return (F.when(c.isNull(), _MISSING).when(c.rlike(PLAIN_NUMBER), plain).when(c.rlike(NUMBER_PATTERN), other)
            .when(c.isin(*TRUE_FALSE), _BOOLEAN).otherwise(_TEXT))


def inferred_types(df: DataFrame) -> dict[str, str]:
    """{column: type} of text columns, by all of their values (NULL: missing):
    ``bigint``, ``double``, ``boolean`` or ``string``. Whole numbers next to
    missing values, or beyond 64 bits, are doubles, as are columns with nothing
    but missing values; booleans next to missing values or numbers are text, and
    so are the columns of an empty table. One aggregate for all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}
    row = df.agg(*[F.bit_or(value_kind(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(texts)]).first()
    return {c: _type_of(row[i] or 0) for i, c in enumerate(texts)}


def _type_of(bits: int) -> str:
    if bits & _TEXT or not bits or (bits & _BOOLEAN and bits != _BOOLEAN):
        return "string"
    if bits == _BOOLEAN:
        return "boolean"
    return "bigint" if bits == _INTEGER else "double"


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns cast to their inferred types, in one projection."""
    def cast(c):
        x, kind = F.col(f"`{c}`"), types.get(c, "string")
        if kind == "double":
            x = to_numeric_safe(x)
        elif kind == "bigint":
            x = F.trim(x).try_cast("bigint")
        elif kind == "boolean":
            x = F.lower(x) == "true"
        return x.alias(c)
    return df.select(*[cast(c) for c in df.columns])


def scan_na_tokens(df: DataFrame) -> DataFrame:
    """Map the usual missing-value spellings to NULL on every string column,
    in one projection. A lone blank stays a value."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(na_to_null(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---- stage sinks / scans ------------------------------------------------------

def sink_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a table (parquet default, ``fmt='csv'`` for a headered CSV)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def scan_stage(spark: SparkSession, path: str, stage: str = "previous stage") -> DataFrame:
    """Read a stage written by ``sink_snapshot``; say which stage to run if absent."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # AnalysisException: PATH_NOT_FOUND
        raise FileNotFoundError(f"{path} not found; run the {stage} first") from e


def sink_splits(df: DataFrame, path: str) -> str:
    """One keyed table with a ``split`` column, partitioned by split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def scan_splits(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Read some splits; the ``split`` filter prunes directories at planning."""
    df = spark.read.parquet(path)
    if splits:
        df = df.where(F.col("split").isin(*splits))
    return df


def sink_predictions(pred: DataFrame, path: str, key: str = "application_id",
                     actual: str = "Actual", predicted: str = "Predicted") -> str:
    pred.select(key, F.col(actual).alias("Actual"), F.col(predicted).alias("Predicted")) \
        .write.mode("overwrite").parquet(path)
    return path


# ---- params / preprocessor / model -------------------------------------------

PARAMS_SCHEMA = T.StructType([
    T.StructField("task", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    T.StructField("validation_metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("smote_applied", T.BooleanType()),
    T.StructField("timestamp", T.StringType()),
])


def sink_params(spark: SparkSession, path: str, task: str, model_name: str, params: dict,
                metrics: dict, smote_applied: bool | None = None) -> str:
    """Winning model name, params, validation metrics and a timestamp as JSON."""
    row = [(task, model_name, {k: str(v) for k, v in params.items()},
            {k: (None if v is None else float(v)) for k, v in metrics.items()}, smote_applied, None)]
    df = spark.createDataFrame(row, PARAMS_SCHEMA) \
        .withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def scan_params(spark: SparkSession, path: str) -> dict:
    """Read back the params row (one small row; the only driver-side read)."""
    try:
        rows = spark.read.schema(PARAMS_SCHEMA).json(path).take(1)
    except Exception as e:
        raise FileNotFoundError(f"best params not found at {path}; run the trainer first") from e
    if not rows:
        raise FileNotFoundError(f"best params not found at {path}; run the trainer first")
    return rows[0].asDict(recursive=True)


def sink_preprocessor(params: dict, path: str) -> str:
    """Persist the fitted parameter tables (scaler, one-hot, labels) as parquet."""
    for name, df in params.items():
        if isinstance(df, DataFrame):
            df.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, name))
    return path


def scan_preprocessor(spark: SparkSession, path: str, names=("scaler_params", "ohe_categories",
                                                              "label_classes")) -> dict | None:
    """Reload the parameter tables; warn and return None if absent."""
    out = {}
    for name in names:
        try:
            out[name] = spark.read.parquet(os.path.join(path, name))
        except Exception:
            import warnings
            warnings.warn(f"preprocessor table {name} missing under {path}")
            return None
    return out


def sink_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path
