"""Tables that cut lineage, written to the shared folder of the session."""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where that is unset
    and Spark runs on one machine (tests). A cluster without it is an error:
    executors would write to their own disks."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile
        folder = tempfile.mkdtemp(prefix="affordspark-llm-")
        sc.setCheckpointDir(folder)
    return folder


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that written() and appended() make inside are deleted at the end,
    but for those that the block takes off the list it is given."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        dropped(*made)


def _note(df: DataFrame, path: str) -> DataFrame:
    df._written_path = path
    if _scopes:
        _scopes[-1].append(df)
    return df


def written(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends
    in files that outlive any executor. They are deleted when the driver ends,
    or by dropped() before. With parts, by at most so many tasks: where every
    shuffle partition makes a file of a few rows, and the folder is a local one,
    executors start three processes (chmod) for each."""
    from affordspark.sources.io import delete_at_exit
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return _note(spark.read.schema(df.schema).parquet(path), path)


def appended(spark: SparkSession, frames, name: str, schema) -> DataFrame:
    """Write frames, one after the other, into one table of the shared folder
    and read it back. frames gives (frame, broadcasts that it alone uses);
    none give an empty table."""
    from affordspark.sources.io import delete_at_exit
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    spark.createDataFrame([], schema).write.parquet(path)
    for df, sent in frames:
        df.write.mode("append").parquet(path)
        for b in sent:
            b.destroy()
    return _note(spark.read.schema(schema).parquet(path), path)


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path:
            spark = df.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tagged(*names: str) -> list[str]:
    """Column names of our own that no table has."""
    tag = uuid.uuid4().hex[:8]
    return [f"{n}_{tag}" for n in names]


def parts_for(nbytes: int, each: int, least: int) -> int:
    return max(least, math.ceil(nbytes / each))


def text_bytes_of(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of the column): one narrow aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return r["n"], r["b"] or 0


PART_BYTES, LEAST_PARTS = 4 << 20, 16


def text_parts(nbytes: int) -> int:
    """Tasks that are enough to write a table made from so many bytes of text."""
    return parts_for(nbytes, PART_BYTES, LEAST_PARTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
