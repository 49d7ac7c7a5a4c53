"""SparkSession helpers.

On a cluster the session comes from the launcher; ``get_session`` only fills
in settings that are unset. ``checkpoint_dir`` reads ``spark.checkpoint.dir``
from the session and only invents a local folder when nothing is configured
(tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # The cleaning chain is many aliasing projections over NOT NULL filters;
    # constraint propagation grows exponentially on such plans (planning
    # never ends at 28 columns). It only feeds filter inference, which these
    # plans do not need.
    "spark.sql.constraintPropagation.enabled": "false",
    # The JVM never compiles a method of more than 8000 bytes. Fused stages over
    # 28 columns are longer and would be interpreted for every row; beyond this
    # limit Spark runs their operators one by one, in short methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Runtime (non-static) settings the operators rely on; applied to whatever
# session the caller hands in.
RUNTIME = {
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a caller's session (idempotent)."""
    for k, v in RUNTIME.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, app: str = "affordspark",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: ``spark.checkpoint.dir`` if the cluster
    names one, else a fresh local folder; on a cluster without one, an error
    (executors would write to their own disks)."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="affordspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
