"""Session settings the library is designed for."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}  # folder of each local application that names none


def get_session(master: str | None = None, app: str = "parlance", **conf: str) -> SparkSession:
    """A session with UTC, ANSI mode and adaptive execution on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _local_folder(spark: SparkSession) -> str:
    """One folder for a local application, removed when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names.  The
    setting is required on a cluster; a local application without it gets one folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = _local_folder(spark)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder and read back: cuts the
    lineage, fixes values that depend on partitioning, and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    # Spark drops the shuffle files of a finished job when the driver collects its garbage,
    # which a small driver heap may not do for a long time
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pinned_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete the folder of a ``pinned`` table that no later step reads."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._pinned_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
