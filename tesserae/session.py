"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Driver tables that every query may read.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_session(app: str = "tesserae", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the library expects: UTC, ANSI (the default), AQE."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true")
    master = master or os.environ.get("TESSERAE_MASTER")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; columns and filters are pruned at the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, in a local session else a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tesserae.scratch", None)
    if named is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = f"file://{folder}"
        spark.conf.set("spark.tesserae.scratch", named)
    return named.rstrip("/")


#: Paths that this process has handed out.
_made: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete what was written under scratch paths; for use once results were consumed."""
    while _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, where several plans need the same rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slim_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let Arrow batches of long texts hold fewer rows than Spark's default, unless the session sets its own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark
