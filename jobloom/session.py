"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "jobloom", **conf: str) -> SparkSession:
    """A session with the settings all operators assume: UTC, AQE on, ANSI on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A local one is made only where the setting is absent (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = getattr(spark.sparkContext, "_jobloom_dir", None)
    if known is None:
        known = "file://" + tempfile.mkdtemp(prefix="jobloom-")
        spark.sparkContext._jobloom_dir = known
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/jobloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """The path of a file: URI."""
    return uri[len("file://"):] if uri.startswith("file://") else uri


def exists(spark: SparkSession, uri: str) -> bool:
    """Whether a folder exists on the file system of its URI."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def bench_cpus() -> str:
    return os.environ.get("BENCH_CPUS", "8")
