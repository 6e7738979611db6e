"""Session defaults and the shared scratch area used to cut long lineages."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library relies on: UTC, AQE, Arrow."""
    b = SparkSession.builder.appName("tessera")
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir;
    only where that is unset (tests on one machine) a default under the warehouse is taken; on a cluster that is an error, as its machines share no such folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return d.rstrip("/")


#: Spark drops the shuffle files of a query when it ends, so they do not pile up over the steps of a long job.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and what was
    computed survives the loss of any executor.  The table goes with ``discard``, at the latest with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    fs, folder = _file_system(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files of a job; they go with the application."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, folder = _file_system(spark, path)
    fs.deleteOnExit(folder)
    return path


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for t in tables:
        for path in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if re.search(r"-[0-9a-f]{32}$", path):
                fs, folder = _file_system(t.sparkSession, path)
                fs.delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
