"""Writers of reports and frozen datasets, and the consumer that checks a dataset before it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; nested cells as JSON text."""
    nested = (ArrayType, MapType, StructType)
    cells = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*cells).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


#: Microseconds survive.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").options(**TIMES).json(path)


def content_digest(df: DataFrame) -> list[Column]:
    """Row count and a digest of the rows' JSON that does not hang on their order."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return [F.count("*").alias("n"), F.sum(F.xxhash64(line).cast("decimal(38,0)")).cast("string").alias("digest")]


def export_dataset(records: DataFrame, path: str, task: str = "task", split: str = "split") -> DataFrame:
    """Freeze records as JSON lines by task and split, with a manifest of counts and digests; returns the manifest."""
    records.write.partitionBy(task, split).option("ignoreNullFields", "false").json(f"{path}/records")
    manifest = records.groupBy(task, split).agg(*content_digest(records.drop(task, split)))
    manifest.coalesce(1).write.json(f"{path}/manifest")  # one row per task and split
    return records.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def consume_dataset(spark: SparkSession, path: str, schema: str, task: str = "task", split: str = "split") -> DataFrame:
    """(task, split, n, expected, ready): the frozen records read again and held against their manifest."""
    records = spark.read.schema(f"{schema}, {task} string, {split} string").json(f"{path}/records")
    found = records.groupBy(task, split).agg(*content_digest(records.drop(task, split)))
    manifest = spark.read.schema(f"{task} string, {split} string, n long, digest string").json(f"{path}/manifest")
    m = manifest.withColumnRenamed("n", "expected").withColumnRenamed("digest", "_d")
    j = m.join(found, [task, split], "full")
    ready = (F.col("n") == F.col("expected")) & (F.col("digest") == F.col("_d"))
    return j.select(task, split, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce(ready, F.lit(False)).alias("ready"))


def task_records(items: DataFrame, item: str, children: str, tasks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(task, item, child, value): the records that each task takes from an item's children (an array of structs with id): a task is
    (condition, value) over ``child``."""
    c = items.select(item, F.explode(children).alias("child"))
    made = F.array(*[F.when(cond, F.struct(F.lit(t).alias("task"), value.cast("string").alias("value"))) for t, (cond, value) in tasks.items()])
    return c.select(item, F.col("child.id").alias("child"), F.explode(F.array_compact(made)).alias("r")).select("r.task", item, "child", "r.value")
