"""Readers of catalogs, token lists and media folders, and the checks that come with them.  A failed check raises when the rows are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as T


def _must(condition: Column, message: str) -> Column:
    """True, or an error where the condition fails."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def read_catalog_csv(spark: SparkSession, path: str, columns: dict[str, str], delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A catalog file with exactly the header columns of ``columns`` (header -> name), all as strings: the mapped columns, ``raw``
    (the row as JSON), ``row_sha256`` and ``file_name``.  Malformed rows and other headers raise; blank cells are null."""
    options = {"header": True, "multiLine": True, "sep": delimiter, "encoding": encoding, "mode": "FAILFAST", "quote": '"', "escape": '"'}
    found = spark.read.options(**options).csv(path).columns
    if sorted(found) != sorted(columns):
        raise ValueError(f"expected the columns {sorted(columns)}, found {sorted(found)}")
    schema = StructType()
    for c in found:
        schema = schema.add(c, "string")
    rows = spark.read.options(**options).schema(schema).csv(path)
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(found)]), {"ignoreNullFields": "false"})
    named = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(n) for c, n in columns.items()]
    return rows.select(*named, raw.alias("raw"), F.sha2(raw, 256).alias("row_sha256"), F.col("_metadata.file_name").alias("file_name"))


def read_tokens(spark: SparkSession, path: str, key: str = "slug", tokens: str = "tokens") -> DataFrame:
    """JSON lines {key, tokens: [...]}; a key that two rows have raises."""
    t = spark.read.schema(f"{key} string, {tokens} array<string>").json(path)
    g = t.groupBy(key).agg(F.count("*").alias("_n"), F.first(tokens).alias(tokens))
    return g.filter(_must(F.col("_n") == 1, "a key occurs twice")).drop("_n")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines of a known schema; a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def file_inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, extension, size, sha256) of all files below a folder, read by executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = T.basename("path")
    return f.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_embeddings(spark: SparkSession, vectors: str, rows: str, dim: int, key: str = "row_id", vec: str = "embedding") -> DataFrame:
    """Stored vectors joined to their row mapping; a vector of another length, or a row on one side only, raises."""
    v, r = spark.read.parquet(vectors), spark.read.parquet(rows)
    j = v.withColumn("_v", F.lit(True)).join(r.withColumn("_r", F.lit(True)), key, "full")
    ok = F.col("_v").isNotNull() & F.col("_r").isNotNull() & (F.size(vec) == dim)
    return j.filter(_must(F.coalesce(ok, F.lit(False)), "vectors and rows do not fit")).drop("_v", "_r")


def detail_row(payload: Column) -> list[Column]:
    """Columns of a detail payload (JSON text): id, name, and the names of its category, maker and region, blank ones null."""
    get = lambda path: F.nullif(F.trim(F.get_json_object(payload, path)), F.lit(""))
    return [get("$.id").cast("long").alias("id"), get("$.name").alias("name"), get("$.category.name").alias("category"), get("$.maker.name").alias("maker"), get("$.region.name").alias("region")]


def image_assets(items: DataFrame, item: str, list_payload: str, detail_payload: str, base: str) -> DataFrame:
    """(item, kind, url): the picture of the list payload, else the detail one's, as an absolute address; one row per item, kind and url."""
    def absolute(c: Column) -> Column:
        c = F.nullif(F.trim(c), F.lit(""))
        return F.when(c.rlike("^https?://"), c).when(c.isNotNull(), F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(c, "^/+", "")))
    main = F.coalesce(absolute(F.get_json_object(list_payload, "$.image")), absolute(F.get_json_object(detail_payload, "$.image.url")))
    extra = absolute(F.get_json_object(detail_payload, "$.thumb.url"))
    rows = F.array_compact(F.array(F.when(main.isNotNull(), F.struct(F.lit("main").alias("kind"), main.alias("url"))), F.when(extra.isNotNull(), F.struct(F.lit("thumb").alias("kind"), extra.alias("url")))))
    return items.select(item, F.explode(rows).alias("r")).select(item, "r.kind", "r.url").dropDuplicates([item, "kind", "url"])
