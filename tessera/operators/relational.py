"""Relational building blocks: latest rows, top-k, pages, presence, good/bad splits, documents of children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import materialize


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def first_per_key(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str], k: int = 1) -> DataFrame:
    """The first k rows of each key in the given order, which must be total for a stable result.  Spark prunes with a
    window group limit before the shuffle, so a hot key sends k rows per task."""
    rn = F.row_number().over(W.partitionBy(*_cols(keys)).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def dealt(df: DataFrame, keys: str | Sequence[str], rows: int = 400_000) -> DataFrame:
    """``df`` dealt by its keys into parts of about so many rows.  What groups and windows by these keys and more then needs no further shuffle, and the memory of a task does not follow the
    input; left to itself, Spark joins parts that compress well into few large ones."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n, *_cols(keys))


def latest_per_key(df: DataFrame, keys: str | Sequence[str], at: str, tie: str) -> DataFrame:
    return first_per_key(df, keys, [F.desc_nulls_last(at), F.desc(tie)])


def canonicalize_first(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(first record of each key, keys whose records differ in ``fields``)."""
    conflicts = df.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*fields))).alias("n")).filter("n > 1").select(key)
    return first_per_key(df, key, list(order)), conflicts


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered result; limit is at least 1 and at most 500."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), 500))


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column holds the text, ignoring case.  % and _ act as wildcards."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return df.filter(cond)


def present(c: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all rules, rejected rows with the names of the broken rules)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    marked = df.withColumn("_broken", broken)
    return marked.filter(F.size("_broken") == 0).drop("_broken"), marked.filter(F.size("_broken") > 0).withColumnRenamed("_broken", "reasons")


def with_children(parent: DataFrame, child: DataFrame, on: str, fields: Sequence[str], name: str) -> DataFrame:
    """Parents with a sorted array of their children; children are gathered per parent only."""
    g = child.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parent.join(g, on, "left")


def union_aligned(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top_by_initial(df: DataFrame, title: str, tie: str, k: int) -> DataFrame:
    """The first k titles of each initial letter; # stands for a blank title."""
    t = F.trim(F.col(title))
    initial = F.when(F.coalesce(F.length(t), F.lit(0)) == 0, "#").otherwise(F.upper(F.substring(t, 1, 1)))
    return first_per_key(df.withColumn("initial", initial), "initial", [F.lower(title), tie], k)


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest of the content that does not depend on row order."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))), 256).alias("digest"))


def flatten_list_item(df: DataFrame, payload: str, base_url: str) -> tuple[DataFrame, DataFrame]:
    """(flat catalog rows, rejected payloads) of JSON list payloads.  Rejected: no JSON object, or slug or title missing, not a text or blank.  A relative image address is joined to ``base_url``."""
    j = df.select(payload, F.try_parse_json(payload).alias("_j"))
    text = lambda path: F.expr(f"try_variant_get(_j, '{path}', 'string')")
    url = text("$.image.url")
    whole = F.when(url.isNull() | (url == ""), None).when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(base_url.rstrip("/") + "/"), F.ltrim(url, F.lit("/"))))
    flat = j.select(payload, text("$.slug").alias("slug"), text("$.title").alias("title"), text("$.category").alias("category_name"), text("$.manufacturer").alias("manufacturer_name"),
                    F.lit(None).cast("string").alias("manufacturer_slug"), text("$.region").alias("region_name"), F.expr("try_variant_get(_j, '$.publicRating', 'double')").alias("public_rating"),
                    text("$.color").alias("color"), whole.alias("image_url"), text("$.image.altText").alias("image_alt"), F.col(payload).alias("raw_list_json"))
    ok = F.coalesce((F.trim("slug") != "") & (F.trim("title") != ""), F.lit(False))
    return flat.filter(ok).drop(payload), flat.filter(~ok).select(payload)


def numbered(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """``df`` with each row's place from 1 in ``order``, which should tell all rows apart, and no task that sees all rows.

    Rows are sorted by ranges and written with a number that grows inside each range; the counts of the ranges, one row a range, tell how many come before."""
    key = F.shiftright("_at", 33)
    at = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ranges = at.groupBy(key.alias("_range")).agg(F.count("*").alias("_n"))
    before = ranges.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return at.withColumn("_range", key).join(F.broadcast(before), "_range").select(*df.columns, place.alias(name))
