"""JSON payloads of products: fields under several names, characteristics, bridge rows with their dimension, guards of reviewed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import numbered

#: Keys of a product payload.  CHARACTERISTICS: the first that holds an object or a list is taken; else all keys but OWN.
CHARACTERISTICS = ("characteristics", "properties", "attrs", "params")
OWN = ("id", "title", "name", "total_rating", "rating", "description", "product_link", "link", "url", "category_name", "manufacturer")


def _at(json: Column, key: str) -> Column:
    return F.try_variant_get(json, f"$.{key}", "variant")


def _shape(json: Column) -> Column:
    """OBJECT, ARRAY, VOID (a JSON null) or the scalar's type; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(json), "^[A-Z]+", 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_present(json: Column, *keys: str) -> Column:
    """The value of the first key that is there and neither null nor an empty text."""
    def one(key: str) -> Column:
        return _let(_at(json, key), lambda v: F.when((_shape(v) != "VOID") & ~((_shape(v) == "STRING") & (F.try_variant_get(v, "$", "string") == "")), v))
    return F.coalesce(*map(one, keys))


def text_of(json: Column, depth: int = 3) -> Column:
    """A value's text without white space around it, null if blank.  An object gives its title or name (``depth`` objects deep), a list nothing."""
    def one(v: Column) -> Column:
        scalar = F.regexp_replace(F.try_variant_get(v, "$", "string"), r"^\s+|\s+$", "")
        inner = text_of(first_present(v, "title", "name"), depth - 1) if depth else F.lit(None).cast("string")
        return F.when(_shape(v) == "OBJECT", inner).when(_shape(v) == "ARRAY", None).otherwise(F.nullif(scalar, F.lit("")))
    return _let(json, one)


def product_fields(df: DataFrame, payload: str) -> DataFrame:
    """``df`` with the fields of a product payload (JSON text) beside it: title, total_rating, description, product_link, category_name, manufacturer,
    characteristics (map of key to text; null where a list holds them) and characteristics_list (that list as JSON).  A payload that is no JSON object has null fields."""
    df = df.withColumn("_j", _let(F.try_parse_json(payload), lambda j: F.when(_shape(j) == "OBJECT", j)))
    c = F.col("_j")
    given = F.coalesce(*(_let(_at(c, k), lambda v: F.when(_shape(v).isin("OBJECT", "ARRAY"), v)) for k in CHARACTERISTICS))
    whole = F.try_variant_get(c, "$", "map<string,string>")
    df = df.withColumn("_given", given)
    shape = _shape(F.col("_given"))
    return df.select(
        *(x for x in df.columns if not x.startswith("_")),
        text_of(first_present(c, "title", "name")).alias("title"),
        F.try_variant_get(first_present(c, "total_rating", "rating"), "$", "double").alias("total_rating"),
        text_of(_at(c, "description")).alias("description"), text_of(first_present(c, "product_link", "link", "url")).alias("product_link"),
        text_of(_at(c, "category_name")).alias("category_name"), text_of(_at(c, "manufacturer")).alias("manufacturer"),
        F.when(shape == "OBJECT", F.try_variant_get("_given", "$", "map<string,string>")).when(shape.isNull(), F.map_filter(whole, lambda k, _: ~k.isin(*OWN))).alias("characteristics"),
        F.when(shape == "ARRAY", F.to_json("_given")).alias("characteristics_list"))


def bridge_rows(items: DataFrame, key: str, names: Column, dimension: DataFrame, id: str = "id", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(bridge rows key, id; dimension afterwards) of the lists ``names``.

    Names lose the spaces around them, blank ones and repeats inside an item go.  A name of the dimension keeps its id; new names are numbered on from the greatest id, in order of
    the names, by ranges.  Items of one hot name are spread by the join's skew handling; the dimension holds each name once."""
    pairs = items.select(key, F.explode(names).alias(name)).withColumn(name, F.trim(name)).filter(F.col(name) != "").distinct()
    dimension = dimension.select(id, name)
    new = numbered(pairs.select(name).distinct().join(dimension, name, "left_anti"), [name], "_n")
    top = dimension.agg(F.coalesce(F.max(id), F.lit(0)).cast("long")).scalar()
    after = dimension.withColumn(id, F.col(id).cast("long")).union(new.select((F.col("_n") + top).alias(id), name))
    return pairs.join(after, name).select(key, id), after


def still_equal(row: Column, expected: Column) -> Column:
    """Whether a row (JSON object text) still holds every value that ``expected`` (JSON object text) names, nested values whole.

    A number is no text, a null equals a null, a key that the row lacks equals nothing.  An empty object is held by every row; what is no JSON object holds, and is held by, nothing."""
    def parts(c: Column) -> Column:
        return _let(F.try_parse_json(c), lambda j: F.when(_shape(j) == "OBJECT", F.transform_values(F.try_variant_get(j, "$", "map<string,variant>"), lambda _, v: F.to_json(v))))
    have, want = parts(row), parts(expected)
    held = F.forall(F.map_entries(want), lambda e: F.coalesce(F.try_element_at(have, e["key"]) == e["value"], F.lit(False)))
    return F.coalesce(have.isNotNull() & held, F.lit(False))
