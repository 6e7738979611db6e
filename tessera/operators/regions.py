"""Regions of images: joins by position, best pairs, duplicates, unions, suppression and consensus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as K
from tessera.functions import text as T
from tessera.operators.graph import connected_components


def suppress(boxes: DataFrame, most: float = 0.5, image: str = "image", box_id: str = "box_id") -> DataFrame:
    """Boxes (image, box_id, x, y, width, height, score) that no better box of their image overlaps by more than ``most``.  A group is one image."""
    others = [c for c in boxes.columns if c not in (image, box_id)]
    order = F.struct((-F.col("score")).alias("_s"), F.col(box_id), *[F.col(c) for c in others])
    kind = f"array<{boxes.select(order.alias('o')).schema['o'].dataType.simpleString()}>"
    kept = F.aggregate(F.sort_array(F.collect_list(order)), F.expr(f"cast(array() as {kind})"),
                       lambda acc, b: F.when(F.exists(acc, lambda k: K.iou(k, b) > most), acc).otherwise(F.concat(acc, F.array(b))))
    return boxes.groupBy(image).agg(kept.alias("_k")).select(image, F.explode("_k").alias("_b")).select(*[F.col(image) if c == image else F.col(f"_b.{c}") for c in boxes.columns])


def consensus(regions: DataFrame, least: float = 0.5, image: str = "image") -> DataFrame:
    """Groups of overlapping regions with equal text (image, text, x, y, width, height, score), greedily by score: each region joins the first group whose
    best region it overlaps by ``least``, or starts one; the score-weighted box, the number of regions and their mean score."""
    box = ("x", "y", "width", "height")
    order = F.struct((-F.col("score")).alias("_s"), *[F.col(c).cast("double").alias(c) for c in box], F.col("score").cast("double").alias("score"))
    group = "struct<x:double,y:double,width:double,height:double,n:bigint,s:double,w:double,sums:array<double>>"

    def weight(b: Column) -> Column:
        return F.greatest(b["score"], F.lit(1e-9))

    def start(b: Column) -> Column:
        return F.struct(*[b[c].alias(c) for c in box], F.lit(1).cast("bigint").alias("n"), b["score"].alias("s"), weight(b).alias("w"), F.array(*[b[c] * weight(b) for c in box]).alias("sums"))

    def join(g: Column, b: Column) -> Column:
        sums = F.array(*[g["sums"][i] + b[c] * weight(b) for i, c in enumerate(box)])
        return F.struct(*[g[c].alias(c) for c in box], (g["n"] + 1).alias("n"), (g["s"] + b["score"]).alias("s"), (g["w"] + weight(b)).alias("w"), sums.alias("sums"))

    def step(acc: Column, b: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: K.iou(g, b) >= least), True)
        return F.when(at == 0, F.concat(acc, F.array(start(b)))).otherwise(F.transform(acc, lambda g, i: F.when(i + 1 == at, join(g, b)).otherwise(g)))

    folded = F.aggregate(F.sort_array(F.collect_list(order)), F.expr(f"cast(array() as array<{group}>)"), step)
    g = regions.groupBy(image, "text").agg(folded.alias("_g")).select(image, "text", F.explode("_g").alias("_b"))
    return g.select(image, "text", *[(F.col("_b.sums")[i] / F.col("_b.w")).alias(c) for i, c in enumerate(box)], F.col("_b.n").alias("support"), (F.col("_b.s") / F.col("_b.n")).alias("score"))


def inside(outer: DataFrame, inner: DataFrame, image: str, outer_box: str, inner_box: str, least: float = 0.62) -> DataFrame:
    """Pairs of one image whose inner rectangle is covered to ``least`` or has its centre inside the outer one."""
    j = outer.join(inner, image)
    return j.filter((K.coverage(inner_box, outer_box) >= least) | K.centre_inside(inner_box, outer_box))


def best_pair(objects: DataFrame, scored: DataFrame, image: str, object_key: Sequence[str], label_key: Sequence[str]) -> DataFrame:
    """The object of each image with the best joint score: 0.62 of its own (object_score) and 0.38 of its best label's (label_score),
    or its own alone where no label lies on it."""
    keys = [image, *object_key]
    order = W.partitionBy(*keys).orderBy(F.desc("label_score"), *label_key)
    best = scored.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*keys, *label_key, "label_score")
    joint = F.when(F.col("label_score").isNull(), F.col("object_score")).otherwise(F.col("object_score") * 0.62 + F.col("label_score") * 0.38)
    top = W.partitionBy(image).orderBy(F.desc(F.round("joint", 9)), *object_key)
    return objects.join(best, keys, "left").withColumn("joint", joint).withColumn("_r", F.row_number().over(top)).filter("_r = 1").drop("_r")


def duplicate_regions(regions: DataFrame, image: str, key: Sequence[str], box: str, text: str, most: int = 5, **thresholds) -> DataFrame:
    """For each region up to ``most`` others of its image that may be the same, by rectangle and text: the other's key with _2, total, class.

    Both scores are the same from either side, so a pair is scored once and then turned; texts are compared only where the rectangles leave a class open."""
    side = lambda name: regions.select(image, F.struct(*key).alias(f"{name}k"), F.struct(*regions.columns).alias(name))
    differ = F.lit(False)
    for k in key:
        differ |= F.col(f"_ak.{k}") != F.col(f"_bk.{k}")
    a, b = F.col(f"_a.{text}"), F.col(f"_b.{text}")
    j = side("_a").join(side("_b"), image).filter((F.col("_ak") < F.col("_bk")) & differ).withColumn("_g", K.overlap_similarity(F.col(f"_a.{box}"), F.col(f"_b.{box}")))
    j = j.filter(F.col("_g") >= K.least_overlap(**thresholds))
    # a row of a list of one: filters on what follows stay behind it, so the texts are compared once a pair
    j = j.select("_a", "_b", "_g", F.explode(F.array(F.when((F.length(a) > 0) & (F.length(b) > 0), T.edit_similarity(a, b)))).alias("_s"))
    total, kind = K.duplicate_class("_g", "_s", **thresholds)
    j = j.withColumn("total", total).withColumn("class", kind).filter("class <> 'unlikely'")
    j = j.select("total", "class", F.explode(F.array(F.struct("_a", "_b"), F.struct(F.col("_b").alias("_a"), F.col("_a").alias("_b")))).alias("_p"))
    j = j.select(*[F.col(f"_p._a.{c}").alias(c) for c in regions.columns], *[F.col(f"_p._b.{k}").alias(f"{k}_2") for k in key], "total", "class")
    order = W.partitionBy(image, *key).orderBy(F.desc(F.round("total", 9)), *[f"{k}_2" for k in key])
    return j.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def reviewable(regions: DataFrame, crop: str, key: str, text: str, confidence: str, validity: str, support: str, consensus: str, semantic: Column,
               order: Sequence[str], limit: int = 24) -> DataFrame:
    """The ``limit`` best regions of a crop that a reviewer should see, with their quality and place in reading order."""
    c, v, s, a = (F.col(x) for x in (confidence, validity, support, consensus))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    admitted = ((c >= 0.7) & (v >= 0.5)) | ((c >= 0.35) & (s >= 2) & (a >= 0.58) & (v >= 0.5)) | ((c >= 0.4) & semantic & (v >= 0.55))
    q = regions.filter((letters >= 2) & admitted).withColumn("quality", c * 0.45 + v * 0.25 + a * 0.2 + F.least(F.lit(1.0), s / 3) * 0.1)
    best = W.partitionBy(crop).orderBy(F.desc(F.round("quality", 9)), key)
    q = q.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit).drop("_r")
    return q.withColumn("place", F.row_number().over(W.partitionBy(crop).orderBy(*order)))


#: Images of more boxes find their unions by the distributed rounds, all others in the task that holds them.
_TOGETHER = 256


def merge_fragments(boxes: DataFrame, image: str, n: str, group: str, contained: float = 0.82) -> DataFrame:
    """Boxes (image, n: number in the image, group, x, y, width, height) united where they overlap without one holding ``contained`` of
    the smaller, or where they share a group: one row per union with its first number, members, bounds and mode."""
    b = boxes.withColumn("_v", F.col(n)).withColumn("_r", F.struct("x", "y", "width", "height"))
    o = b.select(image, F.col("_v").alias("_w"), F.col("_r").alias("_q"))
    shared = K.intersection("_r", "_q")
    part = shared / F.greatest(F.lit(1.0), F.least(K.area("_r"), K.area("_q")))

    def edges(b: DataFrame, o: DataFrame) -> DataFrame:
        auto = b.join(o, image).filter((F.col("_v") < F.col("_w")) & (shared > 0) & (part < contained)).select(image, "_v", "_w", F.lit(False).alias("manual"))
        first = b.filter(F.col(group).isNotNull()).groupBy(image, group).agg(F.min("_v").alias("_w"))
        return auto.union(b.join(first, [image, group]).filter("_v <> _w").select(image, "_w", "_v", F.lit(True)).toDF(image, "_v", "_w", "manual"))

    large = boxes.groupBy(image).agg(F.count("*").alias("_n")).filter(F.col("_n") > _TOGETHER).select(image)
    if large.isEmpty():
        comp = _unions(edges(b, o), image)
    else:
        few, many = ([x.join(large, image, how) for x in (b, o)] for how in ("left_anti", "left_semi"))
        e = edges(*many)
        node = lambda c: F.struct(F.col(image).alias("image"), F.col(c).alias("n"))
        found = connected_components(e.select(node("_v").alias("u"), node("_w").alias("v"))).select(F.col("node.image").alias(image), F.col("node.n").alias("_v"), F.col("component.n").alias("_c"))
        why = e.join(found, [image, "_v"]).groupBy(image, "_c").agg(F.bool_or("manual").alias("man"), F.bool_or(~F.col("manual")).alias("aut"))
        comp = _unions(edges(*few), image).union(found.join(why, [image, "_c"]).select(image, "_v", "_c", "man", "aut"))
    out = b.join(comp, [image, "_v"], "left").withColumn("_c", F.coalesce("_c", "_v")).groupBy(image, "_c").agg(
        F.min(n).alias("first"), F.count("*").alias("members"), F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"), F.max("man").alias("man"), F.max("aut").alias("aut"))
    mode = F.when(F.col("man") & F.col("aut"), "mixed").when(F.col("man"), "manual").when(F.col("aut"), "automatic").otherwise("none")
    return out.withColumn("mode", mode).drop("_c", "man", "aut")


def _unions(edges: DataFrame, image: str) -> DataFrame:
    """(image, _v, _c, man, aut): the least number that each box's edges (image, _v, _w, manual) reach in its image, and whether its union holds manual and automatic ones.
    The images of a batch are solved together: least numbers run along the edges until nothing changes."""
    per = edges.groupBy(image).agg(F.collect_list(F.struct(F.col("_v").cast("long").alias("v"), F.col("_w").cast("long").alias("w"), "manual")).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
            at = np.repeat(np.arange(len(sizes)), sizes)
            column = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
            manual = column("manual").astype(bool)
            ends = np.stack([np.concatenate([at, at]), np.concatenate([column("v"), column("w")])])
            nodes, place = np.unique(ends, axis=1, return_inverse=True)
            u, v = place.reshape(2, -1)
            least = np.arange(nodes.shape[1])  # nodes are sorted, so the least place is the least number of an image
            while True:
                low = np.minimum(least[u], least[v])
                new = least.copy()
                np.minimum.at(new, u, low)
                np.minimum.at(new, v, low)
                new = new[new]
                if (new == least).all():
                    break
                least = new
            man, aut = np.zeros(len(least), bool), np.zeros(len(least), bool)
            man[least[u[manual]]] = True
            aut[least[u[~manual]]] = True
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(nodes[0])), pa.array(nodes[1]), pa.array(nodes[1][least]), pa.array(man[least]), pa.array(aut[least])], [image, "_v", "_c", "man", "aut"])

    return per.mapInArrow(run, f"`{image}` {dict(per.dtypes)[image]}, _v long, _c long, man boolean, aut boolean")
