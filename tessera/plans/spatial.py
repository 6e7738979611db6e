"""Joins and scores of rectangles and quadrilaterals inside images, duplicate regions and near-duplicate hashes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as K
from tessera.functions import text as T
from tessera.operators import regions as R
from tessera.operators import vectors as V
from tessera.plans.registry import query
from tessera.plans.textual import _BOXES, _boxes
from tessera.session import table

# Orders are images; lines of odd number are objects, stretched to four times their height, lines of even number are labels.
_OBJECTS = _BOXES + """, o as (select image, box_id, l_partkey as part, x, y, w, h * 4 as h, least(score, 1) as score from b where box_id % 2 = 1),
    l as (select image, box_id, l_partkey as part, x, y + 10 as y, w * .5 as w, h as h, least(score, 1) as score from b where box_id % 2 = 0),
    pair as (select o.image, o.box_id as ob, o.part as op, l.box_id as lb, l.part as lp, o.x as ox, o.y as oy, o.w as ow, o.h as oh, o.score as os, l.x as lx, l.y as ly, l.w as lw, l.h as lh, l.score as ls,
      greatest(least(o.x + o.w, l.x + l.w) - greatest(o.x, l.x), 0) * greatest(least(o.y + o.h, l.y + l.h) - greatest(o.y, l.y), 0) / (l.w * l.h) as cover from o join l using (image)),
    inside as (select * from pair where cover >= .62 or (lx + lw / 2 between ox and ox + ow and ly + lh / 2 between oy and oy + oh)) """
_BAND = "case when {v} <= {a} or {v} >= {d} then 0 when {v} < {b} then ({v} - {a}) / ({b} - {a}) when {v} > {c} then ({d} - {v}) / ({d} - {c}) else 1 end"


def _band(v, a, b, c, d):
    return _BAND.format(v=v, a=a, b=b, c=c, d=d)


_SCORED = _OBJECTS + f""", big as (select *, max(lw * lh) over (partition by image, ob, op) as most from inside),
    s as (select *, least(1, greatest(0, least(1, greatest(0, .25 * least(1, greatest(0, 1 - abs(lx + lw / 2 - (ox + ow / 2)) / greatest(1, ow / 2)))
      + .16 * ({_band('lw / greatest(1, ow)', .12, .25, .92, 1.06)}) + .17 * ({_band('(ly + lh / 2 - oy) / greatest(1, oh)', .18, .34, .88, .98)})
      + .1 * least(1, greatest(0, 1 - abs(ln(greatest(.05, lw / greatest(1, lh)) / 1.15)) / 2.4)) + .13 * least(1, greatest(0, 1 - greatest(0, lh / greatest(1, oh) - .38) / .3))
      + .1 * sqrt(least(1, greatest(0, lw * lh / greatest(1, most)))) + .09 * cover)) * .85 + ls * .15)) as label_score from big),
    i as (select image, box_id as ob, part as op, least(1, greatest(0, .45 * least(1, greatest(0, 1 - sqrt(pow(((x + w / 2) / 100 - .5) / .5, 2) + pow(((y + h / 2) / 160 - .52) / .52, 2)) / sqrt(2)))
      + .28 * least(1, greatest(0, sqrt(w * h / 16000))) + .17 * score + .1 * ({_band('w / greatest(1, h)', .07, .14, .72, 1.25)}))) as object_score from o) """


def _pairs(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    c = F.col
    score = F.least("score", F.lit(1.0))
    objects = b.filter("box_id % 2 = 1").select("image", c("box_id").alias("ob"), c("l_partkey").alias("op"), rect(c("x"), c("y"), c("width"), c("height") * 4).alias("o"), score.alias("os"))
    labels = b.filter("box_id % 2 = 0").select("image", c("box_id").alias("lb"), c("l_partkey").alias("lp"), rect(c("x"), c("y") + 10, c("width") * 0.5, c("height")).alias("l"), score.alias("ls"))
    return objects, labels


def _scored(spark, sf_dir):
    objects, labels = _pairs(spark, sf_dir)
    inside = R.inside(objects, labels, "image", "o", "l")
    big = inside.withColumn("most", F.max(K.area("l")).over(W.partitionBy("image", "ob", "op")))
    return objects, big.withColumn("label_score", K.label_intent("l", "o", "ls", "most"))


@query(_OBJECTS + "select image, ob, op, lb, lp, round(cover, 6) as cover from inside")
def c22_label_in_object(spark, sf_dir):
    objects, labels = _pairs(spark, sf_dir)
    return R.inside(objects, labels, "image", "o", "l").select("image", "ob", "op", "lb", "lp", F.round(K.coverage("l", "o"), 6).alias("cover"))


@query(_SCORED + "select image, ob, op, lb, lp, round(label_score, 6) as label_score from s")
def k4_label_score(spark, sf_dir):
    return _scored(spark, sf_dir)[1].select("image", "ob", "op", "lb", "lp", F.round("label_score", 6).alias("label_score"))


@query(_SCORED + """, best as (select image, ob, op, lb, lp, label_score from s qualify row_number() over (partition by image, ob, op order by label_score desc, lb, lp) = 1),
    j as (select i.image, i.ob, i.op, lb, lp, case when lb is null then object_score else object_score * .62 + label_score * .38 end as joint from i left join best b on (i.image, i.ob, i.op) = (b.image, b.ob, b.op))
    select image, ob, op, lb, lp, round(joint, 5) as joint, case when lb is null then 'fallback-original' else 'override' end as action from j qualify row_number() over (partition by image order by round(joint, 9) desc, ob, op) = 1""")
def k5_best_pair(spark, sf_dir):
    objects, scored = _scored(spark, sf_dir)
    objects = objects.withColumn("object_score", K.object_intent("o", "os", 100.0, 160.0))
    return R.best_pair(objects, scored, "image", ("ob", "op"), ("lb", "lp")).select(
        "image", "ob", "op", "lb", "lp", F.round("joint", 5).alias("joint"), F.when(F.col("lb").isNull(), "fallback-original").otherwise("override").alias("action"))


_POINTS = """with p as (select l_orderkey, l_linenumber, l_partkey, [{'x': l_partkey % 40 + l_quantity + 5, 'y': (l_suppkey % 30)::double}, {'x': (l_partkey % 40 + l_quantity + 5) - l_discount * 100, 'y': l_suppkey % 30 + l_quantity / 2 + 8},
    {'x': (l_partkey % 40)::double, 'y': l_suppkey % 30 + l_tax * 20}, {'x': l_partkey % 40 + l_discount * 50, 'y': l_suppkey % 30 + l_quantity / 2 + 8 - l_tax * 10}] as q from lineitem),
    c as (select *, list_sum([a.x / 4 for a in q]) as cx, list_sum([a.y / 4 for a in q]) as cy from p),
    s as (select *, [{'x': a.x, 'y': a.y} for a in list_sort([{'a': round(atan2(a.y - cy, a.x - cx), 9), 'x': a.x, 'y': a.y} for a in q])] as o from c),
    f as (select *, list_position([round(a.x + a.y, 9) for a in o], list_min([round(a.x + a.y, 9) for a in o])) - 1 as k from s),
    r as (select *, [o[((k + i) % 4) + 1] for i in [0, 1, 2, 3]] as z from f),
    t as (select *, [(z[((i + 1) % 4) + 1].x - z[i + 1].x) * (z[((i + 2) % 4) + 1].y - z[((i + 1) % 4) + 1].y) - (z[((i + 1) % 4) + 1].y - z[i + 1].y) * (z[((i + 2) % 4) + 1].x - z[((i + 1) % 4) + 1].x) for i in [0, 1, 2, 3]] as turns from r) """


@query(_POINTS + """select l_orderkey, l_linenumber, l_partkey, round(z[1].x, 6) + 0.0::double as x1, round(z[1].y, 6) + 0.0::double as y1, round(z[3].x, 6) + 0.0::double as x3, round(z[3].y, 6) + 0.0::double as y3, list_min(turns) > 1e-8 or list_max(turns) < -1e-8 as convex,
    round(list_min([a.x for a in z]), 6) + 0.0::double as bx, round(list_max([a.y for a in z]) - list_min([a.y for a in z]), 6) as bh from t""")
def k7_quads(spark, sf_dir):
    x, y, q = F.col("l_partkey") % 40, F.col("l_suppkey") % 30, F.col("l_quantity")
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    points = F.array(point(x + q + 5, y), point((x + q + 5) - F.col("l_discount") * 100, y + q / 2 + 8), point(x, y + F.col("l_tax") * 20),
                     point(x + F.col("l_discount") * 50, y + q / 2 + 8 - F.col("l_tax") * 10))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", K.canonical_quad(points).alias("z"))
    b = K.quad_bounds("z")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("z")[0]["x"], 6).alias("x1"), F.round(F.col("z")[0]["y"], 6).alias("y1"), F.round(F.col("z")[2]["x"], 6).alias("x3"),
                    F.round(F.col("z")[2]["y"], 6).alias("y3"), K.quad_is_convex("z").alias("convex"), F.round(b["x"], 6).alias("bx"), F.round(b["height"], 6).alias("bh"))


@query("""select l_orderkey, l_linenumber, l_partkey, round(((least(l_quantity / 30, 1) + l_discount * 5 + l_tax * 5 + least(l_discount / .25, 1) + least(l_tax / .5, 1)) / 5
    + (least(l_linenumber / 30.0, 1) + l_tax * 5 + l_discount * 5 + least(l_tax / .25, 1) + least(l_discount / .5, 1)) / 5) / 2, 6) as geometry from lineitem""")
def k8_geometry_evidence(spark, sf_dir):
    c = F.col
    a = K.matched_geometry("l_quantity", c("l_discount") * 5, c("l_tax") * 5, "l_discount", "l_tax")
    b = K.matched_geometry("l_linenumber", c("l_tax") * 5, c("l_discount") * 5, "l_tax", "l_discount")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round((a + b) / 2, 6).alias("geometry"))


# ---- duplicate regions: lines of one order with the names of their parts as texts

_REGIONS = _BOXES + """, r as (select image, box_id, l_partkey as part, x, y, w, h, regexp_replace(replace(p_name, '0', 'o'), '[1l]', 'i', 'g') as t from b join part on p_partkey = l_partkey),
    m as (select a.image, a.box_id as a, a.part as pa, b.box_id as b, b.part as pb, a.t as ta, b.t as tb, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) as i,
      greatest(1, a.w * a.h) as aa, greatest(1, b.w * b.h) as ab from r a join r b on a.image = b.image and (a.box_id, a.part) <> (b.box_id, b.part)),
    g as (select *, greatest(i / greatest(1, aa + ab - i), i / greatest(1, least(aa, ab)) * .92) as geo, case when ta = tb then 1 else 1 - levenshtein(ta, tb) / greatest(length(ta), length(tb))::double end as txt from m),
    d as (select *, geo * .55 + txt * .45 as total from g),
    k as (select *, case when geo >= .3 and total >= .8 then 'probable_duplicate' when geo >= .3 and total >= .5 then 'possible_duplicate' when geo >= .45 then 'overlapping' else 'unlikely' end as class from d) """


def _matches(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace(F.replace("p_name", F.lit("0"), F.lit("o")), "[1l]", "i").alias("t"))
    r = _boxes(spark, sf_dir).join(names, "l_partkey").select("image", "box_id", F.col("l_partkey").alias("part"), F.struct("x", "y", "width", "height").alias("r"), "t")
    return R.duplicate_regions(r, "image", ("box_id", "part"), "r", "t")


@query(_REGIONS + "select image, a, pa, b, pb, round(total, 4) as total, class from k where class <> 'unlikely' qualify row_number() over (partition by image, a, pa order by round(total, 9) desc, b, pb) <= 5")
def c23_duplicate_regions(spark, sf_dir):
    return _matches(spark, sf_dir).select("image", F.col("box_id").alias("a"), F.col("part").alias("pa"), F.col("box_id_2").alias("b"), F.col("part_2").alias("pb"), F.round("total", 4).alias("total"), "class")


@query(_REGIONS + "select class, count(*) as n from (select * from k where class <> 'unlikely' qualify row_number() over (partition by image, a, pa order by round(total, 9) desc, b, pb) <= 5) group by 1")
def k10_duplicate_classes(spark, sf_dir):
    return _matches(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


_VALID = r"""with v as (select p_partkey, p_name as t, p_size * 2.5 - 10 as conf, p_retailprice / 100 as w, p_size / 5.0 as h, p_partkey % 2 = 0 as line from part),
    c as (select *, length(regexp_replace(t, '\s', '', 'g')) as chars, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) as n, len(list_distinct(list_filter(string_split(lower(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')), ''), lambda z: z <> ''))) as ds,
      least(1, greatest(0, conf / 100)) as cf, w / greatest(.0001, h) between .12 and 35 and h >= .006 as ok, regexp_matches(t, '^(19|20)[0-9]{2}$|^[0-9]{2,4}$|^([xX][oO]|[vV][sS])$') as short from v),
    s as (select *, round(cf * .4 + least(1, n / case when line then 10.0 else 5.0 end) * .18 + case when n > 0 then ds / n::double else 0 end * .14 + case when chars > 0 then n / chars::double else 0 end * .16 + ok::int * .12, 4) as score,
      list_filter([case when n = 0 then 'NO_ALPHANUMERIC_CONTENT' end, case when n <= 2 and cf < .45 and not short then 'LOW_CONFIDENCE_SHORT_TEXT' end, case when chars = 0 or n / chars::double < .5 then 'LOW_ALPHANUMERIC_RATIO' end, case when not ok then 'IMPLAUSIBLE_BBOX_GEOMETRY' end], lambda z: z is not null) as why from c),
    f as (select *, short or (len(why) = 0 and score >= .38) as valid from s) """


def _observations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t"), (F.col("p_size") * 2.5 - 10).cast("double").alias("conf"), (F.col("p_retailprice") / 100).alias("w"),
                                            (F.col("p_size") / 5).alias("h"), (F.col("p_partkey") % 2 == 0).alias("line"), "p_brand", "p_size", "p_type")
    score, valid, why = T.observation_validity("t", "conf", "w", "h", F.col("line"))
    return p.withColumn("score", score).withColumn("valid", valid).withColumn("why", why)


@query(_VALID + "select p_partkey, score, valid, array_to_string(case when valid then [] when len(why) > 0 then why else ['LOW_VALIDITY_SCORE'] end, ',') as reasons from f")
def k13_validity(spark, sf_dir):
    return _observations(spark, sf_dir).select("p_partkey", "score", "valid", F.array_join("why", ",").alias("reasons"))


@query(_VALID + """, r as (select p.p_brand as crop, f.p_partkey, f.t, f.cf, f.n, f.score as validity, p.p_size % 4 as support, (p.p_size % 10) / 10.0 as consensus, length(p.p_type) % 3 > 0 as semantic, p.p_size as y, f.p_partkey as x
      from f join part p using (p_partkey) where f.line),
    k as (select *, cf * .45 + validity * .25 + consensus * .2 + least(1, support / 3.0) * .1 as quality from r
      where n >= 2 and ((cf >= .7 and validity >= .5) or (cf >= .35 and support >= 2 and consensus >= .58 and validity >= .5) or (cf >= .4 and semantic and validity >= .55))),
    t as (select * from k qualify row_number() over (partition by crop order by round(quality, 9) desc, p_partkey) <= 24)
    select crop, p_partkey, round(quality, 6) as quality, row_number() over (partition by crop order by y, x) as place from t""")
def f11_reviewable_regions(spark, sf_dir):
    r = _observations(spark, sf_dir).filter("line").withColumn("cf", K.clamp(F.col("conf") / 100)).withColumn("support", F.col("p_size") % 4).withColumn("consensus", (F.col("p_size") % 10) / 10)
    return R.reviewable(r, "p_brand", "p_partkey", text="t", confidence="cf", validity="score", support="support", consensus="consensus", semantic=F.length("p_type") % 3 > 0, order=("p_size", "p_partkey")).select(
        F.col("p_brand").alias("crop"), "p_partkey", F.round("quality", 6).alias("quality"), "place")


@query(_BOXES + """, o as (select *, row_number() over (partition by image order by box_id, l_partkey, x, y, w, h) as n from (select *, case when l_partkey % 5 = 0 then l_partkey % 3 end as grp from b)),
    e as (select a.image, a.n as a, b.n as b, a.grp is not null and a.grp = b.grp as manual, i > 0 and i / greatest(1, least(a.w * a.h, b.w * b.h)) < .82 as auto from (select * from o) a join o b on a.image = b.image and a.n <> b.n,
      lateral (select greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) as i)),
    links as (select * from e where manual or auto), reach as (with recursive r(image, a, b) as (select image, n, n from o union select r.image, r.a, l.b from r join links l on l.image = r.image and l.a = r.b) select * from r),
    c as (select image, a as n, min(b) as c from reach group by 1, 2), f as (select c.image, c.c, bool_or(l.manual) as man, bool_or(l.auto) as aut from c join links l on l.image = c.image and l.a = c.n group by 1, 2)
    select o.image, c.c as first, count(*) as members, round(min(x), 4) as x, round(max(x + w) - min(x), 4) as width, round(max(y + h) - min(y), 4) as height, case when max(man) and max(aut) then 'mixed' when max(man) then 'manual' when max(aut) then 'automatic' else 'none' end as mode
    from o join c on c.image = o.image and c.n = o.n left join f on f.image = o.image and f.c = c.c group by 1, 2""")
def d43_merged_boxes(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("grp", F.when(F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 3))
    b = b.withColumn("n", F.row_number().over(W.partitionBy("image").orderBy("box_id", "l_partkey", "x", "y", "width", "height")).cast("long"))
    return R.merge_fragments(b, "image", "n", "grp").select(
        "image", "first", "members", F.round("x", 4).alias("x"), F.round("width", 4).alias("width"), F.round("height", 4).alias("height"), "mode")


# ---- near-duplicate pictures: the signs of a vector's components are its 64-bit hash

@query("""with h as (select vec_id, embedding::double[] as e, list_sum([case when embedding[i + 1] > 0 then 1::hugeint << i else 0::hugeint end for i in range(64)]) as h from embeddings where embedding is not null),
    r as (select h, min(vec_id) as k from h group by 1), v as (select r.k, r.h, h.e from r join h on h.vec_id = r.k)
    select a.k as a, b.k as b, round(list_cosine_similarity(a.e, b.e), 5) as cosine from v a join v b on a.k < b.k and bit_count(xor(a.h::ubigint::bit, b.h::ubigint::bit)) <= 6 where list_cosine_similarity(a.e, b.e) >= .5""")
def c20_near_hashes(spark, sf_dir):
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: F.when(F.get("embedding", i) > 0, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(a))
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", F.col("embedding").alias("e"), bits.alias("h"))
    near = V.phash_near(e, "vec_id", "h", 6)
    pairs = near.join(e.select(F.col("vec_id").alias("a"), F.col("e").alias("ea")).hint("merge"), "a").join(e.select(F.col("vec_id").alias("b"), F.col("e").alias("eb")).hint("merge"), "b")
    return pairs.withColumn("cosine", V.dot("ea", "eb") / (V.norm("ea") * V.norm("eb"))).filter("cosine >= 0.5").select("a", "b", F.round("cosine", 5).alias("cosine"))
