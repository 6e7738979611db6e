"""Scorers, decisions, audits, ablations and plan applications."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import datasets as DS
from tessera.operators import decide as D
from tessera.operators import evaluate as E
from tessera.operators import fusion as U
from tessera.operators import lexical as L
from tessera.operators import vectors as V
from tessera.plans.registry import query
from tessera.plans.resolution import _ITEMS, _items
from tessera.plans.retrieval import _SOURCES, _sources
from tessera.session import table

c = F.col


# ---- N: scorers and decisions

@query("""with e as (select vec_id, embedding::double[] as e from embeddings where embedding is not null), p as (select vec_id as k, e as pe from e where vec_id < 8),
    s as (select vec_id, k < 4 as pos, list_dot_product(e, pe) as s from e, p)
    select vec_id, round(avg(s) filter (pos), 6) as product_mean, round(max(s) filter (pos), 6) as product_max, round(avg(s) filter (not pos), 6) as other_mean, round(max(s) filter (not pos), 6) as other_max, round(avg(s) filter (pos) - avg(s) filter (not pos), 6) as contrast from s group by 1""")
def n3_prompt_contrast(spark, sf_dir):
    """Eight vectors stand for the prompts."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", c("embedding").cast("array<double>").alias("e"))
    p = F.broadcast(e.filter("vec_id < 8").select(c("vec_id").alias("k"), c("e").alias("pe")))  # eight rows
    s = e.crossJoin(p).select("vec_id", (c("k") < 4).alias("pos"), V.dot("e", "pe").alias("s"))
    of = lambda f, pos: f(F.when(c("pos") == pos, c("s")))
    g = s.groupBy("vec_id").agg(of(F.avg, True).alias("product_mean"), of(F.max, True).alias("product_max"), of(F.avg, False).alias("other_mean"), of(F.max, False).alias("other_max"))
    return g.withColumn("contrast", c("product_mean") - c("other_mean")).select("vec_id", *[F.round(x, 6).alias(x) for x in ("product_mean", "product_max", "other_mean", "other_max", "contrast")])


_MODES = _SOURCES + """, m as (select *, min(score) over w as lo, max(score) over w as hi from r window w as (partition by query, source)),
    p as (select query, cid, max(least(1, greatest(0, (score - 5) / 40))) filter (source = 'A') as ca, max(least(1, greatest(0, (score - 5) / 40))) filter (source = 'N') as cn, max(least(1, greatest(0, (score - 5) / 40))) filter (source = 'R') as cr,
      max(case when hi > lo then (score - lo) / (hi - lo) else 1 end) filter (source = 'A') as ma, max(case when hi > lo then (score - lo) / (hi - lo) else 1 end) filter (source = 'N') as mn, max(case when hi > lo then (score - lo) / (hi - lo) else 1 end) filter (source = 'R') as mr from m group by 1, 2),
    v as (select query, cid, (coalesce(ca, 0) + .5 * coalesce(cn, 0) + .15 * coalesce(cr, 0)) / 1.65 as calibrated, (coalesce(ma, 0) + .5 * coalesce(mn, 0) + .15 * coalesce(mr, 0)) / 1.65 as minmax from p) """


def _modes(spark, sf_dir):
    s = U.minmax(_sources(spark, sf_dir)).withColumn("cal", D.calibrated(c("score"), F.lit(5.0), F.lit(45.0)))
    g = s.groupBy("query", "cid").agg(*[F.max(F.when(c("source") == k, c(v))).alias(f"{v}_{k}") for v in ("cal", "scaled") for k in "ANR"])
    mix = lambda v: sum(F.coalesce(c(f"{v}_{k}"), F.lit(0.0)) * w for k, w in (("A", 1.0), ("N", 0.5), ("R", 0.15))) / 1.65
    return g.select("query", "cid", mix("cal").alias("calibrated"), mix("scaled").alias("minmax"))


@query(_MODES + "select query, cid, round(calibrated, 6) as calibrated, round(minmax, 6) as minmax from v")
def n7_semantic_modes(spark, sf_dir):
    return _modes(spark, sf_dir).select("query", "cid", F.round("calibrated", 6).alias("calibrated"), F.round("minmax", 6).alias("minmax"))


_OBSERVED = """with o as (select l_orderkey as item, l_returnflag as field, l_linenumber % 2 as axis, l_suppkey % 3 as v, l_quantity / 50 as conf, l_discount >= .05 as side from lineitem where l_quantity / 50 >= .35),
    x as (select item, field, axis, v, max(conf) as hi, min(conf) as lo from o where side group by all), y as (select item, field, axis, v, max(conf) as hi, min(conf) as lo from o where not side group by all),
    s as (select item, field, axis, max(least(x.hi, y.hi)) as match from x join y using (item, field, axis, v) group by all),
    b as (select item, field, axis, a.lo as al, d.lo as bl from (select item, field, axis, min(lo) as lo from x group by all) a join (select item, field, axis, min(lo) as lo from y group by all) d using (item, field, axis)),
    g as (select item, avg(coalesce(match, 0)) as match, avg(case when match is null and least(al, bl) >= .85 then least(al, bl) else 0 end) as conflict, count(*) as axes from b left join s using (item, field, axis) group by 1) """


def _agreement(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("item"), c("l_returnflag").alias("field"), (c("l_linenumber") % 2).alias("axis"), (c("l_suppkey") % 3).alias("v"), (c("l_quantity") / 50).alias("conf"), "l_discount")
    return D.attribute_agreement(o.filter("l_discount >= 0.05"), o.filter("l_discount < 0.05"), ["item"], ["field", "axis"], "v", "conf")


@query(_OBSERVED + "select item, round(match, 6) as match, round(conflict, 6) as conflict, axes from g")
def n12_attribute_agreement(spark, sf_dir):
    return _agreement(spark, sf_dir).select("item", F.round("match", 6).alias("match"), F.round("conflict", 6).alias("conflict"), "axes")


@query(_OBSERVED + "select case when conflict > 0 then 'conflict' when match >= .5 then 'match' else 'abstain' end as outcome, count(*) as n, sum(axes)::bigint as axes from g group by 1")
def n9_typed_attributes(spark, sf_dir):
    """Outcomes of typed attributes: a sure conflict, a match, or nothing to say."""
    kind = F.when(c("conflict") > 0, "conflict").when(c("match") >= 0.5, "match").otherwise("abstain")
    return _agreement(spark, sf_dir).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.sum("axes").alias("axes"))


_FINAL = """with t as (select l_orderkey as query, l_linenumber * 1000000 + l_partkey as cid, l_suppkey % 3 = 0 as truth, l_tax as geometry, l_discount as ocr_attributes, l_quantity / 100 as ocr_identity, .05 * (l_linenumber % 2) as quality, l_extendedprice / 100000 as semantic,
      case when l_returnflag = 'N' then 1 else .6 end as rel, l_discount * 5 as tok, l_tax * 5 as phr, l_quantity / 50 as am, l_discount * 3 as ac, l_linenumber / 7.0 as oa from lineitem),
    s as (select *, geometry + ocr_attributes + ocr_identity + quality + .75 * semantic + rel * .4 * tok + rel * .2 * phr + rel * .2 * am - rel * .2 * ac + .05 * oa - .1 * (1 - rel) as score from t),
    k as (select *, row_number() over (partition by query order by round(score, 9) desc, cid) as rank from s) """


def _final(spark, sf_dir):
    rel = F.when(c("l_returnflag") == "N", 1.0).otherwise(0.6)
    terms = {"geometry": c("l_tax"), "ocr_attributes": c("l_discount"), "ocr_identity": c("l_quantity") / 100, "quality": (c("l_linenumber") % 2) * 0.05, "semantic": c("l_extendedprice") / 100000}
    terms |= D.reference_terms(rel, c("l_discount") * 5, c("l_tax") * 5, c("l_quantity") / 50, c("l_discount") * 3, c("l_linenumber") / 7)
    li = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("query"), (c("l_linenumber") * 1000000 + c("l_partkey")).alias("cid"), (c("l_suppkey") % 3 == 0).alias("truth"),
                                                 *[t.alias(n) for n, t in terms.items()], D.final_score(terms).alias("score"))
    w = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "cid")
    return li.withColumn("rank", F.row_number().over(w))


@query(_FINAL + "select query, cid, round(score::decimal(18,9), 6)::double as score, rank from k")
def n13_final_score(spark, sf_dir):
    return _final(spark, sf_dir).select("query", "cid", F.round(c("score").cast("decimal(18,9)"), 6).cast("double").alias("score"), "rank")


_PAIR = """, w as (select * from k where rank = 1 and not truth), b as (select * from k where truth qualify row_number() over (partition by query order by rank) = 1),
    d as (select query, w.cid as predicted, b.cid as expected, b.rank as truth_rank, list_sort([{'d': round(w.geometry - b.geometry, 9), 't': 'geometry'}, {'d': round(w.semantic - b.semantic, 9), 't': 'semantic'}, {'d': round(w.ocr_identity - b.ocr_identity, 9), 't': 'ocr_identity'},
      {'d': round(w.ocr_attributes - b.ocr_attributes, 9), 't': 'ocr_attributes'}, {'d': round(w.quality - b.quality, 9), 't': 'quality'}])[-1] as top from w join b using (query)) """


@query(_FINAL + _PAIR + "select query, predicted, expected, truth_rank, top.t as term, round(top.d, 4) as delta from d")
def o13_error_terms(spark, sf_dir):
    """Wrong winners beside the best right candidate, and the term that speaks most for the wrong one."""
    f = _final(spark, sf_dir)
    names = ("geometry", "semantic", "ocr_identity", "ocr_attributes", "quality")
    side = lambda p: [c("cid").alias(f"{p}_cid"), *[c(n).alias(f"{p}_{n}") for n in names]]
    wrong = f.filter("rank = 1 and not truth").select("query", *side("w"))
    right = f.filter("truth").withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy("rank"))).filter("_r = 1").select("query", c("rank").alias("truth_rank"), *side("b"))
    term, delta = D.contribution_deltas({n: c(f"w_{n}") for n in names}, {n: c(f"b_{n}") for n in names})
    return wrong.join(right, "query").select("query", c("w_cid").alias("predicted"), c("b_cid").alias("expected"), "truth_rank", term.alias("term"), F.round(delta, 4).alias("delta"))


@query("""with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey % 4 as base, case when l_quantity > 20 then l_suppkey % 4 else l_partkey % 4 end as prop, l_discount > .07 as shield, case when l_tax < .02 then 'BASELINE_SUPPORT' when l_tax > .06 then 'CHALLENGER_SUPPORT' else 'ABSTAIN' end as txt,
      l_returnflag = 'R' as veto, case when l_linenumber % 2 = 0 then 7 end as resc, l_linenumber as sup, case when l_linenumber % 3 = 0 then 9 end as ext, l_linestatus = 'O' as soft from lineitem),
    r as (select *, case when prop <> base and shield then 'SEMANTIC_SHIELD' when prop <> base and txt = 'BASELINE_SUPPORT' then 'OCR_BASELINE_VETO' when prop <> base and veto then 'STRICT_GEOMETRY_VETO' when prop <> base then 'KEEP_V3'
      when resc is not null and txt <> 'BASELINE_SUPPORT' and not veto and sup >= 2 then 'CROSS_VIEW_V5' when ext is not null and txt <> 'BASELINE_SUPPORT' and not veto and soft then 'EXTERNAL_V5' else 'KEEP_V3' end as reason from f)
    select reason, case when reason in ('SEMANTIC_SHIELD', 'OCR_BASELINE_VETO', 'STRICT_GEOMETRY_VETO') then base when reason = 'CROSS_VIEW_V5' then resc when reason = 'EXTERNAL_V5' then ext else prop end as decision, count(*) as n from r group by 1, 2""")
def n16_cascade(spark, sf_dir):
    base = c("l_suppkey") % 4
    prop = F.when(c("l_quantity") > 20, base).otherwise(c("l_partkey") % 4)
    text = F.when(c("l_tax") < 0.02, "BASELINE_SUPPORT").when(c("l_tax") > 0.06, "CHALLENGER_SUPPORT").otherwise("ABSTAIN")
    rescue, external = F.when(c("l_linenumber") % 2 == 0, 7), F.when(c("l_linenumber") % 3 == 0, 9)
    decision, reason = D.cascade(base, prop, c("l_discount") > 0.07, text, c("l_returnflag") == "R", rescue, c("l_linenumber"), external, c("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason"), decision.cast("long").alias("decision")).agg(F.count("*").alias("n"))


@query("""with s as (select l_orderkey, count(*) filter (l_linenumber > 2) as new, count(*) filter (l_linenumber > 2 and l_quantity > 30) as sup, min(l_partkey) as a, max(l_partkey) as b from lineitem group by 1)
    select l_orderkey, case when new > 0 and sup > 0 then b else a end as chosen, case when new > 0 and sup > 0 then 'NEW_SUPPORTED_SPAN' when new > 0 then 'NEW_SPAN_WITHOUT_SUPPORT' else 'NO_NEW_SPAN' end as reason from s""")
def n15_second_pass(spark, sf_dir):
    later = c("l_linenumber") > 2
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(later).alias("new"), F.count_if(later & (c("l_quantity") > 30)).alias("sup"), F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    chosen, reason = D.second_pass_gate(c("a"), c("b"), c("new"), c("sup"))
    return s.select("l_orderkey", chosen.alias("chosen"), reason.alias("reason"))


@query("""with p as (select p_partkey, p_size, round(p_retailprice, 2) as price from part), r as (select p_partkey, (select count(*) from p b where b.p_size <= a.p_size) / (select count(*) from p)::double as s, (select count(*) from p b where b.price <= a.price) / (select count(*) from p)::double as h, p_size from p a)
    select p_partkey, round(s * .58 + h * .24 + s * .12 + case when p_size % 10 = 0 then .06 else 0 end, 6)::double as priority from r""")
def n19_audit_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("price"))
    p = D.percentile_risk(D.percentile_risk(p, "p_size", "s"), "price", "h")
    return p.select("p_partkey", F.round(D.audit_priority(c("s"), c("h"), c("s"), F.when(c("p_size") % 10 == 0, 0.06).otherwise(0.0)), 6).alias("priority"))


@query(_FINAL + """, f as (select k.query, k.cid, b.cid as expected from k join (select * from k where truth qualify row_number() over (partition by query order by rank) = 1) b on b.query = k.query where k.rank = 1 and not k.truth)
    select case when (cid % 1000000) % 10 = (expected % 1000000) % 10 then 'identical-reference ambiguity' else 'non-ambiguity failure' end as classification, count(*) as n from f group by 1""")
def n18_failure_classes(spark, sf_dir):
    """Wrong winners whose reference equals the right one's (here the last digit of the part) are ambiguous, not failures."""
    f = _final(spark, sf_dir)
    right = f.filter("truth").withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy("rank"))).filter("_r = 1").select("query", c("cid").alias("expected"))
    wrong = f.filter("rank = 1 and not truth").join(right, "query")
    same = (c("cid") % 1000000) % 10 == (c("expected") % 1000000) % 10
    return wrong.groupBy(F.when(same, "identical-reference ambiguity").otherwise("non-ambiguity failure").alias("classification")).agg(F.count("*").alias("n"))


# ---- O, D: evaluations

_TRUTH = _SOURCES + """, a as (select query, min(rank) filter (source = 'A' and cid % 3 = 0) as ra, min(rank) filter (source = 'N' and cid % 3 = 0) as rn, min(rank) filter (source = 'R' and cid % 3 = 0) as rr from r group by 1) """


@query(_TRUTH + "select query, ra, rn, rr, case when ra <= 3 then 'A' when rn <= 2 then 'N' when rr <= 1 then 'R' end as admitted_by from a")
def o12_truth_ranks(spark, sf_dir):
    return E.truth_ranks(_sources(spark, sf_dir).withColumn("truth", c("cid") % 3 == 0), {"A": 3, "N": 2, "R": 1}).select(
        "query", c("rank_A").alias("ra"), c("rank_N").alias("rn"), c("rank_R").alias("rr"), "admitted_by")


_VARIANTS = {"all": {"A": 0.5, "N": 0.3, "R": 0.2}, "no_A": {"N": 0.3, "R": 0.2}, "no_N": {"A": 0.5, "R": 0.2}, "no_R": {"A": 0.5, "N": 0.3}}
_ABLATION = _SOURCES + """, m as (select *, min(score) over w as lo, max(score) over w as hi from r window w as (partition by query, source)),
    v as (select query, cid, source, .75 * case when hi > lo then (score - lo) / (hi - lo) else 1 end + .25 / rank as s from m),
    x as (select variant, query, cid, round(sum(s * case source when 'A' then .5 when 'N' then .3 else .2 end), 9) as total from v, (select unnest(['all', 'no_A', 'no_N', 'no_R']) as variant) where variant <> 'no_' || source group by 1, 2, 3),
    t as (select * from x qualify row_number() over (partition by variant, query order by total desc, cid) = 1) """


@query(_ABLATION + "select variant, count(*) as n, count(*) filter (cid % 3 = 0) as ok from t group by 1")
def o11_ablation(spark, sf_dir):
    """Each source left out in turn, all variants from one scored table."""
    return E.ablation(U.source_scores(_sources(spark, sf_dir)).withColumn("truth", c("cid") % 3 == 0), _VARIANTS).groupBy("variant").agg(F.count("*").alias("n"), F.count_if("truth").alias("ok"))


@query(_ABLATION + "select variant, case when query % 3 = 0 then 'field' else 'catalog' end as mode, count(*) as n, round(avg((cid % 3 = 0)::int), 6) as top1 from t where variant in ('all', 'no_A') group by 1, 2")
def o2_by_mode(spark, sf_dir):
    t = E.ablation(U.source_scores(_sources(spark, sf_dir)).withColumn("truth", c("cid") % 3 == 0), {k: _VARIANTS[k] for k in ("all", "no_A")})
    t = t.withColumn("rank", F.when(c("truth"), 1)).withColumn("mode", F.when(c("query") % 3 == 0, "field").otherwise("catalog"))
    return E.rank_metrics(t, ["variant", "mode"]).select("variant", "mode", "n", F.round("top1", 6).alias("top1"))


@query(_ABLATION + """, d as (select a.query, a.cid % 3 = 0 as new_ok, b.cid % 3 = 0 as old_ok, exists (select 1 from r where r.query = a.query and r.rank <= 2 and r.cid % 3 = 0) as in_pool, a.cid % 7 = b.cid % 7 as same_group from t a join t b using (query) where a.variant = 'all' and b.variant = 'no_A')
    select query % 4 as dataset, count(*) as n, count(*) filter (new_ok) as exact, count(*) filter (new_ok and not old_ok) as fixed, count(*) filter (not new_ok and old_ok) as broken, count(*) filter (in_pool) as in_pool,
    round(count(*) filter (new_ok and in_pool) / nullif(count(*) filter (in_pool), 0), 6) as conditional, count(*) filter (not new_ok and same_group) as same_group_errors from d group by 1""")
def d27_extended_metrics(spark, sf_dir):
    s = U.source_scores(_sources(spark, sf_dir)).withColumn("truth", c("cid") % 3 == 0)
    t = E.ablation(s, {k: _VARIANTS[k] for k in ("all", "no_A")})
    new = t.filter("variant = 'all'").select("query", c("truth").alias("new_ok"), (c("cid") % 7).alias("g"))
    old = t.filter("variant = 'no_A'").select("query", c("truth").alias("old_ok"), (c("cid") % 7).alias("h"))
    pool = s.filter("rank <= 2 and truth").select("query").distinct().withColumn("in_pool", F.lit(True))
    d = new.join(old, "query").join(pool, "query", "left").withColumn("in_pool", F.coalesce("in_pool", F.lit(False))).withColumn("dataset", c("query") % 4)
    g = E.extended_metrics(d.withColumn("same_group", c("g") == c("h")), ["dataset"])
    return g.withColumn("conditional", F.round("conditional", 6))


@query(_MODES + """, g as (select x / 10.0 as a, y as y from generate_series(0, 10) t(x), (select unnest([0, 1]) as y)), q as (select * from v where query % 50 = 0), sc as (select a, y, query, cid, round(a * calibrated + (1 - a) * minmax + y * .01 * (cid % 3), 9) as total from q, g),
    t as (select * from sc qualify row_number() over (partition by a, y, query order by total desc, cid) = 1) select (a * 10)::int * 2 + y as config, count(*) as n, count(*) filter (cid % 3 = 0) as ok from t group by 1""")
def o5_scorer_grid(spark, sf_dir):
    """A grid of scorers over the query set (ids divisible by 50)."""
    grid = F.broadcast(spark.range(22).select(c("id").alias("config"), (F.floor(c("id") / 2) / 10).alias("a"), (c("id") % 2).alias("y")))  # 22 rows
    q = _modes(spark, sf_dir).filter("query % 50 = 0").crossJoin(grid)
    total = F.round(c("a") * c("calibrated") + (1 - c("a")) * c("minmax") + c("y") * 0.01 * (c("cid") % 3), 9)
    best = q.groupBy("config", "query").agg(F.max_by("cid", F.struct(total, -c("cid"))).alias("cid"))
    return best.groupBy("config").agg(F.count("*").alias("n"), F.count_if(c("cid") % 3 == 0).alias("ok"))


@query("""with d as (select source as dataset, (n_chars > 1000)::int = quality as ok from documents join labels using (doc_id)), a as (select dataset, count(*) as n, avg(ok::int) as acc from d group by 1)
    select dataset, n, round(acc, 9) as reported, round(acc, 9) as recounted, true as equal from a""")
def o14_recount(spark, sf_dir):
    """A reported metric against the same one counted another way: from the confusion of truth and decision."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(c("source").alias("dataset"), (c("n_chars") > 1000).cast("int").alias("said"), "quality")
    reported = d.groupBy("dataset").agg(F.count("*").alias("n"), F.avg((c("said") == c("quality")).cast("int")).alias("reported"))
    cells = d.groupBy("dataset", "said", "quality").agg(F.count("*").alias("c")).groupBy("dataset").agg((F.sum(F.when(c("said") == c("quality"), c("c")).otherwise(0)) / F.sum("c")).alias("recounted"))
    j = reported.join(cells, "dataset")
    return j.select("dataset", "n", F.round("reported", 9).alias("reported"), F.round("recounted", 9).alias("recounted"), (F.abs(c("reported") - c("recounted")) < 1e-12).alias("equal"))


@query("""select o_custkey as run, count(*) as epochs, max(o_totalprice) as best, min_by(o_orderkey, (-o_totalprice, o_orderkey)) as best_epoch, max_by(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders group by 1""")
def o10_training_runs(spark, sf_dir):
    """Runs with their best epoch and last status."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(c("o_custkey").alias("run")).agg(F.count("*").alias("epochs"), F.max("o_totalprice").alias("best"), F.min_by("o_orderkey", F.struct(-c("o_totalprice"), "o_orderkey")).alias("best_epoch"),
                                                      F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query("""with e as (select o_custkey as model, count(*) as n_evaluations, bool_or(o_orderpriority like '1%') as ok from orders group by 1), r as (select o_custkey as model, case o_orderkey % 4 when 0 then 'deprecated' when 1 then 'promoted' else 'validated' end as to_, {'a': o_orderdate, 'n': o_orderkey} as w from orders where o_orderkey % 5 <> 0),
    d as (select model, min(w) filter (to_ = 'deprecated') as d, count(*) as n from r group by 1),
    v as (select r.model, min(w) as v from r join e on e.model = r.model and e.ok join d on d.model = r.model where to_ = 'validated' and (d is null or w < d) group by 1),
    p as (select r.model, min(w) as p from r join v on v.model = r.model join d on d.model = r.model where to_ = 'promoted' and w > v and (d is null or w < d) group by 1),
    s as (select c_custkey as model, c_mktsegment as task, d.d, d.n, v.v, p.p, coalesce(n_evaluations, 0) as n_evaluations from customer c left join e on e.model = c_custkey left join d on d.model = c_custkey left join v on v.model = c_custkey left join p on p.model = c_custkey),
    x as (select s.*, (select min(t.p) from s t where t.task = s.task and t.p > s.p) as nxt from s)
    select model, task, case when d is not null or nxt is not null then 'deprecated' when p is not null then 'promoted' when v is not null then 'validated' else 'candidate' end as status, p.a as promoted_at, n_evaluations,
      coalesce(n, 0) - (v is not null)::int - (p is not null)::int - (d is not null and (nxt is null or d < nxt))::int as rejected from x""")
def o10_model_states(spark, sf_dir):
    """Customers are models, segments their tasks; orders are evaluations and, but for every fifth, requests."""
    o, m = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(c("c_custkey").alias("model"), c("c_mktsegment").alias("task"))
    kind = c("o_orderkey") % 4
    requests = o.filter("o_orderkey % 5 <> 0").select(c("o_custkey").alias("model"), F.when(kind == 0, "deprecated").when(kind == 1, "promoted").otherwise("validated").alias("to"), c("o_orderdate").alias("at"), c("o_orderkey").alias("n"))
    checks = o.select(c("o_custkey").alias("model"), F.when(c("o_orderpriority").startswith("1"), "validation").otherwise("test").alias("split"))
    return DS.model_states(m, checks, requests)


_NOTED = """with a as (select coalesce(lang, 'none') as lang, d.doc_id % 3 <> 0 as has_proposal, d.doc_id % 5 < 3 as has_roi, d.doc_id % 4 > 0 as has_ocr, d.doc_id % 8 > 4 as has_text, quality = 1 as has_analysis,
    case d.doc_id % 6 when 0 then 'needs-review' when 1 then 'no-label' when 2 then 'invalid-image' when 3 then null else 'reviewed' end as status, case when toxic = 1 then 'rejected' when quality = 1 then case d.doc_id % 3 when 0 then 'accepted' when 1 then 'needs-tuning' end end as analysis_review,
    case d.doc_id % 9 when 0 then 'confirmed' when 1 then 'corrected' when 2 then 'no-match' when 3 then 'ambiguous' end as identity from documents d left join labels using (doc_id)),"""


@query(_NOTED + """ s as (select lang, count(*) as total_items, count(*) filter (has_proposal) as with_proposal, count(*) filter (not has_proposal) as missing_proposal, count(*) filter (status = 'needs-review') as needs_review, count(*) filter (status = 'reviewed') as reviewed, count(*) filter (status = 'reviewed' and has_roi) as reviewed_bbox,
    count(*) filter (status = 'no-label') as no_label, count(*) filter (status = 'invalid-image') as invalid_image, count(*) filter (status is null) as no_annotation, count(*) filter (status = 'reviewed' and has_roi) as ready_for_export, count(*) filter (has_ocr) as with_backend_ocr, count(*) filter (has_text) as with_reviewed_ocr_text,
    count(*) filter (status = 'reviewed' and has_roi and not has_ocr) as needs_ocr, count(*) filter (status = 'reviewed' and has_roi and has_ocr and not has_text) as needs_ocr_review, count(*) filter (status = 'reviewed' and has_roi and has_text) as text_ready_for_export, count(*) filter (has_analysis) as with_label_analysis,
    count(*) filter (has_analysis and analysis_review is null) as needs_label_analysis_review, count(*) filter (analysis_review = 'accepted') as label_analysis_accepted, count(*) filter (analysis_review = 'needs-tuning') as label_analysis_needs_tuning, count(*) filter (analysis_review = 'rejected') as label_analysis_rejected, count(identity) as with_catalog_identity,
    count(*) filter (has_analysis and identity is null) as needs_catalog_identity, count(*) filter (identity = 'confirmed') as catalog_identity_confirmed, count(*) filter (identity = 'corrected') as catalog_identity_corrected, count(*) filter (identity = 'no-match') as catalog_identity_no_match, count(*) filter (identity = 'ambiguous') as catalog_identity_ambiguous from a group by 1)
    select *, floor(1000.0 * with_proposal / total_items + .5) / 10::double as pct_with_proposal, floor(1000.0 * reviewed / total_items + .5) / 10::double as pct_reviewed, floor(1000.0 * ready_for_export / total_items + .5) / 10::double as pct_ready_for_export, floor(1000.0 * with_backend_ocr / total_items + .5) / 10::double as pct_with_backend_ocr, floor(1000.0 * text_ready_for_export / total_items + .5) / 10::double as pct_text_ready_for_export from s""")
def d12_annotation_summary(spark, sf_dir):
    """Documents stand for annotated items; what the tables do not hold follows from the id."""
    i = c("doc_id")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(i % 6 == 0, "needs-review").when(i % 6 == 1, "no-label").when(i % 6 == 2, "invalid-image").when(i % 6 > 3, "reviewed")
    review = F.when(c("toxic") == 1, "rejected").when((c("quality") == 1) & (i % 3 == 0), "accepted").when((c("quality") == 1) & (i % 3 == 1), "needs-tuning")
    identity = F.when(i % 9 == 0, "confirmed").when(i % 9 == 1, "corrected").when(i % 9 == 2, "no-match").when(i % 9 == 3, "ambiguous")
    a = d.select(F.coalesce("lang", F.lit("none")).alias("lang"), (i % 3 != 0).alias("has_proposal"), (i % 5 < 3).alias("has_roi"), (i % 4 > 0).alias("has_ocr"), (i % 8 > 4).alias("has_text"), (c("quality") == 1).alias("has_analysis"),
                 status.alias("status"), review.alias("analysis_review"), identity.alias("identity"))
    return DS.annotation_summary(a, ["lang"])


# ---- H: plans and their application.  The plan moves the parts of two brands to a third one, where the row still is as reviewed.

_PLAN = """with plan as (select p_partkey, p_brand as expected, 'Brand#1' as target from part where p_brand in ('Brand#2', 'Brand#3')), cur as (select p_partkey, case when p_size = 13 then 'Brand#9' else p_brand end as brand, p_retailprice from part),
    j as (select cur.*, plan.target, plan.expected, case when plan.p_partkey is null then 'untouched' when brand = expected then 'applied' when brand = target then 'already' else 'blocked' end as outcome from cur left join plan using (p_partkey)) """


def _planned(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    plan = p.filter(c("p_brand").isin("Brand#2", "Brand#3")).select("p_partkey", c("p_brand").alias("expected"), F.lit("Brand#1").alias("target"))
    cur = p.select("p_partkey", F.when(c("p_size") == 13, "Brand#9").otherwise(c("p_brand")).alias("brand"), "p_retailprice")
    outcome = F.when(c("expected").isNull(), "untouched").when(c("brand") == c("expected"), "applied").when(c("brand") == c("target"), "already").otherwise("blocked")
    j = cur.join(plan, "p_partkey", "left").withColumn("outcome", outcome)
    return j.withColumn("after", F.when(c("outcome") == "applied", c("target")).otherwise(c("brand")))


@query(_PLAN + "select outcome, count(*) as n, round(sum(p_retailprice), 2) as protected from j group by 1")
def h7_apply_plan(spark, sf_dir):
    """Outcomes with a fingerprint of a protected column, which the application leaves as it is."""
    return _planned(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("protected"))


@query(_PLAN + """, a as (select brand, count(*) as n from j group by 1), b as (select case when outcome = 'applied' then target else brand end as brand, count(*) as n from j group by 1) select brand, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after from a full join b using (brand)""")
def h8_before_after(spark, sf_dir):
    j = _planned(spark, sf_dir)
    a = j.groupBy("brand").agg(F.count("*").alias("before"))
    b = j.groupBy(c("after").alias("brand")).agg(F.count("*").alias("after"))
    return a.join(b, "brand", "full").select("brand", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


@query("""with d as (select o_custkey as k, min(o_orderkey) as a, count(*) as n from orders group by 1), m as (select c_custkey as k, case when c_custkey % 17 = 0 then -c_custkey end as manual from customer),
    x as (select m.k, coalesce(manual, case when n = 1 then a end) as assigned, case when manual is not null then 'manual' when n = 1 then 'deterministic' when n > 1 then 'ambiguous' else 'missing' end as how from m left join d using (k)) select how, count(*) as n, count(assigned) as covered from x group by 1""")
def h12_assignment_plan(spark, sf_dir):
    """Manual decisions first, then the only candidate; several or none stay open, and coverage is counted."""
    d = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("a"), F.count("*").alias("n"))
    m = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), F.when(c("c_custkey") % 17 == 0, -c("c_custkey")).alias("manual"))
    j = m.join(d, "k", "left")
    how = F.when(c("manual").isNotNull(), "manual").when(c("n") == 1, "deterministic").when(c("n") > 1, "ambiguous").otherwise("missing")
    return j.groupBy(how.alias("how")).agg(F.count("*").alias("n"), F.count(F.coalesce("manual", F.when(c("n") == 1, c("a")))).alias("covered"))


# ---- C24, C25, M8: recognised texts against the fields of items

def _lex(a, b, long):
    """The kinds and scores of lexical matches, in SQL."""
    w = lambda x: f"list_distinct(list_filter(string_split_regex({x}, '[\\s-]+'), lambda z: length(z) >= 2))"
    s, n, m = f"len(list_intersect({w(a)}, {w(b)}))", f"len({w(a)})", f"len({w(b)})"
    r = f"(least(length({a}), length({b})) / greatest(length({a}), length({b}))::double)"
    e = f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))::double)"
    o = f"({s} / {n} * .82 + {s} / {m} * .18)"
    return (f"case when {a} = {b} then 1 when {s} > 0 and ({n} = 1 or {m} = 1) then .98 when contains({a}, {b}) or contains({b}, {a}) then case when {r} >= case when {long} then .18 else .4 end then least(.96, .62 + {r} * .34) end "
            f"when {s} > 0 and {s} / {n} >= .5 and {o} >= .35 then {o} when least(length({a}), length({b})) >= 4 and greatest(length({a}), length({b})) <= 80 and {e} >= .58 then {e} * .86 end")


_REGION = _ITEMS + """, g as (select distinct category || ' ' || maker as t from items where size % 5 = 0 union select distinct type || ' ' || title from items where size % 7 = 0),
    f as (select distinct title as v, true as long from items union select distinct maker, false from items union select distinct type, false from items),
    k as (select distinct t, v, long from g join f on list_has_any(string_split_regex(t, '[\\s-]+'), string_split_regex(v, '[\\s-]+'))), m as (select t, v, """ + _lex("t", "v", "long") + " as s from k) "


def _field_matches(spark, sf_dir):
    i = _items(spark, sf_dir)
    g = i.filter("size % 5 = 0").select(F.concat_ws(" ", "category", "maker").alias("t")).union(i.filter("size % 7 = 0").select(F.concat_ws(" ", "type", "title"))).distinct()
    f = i.select(c("title").alias("v"), F.lit(True).alias("long")).union(i.select("maker", F.lit(False))).union(i.select("type", F.lit(False))).distinct()
    word = lambda x: F.explode(F.split(x, r"[\s-]+")).alias("w")
    k = g.select("t", word("t")).join(f.select("v", "long", word("v")), "w").select("t", "v", "long").distinct()
    s, kind = L.lexical_match("t", "v", c("long"))
    return k.withColumn("s", s).withColumn("kind", kind).filter("s is not null")


@query(_REGION + "select t, v, round(s, 6) as score from m where s is not null qualify row_number() over (partition by t order by round(s, 9) desc, v) <= 6")
def c24_source_values(spark, sf_dir):
    m = _field_matches(spark, sf_dir)
    w = W.partitionBy("t").orderBy(F.desc(F.round("s", 9)), "v")
    return m.withColumn("r", F.row_number().over(w)).filter("r <= 6").select("t", "v", F.round("s", 6).alias("score"))


@query(_REGION + """, r as (select t, id, max(s) as s from m join items on v = title or v = maker or v = type where s is not null group by 1, 2) select t, id, round(s, 6) as score from r qualify row_number() over (partition by t order by round(s, 9) desc, id) <= 2""")
def c25_catalog_rows(spark, sf_dir):
    i = _items(spark, sf_dir)
    fields = i.select("id", c("title").alias("v")).union(i.select("id", "maker")).union(i.select("id", "type")).distinct()
    r = _field_matches(spark, sf_dir).join(fields, "v").groupBy("t", "id").agg(F.max("s").alias("s"))
    w = W.partitionBy("t").orderBy(F.desc(F.round("s", 9)), "id")
    return r.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("t", "id", F.round("s", 6).alias("score"))


@query(_ITEMS + """, g as (select * from (values ('red bolt', .9, 1.1, 1), ('brand#12', .7, 1.1, 2), ('economy', .5, .2, 3), ('bolt', .4, 1.1, 1)) t(t, conf, w, e)), tot as (select sum(w) as w from (select e, max(w) as w from g group by 1)),
    f as (select id, title as v, true as long from items union all select id, maker, false from items union all select id, type, false from items),
    k as (select g.*, f.id, f.v, f.long from g join f on list_has_any(string_split_regex(t, '[\\s-]+'), string_split_regex(v, '[\\s-]+'))), m as (select *, (""" + _lex("t", "v", "long") + """) * (.55 + conf * .25 + .2) as s from k),
    b as (select id, e, max(s) as s, max(w) as w from m where s is not null group by 1, 2), a as (select id, sum(s * w) as c, max(s) as m, count(*) as matched from b group by 1),
    z as (select id, matched, least(1, c / tot.w * .88 + m * .12) as score from a, tot) select id, matched, round(score, 6)::double as score from z order by round(score, 9) desc, matched desc, id limit 10""")
def m8_narrow_catalog(spark, sf_dir):
    """Catalog rows by four recognised texts, two of which are one piece of evidence."""
    g = spark.createDataFrame([("red bolt", 0.9, 1.1, 1), ("brand#12", 0.7, 1.1, 2), ("economy", 0.5, 0.2, 3), ("bolt", 0.4, 1.1, 1)], "t string, conf double, w double, e int")
    return L.narrow(g, _items(spark, sf_dir), "e", "t", "conf", "w", "id", {"title": True, "maker": False, "type": False}).select("id", "matched", F.round("score", 6).alias("score"))


# ---- N8, N10, N14, M17: text features and model variants

_CONF = """, q as (select x.* from (values ('q1', 'red', .9), ('q1', 'bolt', .8), ('q1', 'brand#12', .6), ('q2', 'hot', .7), ('q2', 'gear', .95), ('q2', 'economy', .5)) x(query, token, conf)),
    w as (select i.id, x.token, x.field from items i, lateral (select unnest(string_split(title, ' ')) as token, 'product' as field union all select maker, 'producer' union all select type, 'other') x),
    n as (select count(*) as n from items), f as (select token, ln((n.n + 1) / (count(distinct id) + 1.0)) / ln(n.n + 1) as idf from w, n group by token, n.n), h as (select query, id, w.token, min(field) as field, idf, conf from w join q using (token) join f using (token) group by all) """
_TOP = """, b as (select query, id, sum(idf) as s from (select distinct query, id, token, idf from h) group by 1, 2), t as (select query, id from b qualify row_number() over (partition by query order by round(s, 9) desc, id) <= 10),
    m as (select query, token, count(distinct id) as members from t join h using (query, id) group by 1, 2),
    v as (select query, id, token, max(field = 'producer') as maker, any_value(idf) * any_value(conf) as v, coalesce(any_value(members), 0) as mem from h left join m using (query, token) group by 1, 2, 3),
    s as (select query, id, sum(case when maker or mem >= 2 then v else 0 end) as fam, sum(case when maker or mem >= 2 then 0 else v end) as sku, sum(case when maker or mem >= 2 then v / sqrt(greatest(1, mem)) else 0 end) as damped from v group by 1, 2) """


def _text_hits(spark, sf_dir):
    i = _items(spark, sf_dir)
    q = spark.createDataFrame([("q1", "red", 0.9), ("q1", "bolt", 0.8), ("q1", "brand#12", 0.6), ("q2", "hot", 0.7), ("q2", "gear", 0.95), ("q2", "economy", 0.5)], "query string, token string, conf double")
    field = lambda t, f: F.struct(t.alias("token"), F.lit(f).alias("field"))
    w = i.select("id", F.explode(F.concat(F.transform(F.split("title", " "), lambda t: field(t, "product")), F.array(field(c("maker"), "producer"), field(c("type"), "other")))).alias("x")).select("id", "x.token", "x.field")
    return L.text_hits(w, q, i.agg(F.count("*").alias("n")))


@query(_ITEMS + _CONF + """, b as (select query, id, sum(idf) as s, count(*) as tokens from (select distinct query, id, token, idf from h) group by 1, 2), r as (select *, row_number() over (partition by query order by round(least(1, s / 2), 9) desc, id) as rank from b)
    select query, id, round(least(1, s / 2), 6)::double as identity, tokens, rank from r where rank <= 20""")
def n10_text_ranking(spark, sf_dir):
    h = _text_hits(spark, sf_dir).groupBy("query", "id").agg(F.sum("idf").alias("s"), F.count("*").alias("tokens")).withColumn("identity", F.least(F.lit(1.0), c("s") / 2))
    w = W.partitionBy("query").orderBy(F.desc(F.round("identity", 9)), "id")
    return h.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("query", "id", F.round("identity", 6).alias("identity"), "tokens", "rank")


@query(_ITEMS + _CONF + _TOP + "select query, id, round(fam / greatest(2, fam + sku), 6)::double as family, round(sku / greatest(2, fam + sku), 6)::double as sku, round(damped / greatest(2, damped + sku), 6)::double as shared_family from s")
def n8_structured_text(spark, sf_dir):
    """A producer's token, or one that two of the ten best rows hold, speaks for the family; all others for the item."""
    return L.family_features(_text_hits(spark, sf_dir)).select("query", "id", *[F.round(x, 6).alias(x) for x in ("family", "sku", "shared_family")])


@query(_FINAL + """, x as (select query, cid, truth, 'A' as model, geometry + ocr_attributes + ocr_identity + quality + semantic as s from t union all
    select query, cid, truth, 'B', geometry + ocr_attributes + ocr_identity + quality + semantic + rel * .4 * tok + rel * .2 * phr + rel * .2 * am - rel * .2 * ac + .05 * oa - .1 * (1 - rel) from t union all
    select query, cid, truth, 'C', geometry + quality + semantic + rel * .6 * tok + rel * .2 * am - rel * .2 * ac + .05 * oa - .1 * (1 - rel) from t), y as (select * from x qualify row_number() over (partition by model, query order by round(s, 9) desc, cid) = 1)
    select model, count(*) as n, count(*) filter (truth) as ok from y group by 1""")
def n14_model_variants(spark, sf_dir):
    """A: without reference texts; B: with them; C: reference identity in place of the official one."""
    f = _final(spark, sf_dir).withColumn("rel", F.round(c("reliability_penalty") * 10 + 1, 9))
    plain = c("geometry") + c("quality") + c("semantic")
    tail = c("reference_attribute_match") + c("reference_attribute_conflict") + c("weak_official_agreement") + c("reliability_penalty")
    models = {"A": plain + c("ocr_attributes") + c("ocr_identity"), "B": plain + c("ocr_attributes") + c("ocr_identity") + c("reference_tokens") + c("reference_phrases") + tail, "C": plain + c("reference_tokens") * 1.5 + tail}
    best = f.groupBy("query").agg(*[F.max_by("truth", F.struct(F.round(s, 9), -c("cid"))).alias(m) for m, s in models.items()])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), c(m).alias("ok")) for m in models])
    return best.select(F.explode(rows).alias("r")).groupBy("r.model").agg(F.count("*").alias("n"), F.count_if("r.ok").alias("ok"))


# ---- F1, N5, C18, O1: ranks

@query(_SOURCES + "select query, cid, rank from r where source = 'A' and rank <= 3")
def f1_topk_stable(spark, sf_dir):
    return _sources(spark, sf_dir).filter("source = 'A' and rank <= 3").select("query", "cid", "rank")


@query(_SOURCES + """, m as (select *, min(score) over w as lo, max(score) over w as hi from r window w as (partition by query, source)) select query, source, cid, round(.75 * case when hi > lo then (score - lo) / (hi - lo) else 1 end + .25 / rank, 6) as source_score from m""")
def n5_source_scores(spark, sf_dir):
    return U.source_scores(_sources(spark, sf_dir)).select("query", "source", "cid", F.round("source_score", 6).alias("source_score"))


_EXPECTED = """with g as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null), q as (select a.vec_id as query, a.e, b.vec_id as expected, b.label as el, round(list_cosine_similarity(a.e, b.e), 9) as s from g a join g b on b.vec_id = a.vec_id + 1 where a.vec_id % 50 = 0),
    x as (select query, expected, s, el, vec_id, label, round(list_cosine_similarity(q.e, g.e), 9) as t from q, g where g.vec_id <> query),
    r as (select query, expected, 1 + count(*) filter (t > s or (t = s and vec_id < expected)) as strict, max(t) filter (label = el) as best from x group by 1, 2),
    z as (select r.query, r.expected, strict, 1 + count(*) filter (t > best) as equivalent from r join x using (query) group by all) """


@query(_EXPECTED + "select query, expected, strict, equivalent from z")
def o1_retrieval_ranks(spark, sf_dir):
    """The strict rank of the expected row, and that of the best row of its group (label)."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    asked = e.filter("vec_id % 50 = 0").select(c("vec_id").alias("query"), c("embedding").alias("v"), (c("vec_id") + 1).alias("expected"))
    right = e.select(c("vec_id").alias("expected"), c("embedding").alias("ev"), c("label").alias("group"))
    return V.expected_ranks(e, asked.join(right, "expected"), "vec_id", "embedding", "label")


@query("""with q as (select vec_id as query, embedding::double[] as e from embeddings where vec_id % 50 = 0), s as (select query, vec_id as id, round(list_cosine_similarity(q.e, embedding::double[]), 5) as score from q, embeddings where vec_id <> query and embedding is not null)
    select query, count(*) filter (score >= .3) as above, max(score) as best from s group by 1""")
def c18_cosine_join(spark, sf_dir):
    """Every query vector against every gallery vector: how many reach a bound, and the best."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    return V.score_summary(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 0.3).select("query", "above", F.round("best", 5).alias("best"))
