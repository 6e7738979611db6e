"""Matching, vector retrieval, fusion, evaluation and dataset queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.operators import evaluate as E
from tessera.operators import fusion as U
from tessera.operators import match as M
from tessera.operators import relational as B
from tessera.operators import resolve as R
from tessera.operators import vectors as V
from tessera.plans.registry import query
from tessera.session import table


# ---- M: entity resolution

def _catalogs(spark, sf_dir):
    """Distinct texts of the parts of even and of odd key: (l, name, tokens) and (r, title, p_brand, doc, tokens)."""
    p = table(spark, sf_dir, "part").withColumn("tokens", F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")), " "))
    g = p.groupBy((F.col("p_partkey") % 2).alias("side"), "p_name", "p_brand", "p_type", "tokens").agg(F.min("p_partkey").alias("id"))
    doc = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return g.filter("side = 0").select(F.col("id").alias("l"), "p_name", "tokens"), g.filter("side = 1").select(F.col("id").alias("r"), F.col("p_name").alias("title"), "p_brand", doc.alias("doc"), "tokens")


@query("""with i as (select p_partkey % 2 as side, min(p_partkey) as id, list_distinct(string_split(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand), ' ')) as tokens from part group by 1, p_name, p_type, p_brand),
    t as (select side, id, unnest(tokens) as token from i), c as (select l.id as l, r.id as r, count(*) as shared from t l join t r using (token) where l.side = 0 and r.side = 1 group by 1, 2)
    select l, count(*) as candidates, min(r) as first, max(shared) as most from c group by l""")
def c10_blocking(spark, sf_dir):
    a, b = _catalogs(spark, sf_dir)
    return M.block(a, b, "l", "r").groupBy("l").agg(F.count("*").alias("candidates"), F.min("r").alias("first"), F.max("shared").cast("long").alias("most"))


@query()
def m1_match_products(spark, sf_dir):
    """Best five catalog rows of each product, of all that share a word; the similarity is not in SQL, tests hold the whole score against plain Python.  Bounds of the score settle
    most pairs without Python."""
    a, b = _catalogs(spark, sf_dir)
    near = M.block(a, b, "l", "r").join(a.select("l", "p_name"), "l").join(b.drop("tokens"), "r")
    words = R.Words(style=("red", "blue", "green", "hot", "cold"), generic=("ring", "bolt", "gear", "red", "blue", "green", "hot", "cold"), stop=("economy",), maker_stop=("brand",))
    scored = R.score_products(near, "p_name", "title", "p_brand", "doc", words, best=("l", 5, 0.3))
    return R.top_matches(scored, "l", "r", 0.3).select("l", "r", "score", "rank", F.array_join("caps", ",").alias("caps"), "method")


@query("""with s as (select o_custkey as query, o_orderkey as cid, round(o_totalprice / 500000, 6) as score from orders), r as (select *, row_number() over (partition by query order by score desc, cid) as rank,
    lead(score) over (partition by query order by score desc, cid) as nxt from s)
    select case when rank > 1 or score < .55 then 'rejected' when score - coalesce(nxt, 0) >= .08 then 'matched' else 'needs_review' end as status, count(*) as n from r group by 1""")
def m3_ambiguity_gate(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("cid"), F.round(F.col("o_totalprice") / 500000, 6).alias("score"))
    return U.ambiguity_gate(U.rank_by(s, "score"), "score", 0.55).groupBy("status").agg(F.count("*").alias("n"))


@query("""select state, count(*) as n from (select case when trim(a.p_brand) = '' or b.p_brand is null then 'missing' when a.p_brand = b.p_brand then 'equal' else 'conflict' end as state
    from part a left join part b on b.p_partkey = a.p_partkey + 1) group by 1""")
def m5_field_states(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    o = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("other"))
    return p.join(o, "p_partkey", "left").select(M.field_state("p_brand", "other").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("""with t as (select p_partkey, unnest(string_split(p_name, ' ')) as token from part), f as (select token, ln((select count(*) + 1 from part) / (count(distinct p_partkey) + 1.0)) + 1 as idf from t group by 1),
    s as (select d.q, t.p_partkey, sum(idf) as score from (select 'red bolt' as q, unnest(['red', 'bolt']) as token union all select 'hot gear', unnest(['hot', 'gear'])) d join t using (token) join f using (token) group by all)
    select q, p_partkey, round(score, 6) as score from s qualify row_number() over (partition by q order by score desc, p_partkey) <= 10""")
def m13_rare_token_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    q = spark.createDataFrame([("red bolt",), ("hot gear",)], "q string").select("q", F.explode(F.split("q", " ")).alias("token"))
    s = p.select("p_partkey", F.explode("tokens").alias("token")).join(F.broadcast(q), "token").join(M.idf(p), "token").groupBy("q", "p_partkey").agg(F.round(F.sum("idf"), 6).alias("score"))
    w = W.partitionBy("q").orderBy(F.desc("score"), "p_partkey")
    return s.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").drop("rn")


# ---- N: vectors and fusion

@query("""select vec_id, len(embedding) as dim, round(sqrt(list_sum([x::double * x::double for x in embedding])), 5) as norm from embeddings""")
def n1_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(V.norm("embedding"), 5).alias("norm"))


_COS = """with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 50 = 0), g as (select vec_id, label, embedding::double[] as e from embeddings),
    s as (select q.vec_id as query, g.vec_id as id, g.label, round(list_cosine_similarity(q.e, g.e), 9) as score from q, g where q.vec_id <> g.vec_id),
    r as (select *, row_number() over (partition by query order by score desc, id) as rank from s) """


def _hits(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings")
    return V.exact_topk(e, e.filter("vec_id % 50 = 0"), k, "vec_id", "vec_id", "embedding", exclude_self=True)


@query(_COS + "select query, id, rank from r where rank <= 10")
def n2_exact_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 10).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query(_COS + "select query, label, max(score)::decimal(9, 5)::double as score from r group by all")
def c19_collapse_by_label(spark, sf_dir):
    """The best of each label is taken inside each batch, so no list of all pairs is made."""
    e = table(spark, sf_dir, "embeddings")
    best = V.best_per_label(e, e.filter("vec_id % 50 = 0"), "vec_id", "vec_id", "embedding", "label", exclude_self=True)
    return best.select("query", "label", F.col("score").cast("decimal(9,5)").cast("double").alias("score"))


@query(_COS + """, t as (select query, min(rank) filter (r.label = e.label) as rank from r join embeddings e on e.vec_id = r.query group by 1)
    select count(*) as n, round(avg((coalesce(rank, 99) <= 1)::int), 6) as top1, round(avg((coalesce(rank, 99) <= 5)::int), 6) as top5, round(avg((coalesce(rank, 99) <= 10)::int), 6) as top10, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr from (select query, case when rank <= 20 then rank end as rank from t)""")
def d24_rank_metrics(spark, sf_dir):
    lab = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    h = _hits(spark, sf_dir, 20).join(lab.withColumnRenamed("vec_id", "id"), "id").withColumnRenamed("label", "gl")
    h = h.join(lab.withColumnRenamed("vec_id", "query"), "query")
    t = h.groupBy("query").agg(F.min(F.when(F.col("gl") == F.col("label"), F.col("rank"))).alias("rank"))
    m = E.rank_metrics(t)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("top1", "top5", "top10", "mrr")])


def _sources(spark, sf_dir):
    """Ranked sources from lineitem: the part is the query, the supplier a candidate, the return flag a source."""
    lines = B.dealt(table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey", "l_quantity"), "l_partkey")
    s = lines.groupBy(F.col("l_partkey").alias("query"), F.col("l_returnflag").alias("source"), F.col("l_suppkey").alias("cid")).agg(F.max("l_quantity").alias("score"))
    return U.rank_by(s, "score", by=("query", "source"))


_SOURCES = """with s as (select l_partkey as query, l_returnflag as source, l_suppkey as cid, max(l_quantity) as score from lineitem group by all),
    r as (select *, row_number() over (partition by query, source order by score desc, cid) as rank from s) """


@query(_SOURCES + """, p as (select query, cid, round(sum(1.0 / (60 + rank)), 12) as fusion, string_agg(source, ',' order by source) as sources from r where rank <= case source when 'A' then 3 when 'N' then 2 else 1 end group by 1, 2)
    select query, cid, round(fusion, 9) as fusion, sources, row_number() over (partition by query order by fusion desc, cid) as fusion_rank from p""")
def n4_pool(spark, sf_dir):
    return U.pool(_sources(spark, sf_dir), {"A": 3, "N": 2, "R": 1}).select("query", "cid", F.round("fusion", 9).alias("fusion"), F.array_join("sources", ",").alias("sources"), F.col("fusion_rank").cast("long").alias("fusion_rank"))


@query(_SOURCES + """, m as (select *, min(score) over w as lo, max(score) over w as hi from r window w as (partition by query, source)),
    v as (select query, cid, source, .75 * case when hi > lo then (score - lo) / (hi - lo) else 1 end + .25 / rank as s from m),
    c as (select query, cid, round(.5 * coalesce(max(s) filter (source = 'A'), 0) + .3 * coalesce(max(s) filter (source = 'N'), 0) + .2 * coalesce(max(s) filter (source = 'R'), 0), 9) as total from v group by 1, 2)
    select query, cid, round(total, 6) as total from c qualify row_number() over (partition by query order by total desc, cid) <= 3""")
def n6_weighted_fusion(spark, sf_dir):
    c = U.combine(U.source_scores(_sources(spark, sf_dir)), {"A": 0.5, "N": 0.3, "R": 0.2})
    return c.filter("rank <= 3").select("query", "cid", F.round("total", 6).alias("total"))


@query(_SOURCES + """, a as (select query, score, row_number() over (partition by query order by score desc, cid) as rank from (select query, cid, max(score) as score from r group by 1, 2))
    select query, max(score) filter (rank = 1) as top, max(score) filter (rank = 1) - coalesce(max(score) filter (rank = 2), 0) as margin, max(score) filter (rank = 1) - max(score) filter (rank = 5) as spread from a group by 1""")
def e10_margins(spark, sf_dir):
    a = _sources(spark, sf_dir).groupBy("query", "cid").agg(F.max("score").alias("score"))
    return U.margins(U.rank_by(a, "score"), "score")


@query("""with t as (select p_partkey, p_name, unnest(list_distinct(string_split(p_name, ' '))) as token from part), f as (select token, ln((select count(*) + 1 from part) / (count(*) + 1.0)) + 1 as idf from t group by 1),
    w as (select distinct p_name, token, idf from t join f using (token)), n as (select p_name, sqrt(sum(idf * idf)) as n from w group by 1),
    s as (select a.p_name as x, b.p_name as y, sum(a.idf * b.idf) / (max(na.n) * max(nb.n)) as cosine from w a join w b using (token) join n na on na.p_name = a.p_name join n nb on nb.p_name = b.p_name group by 1, 2)
    select p_partkey as l, y as name, round(cosine, 6) as cosine from part join s on x = p_name where p_partkey % 50 = 0""")
def n11_weighted_cosine(spark, sf_dir):
    """Parts with an id divisible by 50 against all names; equal names are compared once."""
    p = table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    long = p.select("p_name", "tokens").distinct().select("p_name", F.explode(F.array_distinct("tokens")).alias("token"), F.lit(1.0).alias("w"))
    s = M.weighted_cosine(long.withColumnRenamed("p_name", "l"), long.withColumnRenamed("p_name", "r"), M.idf(p))
    asked = p.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("l"))
    return asked.join(s, "l").select(F.col("id").alias("l"), F.col("r").alias("name"), F.round("cosine", 6).alias("cosine"))


@query(_SOURCES + """, x as (select source, query, score, 1.0 / count(*) over (partition by source, query) as w from r), d as (select source, score, sum(w) as w from x group by 1, 2),
    c as (select source, score, sum(w) over (partition by source order by score) / sum(w) over (partition by source) as c from d)
    select source, min(score) filter (c >= .25 - 1e-12) as p25, min(score) filter (c >= .5 - 1e-12) as p50, min(score) filter (c >= .9 - 1e-12) as p90 from c group by 1""")
def d30_weighted_anchors(spark, sf_dir):
    return U.weighted_anchors(_sources(spark, sf_dir), "source", "query", "score", (0.25, 0.5, 0.9))


# ---- O: evaluation

def _decisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("source", (F.col("quality") == F.expr("case when n_chars > 1000 then 1 else 0 end")).alias("new_ok"), (F.col("quality") == 1).alias("old_ok"))


_DECISIONS = "with x as (select source, quality = (n_chars > 1000)::int as new_ok, quality = 1 as old_ok from documents join labels using (doc_id)) "


@query(_DECISIONS + "select source, count(*) as n, count(*) filter (new_ok) as exact, count(*) filter (new_ok and not old_ok) as fixed, count(*) filter (not new_ok and old_ok) as broken from x group by 1")
def d25_versus_baseline(spark, sf_dir):
    return E.versus_baseline(_decisions(spark, sf_dir), ["source"])


@query(_DECISIONS + "select round(avg(acc), 6) as macro_acc, count(*) as groups from (select source, avg(new_ok::int) as acc from x group by 1)")
def d26_macro(spark, sf_dir):
    m = E.macro(_decisions(spark, sf_dir).groupBy("source").agg(F.avg(F.col("new_ok").cast("int")).alias("acc")), "acc")
    return m.select(F.round("macro_acc", 6).alias("macro_acc"), "groups")


@query(_DECISIONS + """, g as (select source, count(*) filter (new_ok) >= count(*) filter (old_ok) as better from x group by 1) select bool_and(better) as all_better, count(*) filter (better) as better, count(*) as n from g""")
def o7_promotion_gate(spark, sf_dir):
    g = E.versus_baseline(_decisions(spark, sf_dir), ["source"]).withColumn("better", F.col("fixed") >= F.col("broken"))
    return g.agg(F.bool_and("better").alias("all_better"), F.count_if("better").alias("better"), F.count("*").alias("n"))


@query(_SOURCES + """, t as (select query, min(rank) filter (source = 'A' and cid % 3 = 0) as a, min(rank) filter (source = 'N' and cid % 3 = 0) as n from r group by 1),
    g as (select x * 10 + y as config, x, y from generate_series(1, 5) a(x), generate_series(1, 5) b(y)) select config, count(*) as n, count(*) filter (a <= x or n <= y) as found from t, g group by 1""")
def o3_pool_grid(spark, sf_dir):
    truth = F.col("cid") % 3 == 0
    at = lambda s: F.min(F.when((F.col("source") == s) & truth, F.col("rank")))
    t = _sources(spark, sf_dir).groupBy("query").agg(at("A").alias("a"), at("N").alias("n"))
    k = spark.range(1, 6)
    grid = k.withColumnRenamed("id", "a").crossJoin(k.withColumnRenamed("id", "n")).withColumn("config", F.col("a") * 10 + F.col("n"))
    return E.pool_recall_grid(t, grid, ["a", "n"])


@query("""with x as (select source as dataset, c as config, count(*) as n, count(*) filter ((n_chars > c * 400)::int = quality) as ok from documents join labels using (doc_id), generate_series(1, 8) g(c) group by 1, 2),
    i as (select x.*, round((sum(ok) over (partition by config) - ok) / greatest(sum(n) over (partition by config) - n, 1), 12) as others from x)
    select dataset, config, n, ok from i qualify row_number() over (partition by dataset order by others desc, config) = 1""")
def o6_leave_one_out(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("dataset"), "n_chars", "quality").agg(F.count("*").alias("c"))
    g = F.broadcast(spark.range(1, 9).withColumnRenamed("id", "config"))
    ok = (F.col("n_chars") > F.col("config") * 400).cast("int") == F.col("quality")
    per = d.crossJoin(g).groupBy("dataset", "config").agg(F.sum("c").alias("n"), F.sum(F.when(ok, F.col("c")).otherwise(0)).alias("ok"))
    return E.leave_one_out(per)


@query("""with r as (select source as dataset, n_chars as v, quality = 1 as t from documents join labels using (doc_id) where n_chars is not null and quality is not null), s as (select dataset, count(*) as n, sum(v)::double as s from r group by 1),
    f as (select o.dataset as outer_, j.dataset as judged, config, round(factor * ((select sum(s) from s) - o.s - case when o.dataset = j.dataset then 0 else j.s end) / nullif((select sum(n) from s) - o.n - case when o.dataset = j.dataset then 0 else j.n end, 0), 6) as cut
      from s o cross join s j cross join (select * from (values (0, .1), (1, .25), (2, .5), (3, .75), (4, 1.0), (5, 1.5), (6, 2.0)) g(config, factor))),
    m as (select outer_, judged, config, count(*) as n, count(*) filter ((v > cut) = t) as ok from f join r on r.dataset = f.judged group by all),
    h as (select outer_, config, round(avg(ok / n), 9) as inner_macro, sum(ok) as inner_ok from m where outer_ <> judged group by 1, 2), i as (select * from h qualify row_number() over (partition by outer_ order by inner_macro desc, inner_ok desc, config) = 1)
    select outer_ as dataset, config, round(inner_macro, 7) as inner_macro, m.n, m.ok from i join m using (outer_, config) where m.judged = outer_""")
def o6_nested_selection(spark, sf_dir):
    """Sources are the datasets; the classifier calls long documents good."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("dataset"), "n_chars", (F.col("quality") == 1).alias("good"))
    s = E.nested_selection(d, "dataset", "n_chars", "good", (0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0))
    return s.withColumn("inner_macro", F.round("inner_macro", 7))


@query()
def d36_bootstrap(spark, sf_dir):
    """Random draws, by 2,000 and by 10,000 resamples; tests hold them against a plain loop."""
    d = _decisions(spark, sf_dir).select("source", (F.col("new_ok").cast("int") - F.col("old_ok").cast("int")).alias("delta"))
    few, many = (E.bootstrap_delta(d, "source", "delta", n, 8101).withColumn("resamples", F.lit(n)) for n in (2000, 10_000))
    return few.union(many)


@query(_DECISIONS + "select source, count(*) as n, 2000::bigint as resamples, true as whole from x where new_ok is not null and old_ok is not null group by 1")
def d36_resample_sizes(spark, sf_dir):
    """Each of the 2,000 resamples of a source draws as many rows as it has."""
    d = _decisions(spark, sf_dir).select("source", (F.col("new_ok").cast("int") - F.col("old_ok").cast("int")).alias("delta"))
    return E.resample_means(d, "source", "delta", 2000, 8101).groupBy("source").agg(F.min("n").alias("n"), F.count("*").alias("resamples"), (F.min("n") == F.max("n")).alias("whole"))


@query(_SOURCES + """, h as (select query, count(distinct source) filter (rank <= 2 and cid % 3 = 0) as c, min(source) filter (rank <= 2 and cid % 3 = 0) as s from r group by 1) select s as source, count(*) as only_here from h where c = 1 group by 1""")
def d37_unique_contribution(spark, sf_dir):
    h = _sources(spark, sf_dir).filter("rank <= 2 and cid % 3 = 0").groupBy("query").agg(F.collect_set("source").alias("s")).filter("size(s) = 1")
    return h.groupBy(F.col("s")[0].alias("source")).agg(F.count("*").alias("only_here"))


# ---- P: dataset engineering

@query(_COS + "select query, id, row_number() over (partition by query order by score desc, id) as rank from r join embeddings e on e.vec_id = r.query where e.label <> r.label and r.rank <= 30 qualify row_number() over (partition by query order by score desc, id) <= 5")
def p3_hard_negatives(spark, sf_dir):
    member = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("label").alias("component"))
    h = D.without_forbidden(_hits(spark, sf_dir, 30), member)
    w = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return h.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("query", "id", "rank")


@query()
def p4_negative_sample(spark, sf_dir):
    """Three candidates of each query by a seeded hash; tests check counts and stability."""
    return D.negative_sample(_sources(spark, sf_dir).select("query", "cid").distinct(), "query", "cid", 3, 11)


@query("""select coalesce(exclusion, 'kept') as exclusion, count(*) as n from (select case when quality = 0 then 'low_quality' when toxic = 1 then 'toxic' when n_chars < 100 then 'short' end as exclusion from documents left join labels using (doc_id)) group by 1""")
def p2_exclusions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return D.exclusion_reasons(d, [("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("short", "n_chars < 100")]).groupBy(F.coalesce("exclusion", F.lit("kept")).alias("exclusion")).agg(F.count("*").alias("n"))


@query("""with q as (select quantile_cont(n_chars, .1) as p10, quantile_cont(n_chars, .25) as p25, quantile_cont(n_chars, .5) as p50, quantile_cont(n_chars, .75) as p75, quantile_cont(n_chars, .9) as p90 from documents)
    select round(p10, 4) as p10, round(p50, 4) as p50, round(p90, 4) as p90, count(*) as n, count(*) filter (n_chars < p25 - 1.5 * (p75 - p25) or n_chars > p75 + 1.5 * (p75 - p25)) as outliers from documents, q group by all""")
def p11_batch_summary(spark, sf_dir):
    s = D.batch_summary(table(spark, sf_dir, "documents"), "n_chars")
    return s.select(*[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")], "n", "outliers")
