"""Relational queries: scans, filters, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import datasets as D
from tessera.operators import evaluate as E
from tessera.operators import expect as X
from tessera.operators import match as M
from tessera.operators import merge as G
from tessera.operators import relational as R
from tessera.plans.registry import query
from tessera.session import table


@query("""
    with s as (select l_partkey, l_suppkey, least(l_extendedprice / 100000.0, 1.0) as score, l_orderkey, l_linenumber from lineitem),
    r as (select *, row_number() over (partition by l_partkey order by score desc, l_suppkey, l_orderkey, l_linenumber) as rn,
                 lead(score) over (partition by l_partkey order by score desc, l_suppkey, l_orderkey, l_linenumber) as next_score from s)
    select l_partkey, l_suppkey, round(score, 6) as score, round(score - coalesce(next_score, 0), 6) as gap
    from r where rn = 1 and score >= 0.5 and score - coalesce(next_score, 0) >= 0.001""")
def e1_safe_links(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber",
                                                F.least(F.col("l_extendedprice") / 100000.0, F.lit(1.0)).alias("score"))
    w = W.partitionBy("l_partkey").orderBy(F.desc("score"), "l_suppkey", "l_orderkey", "l_linenumber")
    r = s.withColumn("rn", F.row_number().over(w)).withColumn("gap", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return r.filter("rn = 1 and score >= 0.5 and gap >= 0.001").select(
        "l_partkey", "l_suppkey", F.round("score", 6).alias("score"), F.round("gap", 6).alias("gap"))


def _latest_orders(spark, sf_dir):
    return R.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


# ---- A: sources and flattening

@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def a4_json_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""select count(*) as raw_rows, count(distinct p_name) as canonical_rows, count(*) - count(distinct p_name) as duplicate_rows,
    (select count(*) from (select p_name from part group by p_name having count(distinct p_brand) > 1)) as conflicting from part""")
def a3_import_summary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    per = p.groupBy("p_name").agg(F.count("*").alias("c"), F.count_distinct("p_brand").alias("b"))
    return per.agg(F.sum("c").alias("raw_rows"), F.count("*").alias("canonical_rows"), (F.sum("c") - F.count("*")).alias("duplicate_rows"),
                   F.count_if(F.col("b") > 1).alias("conflicting"))


@query("""select p_partkey, p_name, p_brand from part qualify row_number() over (partition by p_name order by p_partkey) = 1""")
def a2_canonicalize_first(spark, sf_dir):
    first, _ = R.canonicalize_first(table(spark, sf_dir, "part"), "p_name", ["p_partkey"], ["p_brand", "p_type"])
    return first.select("p_partkey", "p_name", "p_brand")


@query("""select page_id, case when url like 'http%' then url else 'https://example.com/' || ltrim(url, '/') end as url,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages""")
def a6_url_repair(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://example.com/"), F.ltrim(u, F.lit("/")))).alias("url"),
                                                F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))


@query("""select reason, count(*) as n from (select 'short_text' as reason from documents where not coalesce(length(trim(text)) > 60, false)
    union all select 'unknown_lang' from documents where not coalesce(lang in ('en', 'de', 'fr'), false)) group by reason""")
def a7_rejected_rows(spark, sf_dir):
    _, bad = R.split_valid(table(spark, sf_dir, "documents"), {"short_text": F.length(F.trim("text")) > 60, "unknown_lang": F.col("lang").isin("en", "de", "fr")})
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, length(regexp_replace(html, '[^<]', '', 'g')) as tags,
    len(regexp_extract_all(html, '<p>')) as paragraphs from pages""")
def a11_page_fields(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
                                                F.length(F.regexp_replace("html", "[^<]", "")).cast("long").alias("tags"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@query("""with l as (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages)
    select href, count(*) as links, count(distinct page_id) as pages, min(page_id) as first_page from l group by href""")
def a13_link_discovery(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


@query("""select case when b.p_brand is null then 'miss' else 'hit' end as plan, count(*) as n from part a left join
    (select distinct p_brand from part where p_size < 3) b on a.p_brand = b.p_brand group by 1""")
def a20_reuse_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hit, miss = D.reuse_plan(p.filter("p_size < 3"), p, "p_brand")
    return hit.select(F.lit("hit").alias("plan")).union(miss.select(F.lit("miss").alias("plan"))).groupBy("plan").agg(F.count("*").alias("n"))


@query("""select o_custkey, count(*) as n_orders, string_agg(o_orderkey || ':' || o_orderstatus, ',' order by o_orderkey) as orders from orders group by o_custkey""")
def a23_nested_document(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    return g.select("o_custkey", "n_orders", F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), ",").alias("orders"))


@query("""with k as (select p_partkey, lower(p_type) || '-' || p_size as key from part), r as (select a.p_partkey, b.p_partkey as other,
    row_number() over (partition by a.p_partkey order by b.p_partkey) as rn from k a join k b on a.key = b.key and a.p_partkey <> b.p_partkey)
    select p_partkey, count(*) as n, min(other) as first_other from r where rn <= 20 group by p_partkey""")
def a26_replacements(spark, sf_dir):
    k = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("-"), F.col("p_size")).alias("key"))
    # the first 21 of each key hold the first 20 others of every member, in one row a key
    head = R.first_per_key(k, "key", ["p_partkey"], 21).groupBy("key").agg(F.collect_list("p_partkey").alias("head"))
    others = k.join(head, "key").select("p_partkey", F.filter("head", lambda x: x != F.col("p_partkey")).alias("o")).filter(F.size("o") > 0)
    return others.groupBy("p_partkey").agg(F.least(F.lit(20), F.sum(F.size("o"))).cast("long").alias("n"), F.min(F.array_min("o")).alias("first_other"))


# ---- B: filters, search, pages

@query("""select p_partkey, p_name from part where p_name ilike '%red%' or p_brand ilike '%red%' or p_type ilike '%red%'""")
def b1_search(spark, sf_dir):
    return R.search(table(spark, sf_dir, "part"), "red", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("""select p_partkey, p_name from part where (p_name ilike '%bolt%') and p_type = 'ECONOMY' and p_size > 10""")
def b2_filtered_search(spark, sf_dir):
    return R.search(table(spark, sf_dir, "part"), "bolt", ["p_name"]).filter("p_type = 'ECONOMY' and p_size > 10").select("p_partkey", "p_name")


@query("""select d.doc_id from documents d left join labels l using (doc_id) where l.doc_id is null order by d.doc_id limit 100""")
def b3_worklist(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id").orderBy("doc_id").limit(100)


@query("""select event_id from events where event_type = 'error' and value > 100""")
def b4_retry_worklist(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'error' and value > 100").select("event_id")


@query("""select lang, count(*) filter (length(trim(text)) > 0) as present, count(*) as n from documents group by lang""")
def b6_presence(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(R.present("text")).alias("present"), F.count("*").alias("n"))


@query("""select o_orderkey from orders where exists (select 1 from (values ('1-'), ('2-')) t(p) where contains(o_orderpriority, p))""")
def b8_like_any(spark, sf_dir):
    terms = F.array(F.lit("1-"), F.lit("2-"))
    return table(spark, sf_dir, "orders").filter(F.exists(terms, lambda t: F.contains("o_orderpriority", t))).select("o_orderkey")


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'final' when o_orderpriority like '1%' then 'urgent' when o_totalprice > 400000 then 'needs_review' else 'open' end as status from orders""")
def b11_derived_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderpriority").startswith("1"), "urgent").when(
        F.col("o_totalprice") > 400000, "needs_review").otherwise("open").alias("status"))


@query("""select o_orderkey, o_totalprice, (select count(*) from orders where o_orderstatus = 'O') as total from orders where o_orderstatus = 'O'
    order by o_totalprice desc, o_orderkey limit 50 offset 100""")
def b12_page_with_total(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return R.page(o, [F.desc("o_totalprice"), "o_orderkey"], 50, 100).select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))


@query("""select doc_id, coalesce(nullif(source, ''), lang, cast(doc_id as varchar)) as source_key from documents""")
def b13_source_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif("source", F.lit("")), "lang", F.col("doc_id").cast("string")).alias("source_key"))


# ---- C: joins

@query("""select n_name, count(*) as suppliers, round(sum(s_acctbal), 2) as balance from supplier join nation on s_nationkey = n_nationkey group by n_name""")
def c1_inner_join(spark, sf_dir):
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""select count(*) as rows, count(o_custkey) as joined, count(*) - count(o_custkey) as not_joined from customer left join (select distinct o_custkey from orders) on c_custkey = o_custkey""")
def c2_referential_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").agg(
        F.count("*").alias("rows"), F.count("o_custkey").alias("joined"), (F.count("*") - F.count("o_custkey")).alias("not_joined"))


@query("""select r_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey
    join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""")
def c3_multiway_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return (t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("r_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")))


@query("""with u as (select l_partkey from lineitem group by l_partkey having count(distinct l_suppkey) <= 20) select p_partkey, p_name from part join u on p_partkey = l_partkey""")
def c5_few_others(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("c")).filter("c <= 20")
    return table(spark, sf_dir, "part").join(u, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("""select c_custkey, o_orderkey from customer left join (select o_custkey, o_orderkey from orders qualify row_number() over
    (partition by o_custkey order by (o_orderstatus = 'F') desc, o_orderkey) = 1) on c_custkey = o_custkey""")
def c6_preferred_child(spark, sf_dir):
    o = R.first_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.desc(F.col("o_orderstatus") == "F"), "o_orderkey"]).select("o_custkey", "o_orderkey")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def c7_latest_per_key(spark, sf_dir):
    return _latest_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""select n_nationkey, n_name, coalesce(string_agg(s_suppkey::varchar, ',' order by s_suppkey), '') as suppliers from nation left join supplier on s_nationkey = n_nationkey group by all""")
def c8_children_arrays(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    d = R.with_children(table(spark, sf_dir, "nation"), s, "n_nationkey", ["s_suppkey"], "c")
    return d.select("n_nationkey", "n_name", F.coalesce(F.array_join(F.transform("c", lambda x: x["s_suppkey"].cast("string")), ","), F.lit("")).alias("suppliers"))


@query("""select a.n as documents, b.n as pages from (select count(*) as n from documents) a, (select count(*) as n from pages) b""")
def c9_one_row_cross(spark, sf_dir):
    one = lambda t: table(spark, sf_dir, t).agg(F.count("*").alias(t))
    return one("documents").crossJoin(one("pages"))


@query("""with a as (select p_partkey as id, p_name as v from part union all select p_partkey, p_brand || ' ' || p_type from part),
    k as (select v, count(distinct id) as n from a group by v having count(distinct id) > 1) select v as alias, n as owners from k""")
def c14_alias_collisions(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array("p_name", F.concat_ws(" ", "p_brand", "p_type"))).alias("alias"))
    return a.groupBy("alias").agg(F.count_distinct("p_partkey").alias("owners")).filter("owners > 1")


@query("""with r as (select p_name as k1, p_brand as k2, min(p_partkey) as m, count(*) as c from part where p_size >= 25 group by all),
    l as (select p_partkey, p_name, p_brand from part where p_size < 25),
    s1 as (select l.*, r.m, r.c from l left join r on p_name = k1 and p_brand = k2),
    n as (select p_name as k1, min(p_partkey) as m, count(*) as c from part where p_size >= 25 group by 1),
    s2 as (select s1.p_partkey, n.m, n.c from s1 left join n on s1.p_name = n.k1 where s1.c is null)
    select stage, count(*) as n from (select case when c = 1 then 'exact' else 'ambiguous' end as stage from s1 where c is not null
    union all select case when c = 1 then 'name' when c > 1 then 'ambiguous' else 'missing' end from s2) group by stage""")
def c15_waterfall(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("full", F.concat_ws("|", "p_name", "p_brand"))
    right = p.filter("p_size >= 25").select(F.col("p_partkey").alias("rid"), "full", "p_name")
    return M.resolve_waterfall(p.filter("p_size < 25").select("p_partkey", "full", "p_name"), right, "p_partkey", "rid", [("exact", "full"), ("name", "p_name")]).groupBy("stage").agg(F.count("*").alias("n"))


@query("""with t as (select p_partkey, unnest(string_split(p_name, ' ')) as token from part), d as (select unnest(string_split('red blue bolt gear', ' ')) as token)
    select t.token, case when d.token is null then 'no_match' else 'match' end as state, count(*) as n from t left join d on t.token = d.token group by all""")
def c17_dictionary_join(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token"))
    d = spark.createDataFrame([("red",), ("blue",), ("bolt",), ("gear",)], "d string")
    return t.join(F.broadcast(d), F.col("token") == F.col("d"), "left").select("token", F.when(F.col("d").isNull(), "no_match").otherwise("match").alias("state")).groupBy(
        "token", "state").agg(F.count("*").alias("n"))


@query("""select o_orderkey, case when o_orderstatus = 'F' and not coalesce(x.late, false) then 'keep' else 'check' end as decision from orders left join
    (select l_orderkey, bool_or(l_returnflag = 'R') as late from lineitem group by l_orderkey) x on l_orderkey = o_orderkey""")
def c26_conflict_join(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("late"))
    return table(spark, sf_dir, "orders").join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.when((F.col("o_orderstatus") == "F") & ~F.coalesce("late", F.lit(False)), "keep").otherwise("check").alias("decision"))


@query("""with s as (select user_id, min(ts) as since from events where event_type = 'signup' group by user_id)
    select e.user_id, count(*) as n from events e left join s using (user_id) where e.event_type <> 'signup' and e.ts >= coalesce(s.since, timestamp '1970-01-01') group by e.user_id""")
def c29_since_start(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("since"))
    return e.filter("event_type <> 'signup'").join(s, "user_id", "left").filter(F.col("ts") >= F.coalesce("since", F.expr("timestamp '1970-01-01'"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""with o as (select p_partkey, p_size from part where p_partkey % 7 <> 0), n as (select p_partkey, case when p_partkey % 5 = 0 then p_size + 1 else p_size end as p_size from part where p_partkey % 11 <> 0)
    select case when o.p_partkey is null then 'added' when n.p_partkey is null then 'removed' when o.p_size = n.p_size then 'same' else 'changed' end as change, count(*) as n
    from o full join n on o.p_partkey = n.p_partkey group by 1""")
def c30_snapshot_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    new = p.filter("p_partkey % 11 <> 0").withColumn("p_size", F.expr("case when p_partkey % 5 = 0 then p_size + 1 else p_size end"))
    return G.snapshot_diff(p.filter("p_partkey % 7 <> 0"), new, "p_partkey", "p_size").groupBy("change").agg(F.count("*").alias("n"))


@query("""select conv_id, count(*) as turns, max(turn) as last_turn, count(distinct role) as roles from conversations group by conv_id""")
def c33_track_list(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last_turn"), F.count_distinct("role").alias("roles"))


# ---- D: aggregates

@query("""select count(*) as total, count(text) filter (length(text) > 0) as with_text, count(*) filter (text is null or text = '') as without_text, max(n_chars) as longest from documents""")
def d1_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.count_if(F.length("text") > 0).alias("with_text"),
                                                 F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("without_text"), F.max("n_chars").alias("longest"))


@query("""select o_orderstatus as status, count(*) as n from orders group by 1""")
def d2_status_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""select coalesce(n_name, 'UNKNOWN') as name, count(*) as n from customer left join nation on c_nationkey = n_nationkey and n_nationkey % 5 <> 0 group by 1 order by n desc, name limit 10""")
def d3_top_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0")
    j = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy(F.coalesce("n_name", F.lit("UNKNOWN")).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query("""select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty, round(sum(l_extendedprice), 2) as price, round(avg(l_discount), 6) as disc,
    count(*) filter (l_tax = 0) as untaxed, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from lineitem group by 1, 2""")
def d4_qa_profile(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("disc"),
        F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("""select (select count(*) from documents) as documents, (select count(*) from labels where quality = 1) as good, (select count(distinct conv_id) from conversations) as conversations,
    (select count(*) from benchmark) as benchmark""")
def d5_release_snapshot(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    out = t("documents").agg(F.count("*").alias("documents"))
    for x in (t("labels").agg(F.count_if(F.col("quality") == 1).alias("good")), t("conversations").agg(F.count_distinct("conv_id").alias("conversations")), t("benchmark").agg(F.count("*").alias("benchmark"))):
        out = out.crossJoin(x)
    return out


@query("""select event_type, count(value) as n, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean from events group by event_type""")
def d6_rating_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@query("""select l_returnflag as method, count(*) as n, count(distinct l_partkey) as parts, count(*) filter (l_discount >= .085) as high, count(*) filter (l_discount >= .07 and l_discount < .085) as mid,
    count(*) filter (l_discount < .07) as low from lineitem group by 1""")
def d7_confidence_bands(spark, sf_dir):
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(
        F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.count_if(d >= 0.085).alias("high"), F.count_if((d >= 0.07) & (d < 0.085)).alias("mid"), F.count_if(d < 0.07).alias("low"))


@query("""select p_name, count(*) as n, count(distinct p_brand) as brands from part group by p_name having count(distinct p_brand) > 1""")
def d9_duplicates_having(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands")).filter("brands > 1")


@query("""select o_orderpriority, count(*) as n, round(floor(1000.0 * count(*) filter (o_orderstatus = 'F') / count(*) + 0.5) / 10, 1) as pct_final,
    round(floor(1000.0 * count(*) filter (o_orderstatus = 'O') / count(*) + 0.5) / 10, 1) as pct_open from orders group by 1""")
def d12_percent_summary(spark, sf_dir):
    pct = lambda s: F.round(F.floor(1000.0 * F.count_if(F.col("o_orderstatus") == s) / F.count("*") + 0.5) / 10, 1)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), pct("F").alias("pct_final"), pct("O").alias("pct_open"))


@query("""with p as (select conv_id, count(distinct turn) filter (role = 'user') as asked, count(distinct turn) filter (role = 'assistant') as answered, bool_or(role = 'system') as has_system from conversations group by conv_id)
    select conv_id, asked, answered, has_system::int + (answered >= asked)::int as done, case when answered < asked then 'answer' when not has_system then 'system' else 'none' end as next_stage from p""")
def d13_stage_progress(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    at = lambda r: F.count_distinct(F.when(F.col("role") == r, F.col("turn")))
    p = c.groupBy("conv_id").agg(at("user").alias("asked"), at("assistant").alias("answered"), F.bool_or(F.col("role") == "system").alias("s"))
    return p.select("conv_id", "asked", "answered", (F.col("s").cast("int") + (F.col("answered") >= F.col("asked")).cast("int")).alias("done"),
                    F.when(F.col("answered") < F.col("asked"), "answer").when(~F.col("s"), "system").otherwise("none").alias("next_stage"))


@query("""select o_custkey, bool_and(o_orderstatus <> 'P') as all_settled, bool_or(o_orderpriority like '1%') as any_urgent, count(*) as n,
    case when bool_and(o_orderstatus = 'F') then 'done' when bool_or(o_orderstatus = 'F') then 'partly' else 'open' end as mode from orders group by o_custkey""")
def d14_rollup_flags(spark, sf_dir):
    f = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.bool_and(F.col("o_orderstatus") != "P").alias("all_settled"), F.bool_or(F.col("o_orderpriority").startswith("1")).alias("any_urgent"), F.count("*").alias("n"),
        F.when(F.bool_and(f), "done").when(F.bool_or(f), "partly").otherwise("open").alias("mode"))


@query("""select conv_id, string_agg(role || '=' || n, ',' order by role) as modes from (select conv_id, role, count(*) as n from conversations group by all) group by conv_id""")
def d15_map_aggregate(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n")).groupBy("conv_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("m"))
    return g.select("conv_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("modes"))


@query("""select p_type, count(*) filter (k = 'small') as small, count(*) filter (k = 'large') as large, count(*) filter (k = 'listed') as listed from
    (select p_type, case when p_size < 25 then 'small' else 'large' end as k from part union all select p_type, 'listed' from part) group by p_type""")
def d16_status_overlay_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    u = p.select("p_type", F.when(F.col("p_size") < 25, "small").otherwise("large").alias("k")).union(p.select("p_type", F.lit("listed").alias("k")))
    return u.groupBy("p_type").pivot("k", ["small", "large", "listed"]).agg(F.count(F.lit(1))).select("p_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("small", "large", "listed")])


@query("""select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as tags from orders where o_orderstatus = 'O' group by 1""")
def d18_distinct_tags(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("tags"))


@query("""select p_brand, string_agg(token, ' ' order by token) as keywords from (select distinct p_brand, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) as token from part) group by p_brand""")
def d20_keyword_set(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("token"))
    return t.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("keywords"))


@query("""select sha256(text) as digest, count(*) as size, min(doc_id) as first from documents where text is not null group by 1 having count(*) > 1""")
def d21_duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("digest", F.sha2("text", 256))
    return D.duplicate_groups(d, "doc_id", "digest")


@query("""with recursive p as (select doc_id, sha256(text) as a, source || ':' || n_chars as b from documents),
    e as (select x.doc_id as u, y.f as v from p x join (select a, min(doc_id) as f from p group by a) y on x.a = y.a union select x.doc_id, y.f from p x join (select b, min(doc_id) as f from p group by b) y on x.b = y.b),
    s as (select u, v from e union select v, u from e), r as (select doc_id as n, doc_id as c from p union select s.u, r.c from r join s on s.v = r.n where r.c < s.u)
    select n as node, min(c) as component from r group by n having n in (select u from s where u <> v)""")
def d22_components(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("a"), F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("b"))
    return D.ambiguity_components(d, "doc_id", ["a", "b"])


@query("""select token, count(distinct p_partkey) as df, round(ln((select count(*) + 1 from part) / (count(distinct p_partkey) + 1.0)) + 1, 6) as idf
    from (select p_partkey, unnest(string_split(p_name, ' ')) as token from part) group by token""")
def d31_idf(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("tokens", F.split("p_name", " "))
    return M.idf(p).select("token", "df", F.round("idf", 6).alias("idf"))


@query("""select event_type, count(value) as n, min(value) as min, round(quantile_cont(value, .05), 6) as p05, round(quantile_cont(value, .25), 6) as p25, round(quantile_cont(value, .5), 6) as p50,
    round(quantile_cont(value, .75), 6) as p75, round(quantile_cont(value, .95), 6) as p95, max(value) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from events group by 1""")
def d28_distribution(spark, sf_dir):
    d = E.distribution(table(spark, sf_dir, "events"), "value", ["event_type"])
    return d.select("event_type", "n", "min", *[F.round(c, 6).alias(c) for c in ("p05", "p25", "p50", "p75", "p95")], "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("""select user_id, case when count(distinct event_type) > 1 then 'hybrid' else min(event_type) end as actor, min_by(event_type, (ts, event_id)) as first_actor,
    max_by(event_type, (ts, event_id)) as last_actor from events group by user_id""")
def d47_actor_rollup(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(F.count_distinct("event_type") > 1, "hybrid").otherwise(F.min("event_type")).alias("actor"),
                                                               F.min_by("event_type", at).alias("first_actor"), F.max_by("event_type", at).alias("last_actor"))


@query("""with q as (select source, lang, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents)
    select doc_id, source, rn from q where rn <= 5""")
def d42_round_robin(spark, sf_dir):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("doc_id", "source", F.col("rn").cast("long").alias("rn"))


@query("""select coalesce(lang, 'all') as lang, coalesce(source, 'all') as source, count(*) as n from documents group by rollup (lang, source)""")
def d5_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n")).select(
        F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n")


# ---- E, F: windows and top-k

@query("""select initial, p_partkey from (select p_partkey, upper(substr(trim(p_name), 1, 1)) as initial, row_number() over (partition by upper(substr(trim(p_name), 1, 1)) order by lower(p_name), p_partkey) as rn from part) where rn <= 5""")
def e2_top_by_initial(spark, sf_dir):
    return R.top_by_initial(table(spark, sf_dir, "part"), "p_name", "p_partkey", 5).select("initial", "p_partkey")


@query("""select conv_id, role, turn from conversations qualify row_number() over (partition by conv_id, role order by turn desc) = 1""")
def e6_latest_per_stage(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.desc("turn")]).select("conv_id", "role", "turn")


@query("""select c_custkey, coalesce(max(o), 0) + 1 as next_version from customer left join (select o_custkey, count(*) as o from orders group by 1) on c_custkey = o_custkey group by 1""")
def e8_next_version(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("o"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (F.coalesce("o", F.lit(0)) + 1).alias("next_version"))


@query("""select l_orderkey, l_linenumber, l_partkey, round((l_quantity - min(l_quantity) over w) / nullif(max(l_quantity) over w - min(l_quantity) over w, 0), 9) as scaled from lineitem window w as (partition by l_partkey)""")
def e11_minmax(spark, sf_dir):
    w = W.partitionBy("l_partkey")
    lo, hi = F.min("l_quantity").over(w), F.max("l_quantity").over(w)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_quantity") - lo) / F.nullif(hi - lo, F.lit(0.0)), 9).alias("scaled"))


@query("""select event_id, round(cume_dist() over (partition by event_type order by value), 9) as pct from events""")
def e12_percentile_rank(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(F.cume_dist().over(W.partitionBy("event_type").orderBy("value")), 9).alias("pct"))


@query("""select event_id, user_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as seq, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 2) as running from events""")
def e17_running_sum(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.count("*").over(w).alias("seq"), F.round(F.sum("value").over(w), 2).alias("running"))


@query("""select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem where l_discount >= .05) where rn <= 5""")
def f2_threshold_topk(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "lineitem").filter("l_discount >= .05"), "l_partkey", [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""select o_orderkey, hits from (select o_orderkey, o_orderdate, (contains(o_orderpriority, 'URGENT'))::int + (o_orderstatus = 'O')::int + (o_totalprice > 300000)::int as hits from orders) order by hits desc, o_orderdate desc, o_orderkey limit 200""")
def f5_relevance_order(spark, sf_dir):
    hits = F.contains("o_orderpriority", F.lit("URGENT")).cast("int") + (F.col("o_orderstatus") == "O").cast("int") + (F.col("o_totalprice") > 300000).cast("int")
    return table(spark, sf_dir, "orders").withColumn("hits", hits).orderBy(F.desc("hits"), F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "hits")


@query("""select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as rn, count(*) over (partition by source) as n from documents) where rn = 1 or rn = n // 2 + 1""")
def f9_systematic_sample(spark, sf_dir):
    w = W.partitionBy("source")
    d = table(spark, sf_dir, "documents").withColumn("rn", F.row_number().over(w.orderBy("doc_id"))).withColumn("n", F.count("*").over(w))
    return d.filter("rn = 1 or rn = n div 2 + 1").select("source", "doc_id")


# ---- G, H: sets and merges

@query("""select c_custkey as id, c_name as name, c_mktsegment as segment, 'customer' as kind from customer union all select s_suppkey, s_name, null, 'supplier' from supplier""")
def g1_union_catalog(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return R.union_aligned(c, s)


@query("""select distinct doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')""")
def g3_unknown_keys(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").distinct().join(table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id", "left_anti")


@query("""with k as (select coalesce(a.k, b.k) as key, a.k is null as missing, b.k is null as extra from (select distinct l_partkey as k from lineitem) a full join (select p_partkey as k from part where p_size > 3) b on a.k = b.k)
    select key, case when missing then 'missing' else 'extra' end as state from k where missing or extra""")
def g4_equal_sets(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    b = table(spark, sf_dir, "part").filter("p_size > 3").select(F.col("p_partkey").alias("key"))
    return b.join(a, "key", "left_anti").select("key", F.lit("missing").alias("state")).union(a.join(b, "key", "left_anti").select("key", F.lit("extra").alias("state")))


@query("""select l_partkey, sources, round(fusion, 9) as fusion from (select l_partkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as sources, sum(1.0 / (60 + l_linenumber)) as fusion from lineitem where l_linenumber <= 3 group by l_partkey)""")
def g6_nominations(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("sources"),
                                                                                         F.round(F.sum(1.0 / (60 + F.col("l_linenumber"))), 9).alias("fusion"))
    return g.select("l_partkey", "sources", "fusion")


@query("""select doc_id, text from (select doc_id, 'reviewed' as text from labels where quality = 1 union all select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1))""")
def g8_reviewed_layer(spark, sf_dir):
    r = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit("reviewed").alias("text"))
    return G.reviewed_over_generated(r, table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("text")), "doc_id")


@query("""select coalesce(b.k, d.k) as k, case when d.k is not null then d.v else b.v end as v, b.w as w from (select c_custkey as k, c_nationkey as v, c_mktsegment as w from customer) b
    full join (select o_custkey as k, cast(count(*) as int) as v from orders group by 1) d on b.k = d.k""")
def h1_upsert(spark, sf_dir):
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"), F.col("c_mktsegment").alias("w"))
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("int").alias("v"))
    return G.merge_upsert(b, d, ["k"], ["v"])


@query("""select p_partkey, p_name, coalesce(case when p_size > 45 then 'OVERRIDE' end, p_type) as p_type from part""")
def h5_overlay(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    over = table(spark, sf_dir, "part").filter("p_size > 45").select("p_partkey", F.lit("OVERRIDE").alias("p_type"))
    return G.overlay(p, over, "p_partkey", ["p_type"])


@query("""select status, count(*) as n from (select case when p_brand = 'Brand#1' then 'pending' when p_brand = 'Brand#2' then 'identical' else 'stale' end as status from part) group by status""")
def h6_guarded_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    plan = p.select("p_partkey", F.lit("Brand#1").alias("expected"), F.lit("Brand#2").alias("replacement"))
    return G.guarded_status(p, plan, "p_partkey", "p_brand").groupBy("status").agg(F.count("*").alias("n"))


@query("""select p_partkey from part where p_size % 3 = 0 or p_partkey % 10 = 0""")
def h10_changed_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    new = p.withColumn("p_size", F.expr("case when p_size % 3 = 0 then p_size + 1 else p_size end"))
    return G.changed_rows(p.filter("p_partkey % 10 <> 0"), new, "p_partkey", ["p_size"]).select("p_partkey")


@query("""select d.doc_id, coalesce(case l.quality when 1 then 'kept' when 0 then 'rejected' end, 'pending') as decision from documents d left join labels l using (doc_id)""")
def h14_carry_forward(spark, sf_dir):
    prior = table(spark, sf_dir, "labels").select("doc_id", F.expr("case quality when 1 then 'kept' when 0 then 'rejected' end").alias("decision"))
    return G.carry_forward(prior, table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("decision")), "doc_id", "decision")


# ---- Q: expectations

@query("""select 'duplicate_names' as "check", count(*) as broken from (select p_name from part group by 1 having count(*) > 1) union all select 'orphans', count(*) from orders where o_custkey not in (select c_custkey from customer where c_nationkey > 3)
    union all select 'vocabulary', count(*) from orders where o_orderstatus not in ('F', 'O') union all select 'range', count(*) from lineitem where l_quantity < 2 or l_quantity > 49
    union all select 'required', 0 union all select 'conflicts', count(*) from (select p_name from part group by 1 having count(distinct p_type) > 1)""")
def q1_expectations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return X.check(duplicate_names=X.unique(t("part"), "p_name"), orphans=X.references(t("orders"), "o_custkey", t("customer").filter("c_nationkey > 3"), "c_custkey"),
                   vocabulary=X.in_vocabulary(t("orders"), "o_orderstatus", ["F", "O"]), range=X.finite_between(t("lineitem"), "l_quantity", 2, 49),
                   required=X.required_when(t("lineitem"), "l_shipdate", "l_linestatus = 'F'"), conflicts=X.conflicting(t("part"), "p_name", "p_type"))


@query("select count(*) as broken from orders where o_orderstatus not in ('F', 'O')")
def q2_vocabulary(spark, sf_dir):
    return X.in_vocabulary(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).agg(F.count("*").alias("broken"))


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey > 3)")
def q3_references(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").filter("c_nationkey > 3")
    return X.references(table(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_quantity < 2 or l_quantity > 49")
def q5_range(spark, sf_dir):
    return X.finite_between(table(spark, sf_dir, "lineitem"), "l_quantity", 2, 49).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select doc_id from documents left join labels using (doc_id) where n_chars > 500 and quality is null")
def q6_required_when(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return X.required_when(d, "quality", "n_chars > 500").select("doc_id")


@query("select p_name, count(distinct p_type) as versions from part group by 1 having count(distinct p_type) > 1")
def q7_conflicts(spark, sf_dir):
    return X.conflicting(table(spark, sf_dir, "part"), "p_name", "p_type").select("p_name", "versions")
