"""Text keys, aliases, lexical matches and catalog searches.  Items are the distinct (name, brand) pairs of parts, so equal texts are compared once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evidence as EV
from tessera.operators import lexical as L
from tessera.operators import resolve as R
from tessera.plans.registry import query
from tessera.session import table

_ITEMS = """with items as (select min(p_partkey) as id, p_name as title, lower(p_brand) as maker, lower(min(p_type)) as type, split_part(p_name, ' ', 1) as category,
    'r' || (substr(p_brand, 7)::int % 5) as region, min(p_size) as size, count(*) as n from part group by p_name, p_brand) """


def _items(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id"), F.lower(F.min("p_type")).alias("type"), F.min("p_size").alias("size"), F.count("*").alias("n"))
    return g.select("id", F.col("p_name").alias("title"), F.lower("p_brand").alias("maker"), "type", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("category"),
                    F.concat(F.lit("r"), (F.expr("int(substr(p_brand, 7))") % 5).cast("string")).alias("region"), "size", "n")


# ---- I: keys and forms

@query()
def i13_ratio(spark, sf_dir):
    """Not in SQL; tests compare it with the standard library.  Pairs share a word, distinct titles are compared once."""
    t = _items(spark, sf_dir).select("title").distinct().withColumn("w", F.explode(F.split("title", " ")))
    p = t.join(t.select(F.col("title").alias("other"), "w"), "w").filter("title <= other").select("title", "other").distinct()
    return p.select("title", "other", F.round(T.ratio("title", "other"), 6).alias("ratio"))


@query(_ITEMS + """, f as (select id, title || ' ' || maker as t from items), w as (select id, string_split(regexp_replace(regexp_replace(t, '[^a-z0-9 -]', ' ', 'g'), ' +', ' ', 'g'), ' ') as w from f),
    e as (select id, unnest(list_concat(w, list_concat([translate(x, 'авеёкмнорстухі', 'abeekmhopctyxi') for x in w], [translate(x, 'abeekmhopctyxi', 'авеёкмнорстухі') for x in w]))) as x from w)
    select id, string_agg(distinct x, ' ' order by x) as forms from e where length(x) >= 1 group by 1""")
def i20_search_forms(spark, sf_dir):
    f = _items(spark, sf_dir).select("id", F.explode(F.split(T.search_forms("title", "maker"), " ")).alias("x"))
    return f.filter("length(x) >= 1").groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("x")), " ").alias("forms"))


@query("""select p_partkey, replace(p_name, ' ', '-') || '-' || p_size as key from part""")
def i22_filename_key(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("/media/x/"), "p_name", F.lit(" №"), F.col("p_size").cast("string"), F.lit("_"), F.substring(F.md5("p_name"), 1, 10), F.lit(".PNG?v=1"))
    return p.select("p_partkey", T.filename_key(name).alias("key"))


_ALIASES = _ITEMS + """, a as (select id, title as value, 'normalized-title' as type, 1.0 as weight from items union all select id, regexp_replace(title, '\\b(old|new)\\b', '', 'g'), 'title-without-service-words', .95 from items union all
    select id, replace(maker, '#', ' '), 'manufacturer', .85 from items union all select id, category, 'category', .45 from items union all select id, region, 'region', .4 from items union all
    select id, (1950 + size)::varchar, 'year', .25 from items), b as (select id, trim(value) as value, type, weight from a where trim(value) <> '') """


def _aliases(spark, sf_dir):
    i = _items(spark, sf_dir)
    made = T.aliases("title", "maker", "category", "region", F.col("size") + 1950, F.lit(None).cast("string"), ("old", "new"))
    return i.select("id", F.explode(made).alias("a")).select("id", "a.value", "a.type", "a.weight")


@query(_ALIASES + "select id, value, type, weight::double as weight from b")
def i24_aliases(spark, sf_dir):
    return _aliases(spark, sf_dir)


@query(_ALIASES + "select value, max(weight)::double as score, count(distinct id) as items, min(id) as first from b group by 1")
def i25_alias_merge(spark, sf_dir):
    return _aliases(spark, sf_dir).groupBy("value").agg(F.max("weight").alias("score"), F.count_distinct("id").alias("items"), F.min("id").alias("first"))


@query(_ITEMS + """, w as (select id, string_split(title || ' ' || type || ' ' || title, ' ') as w from items), h as (select id, w, case when title in ('red bolt', 'hot gear') then [title, title] else list_filter([w[2], w[5]], lambda x: x in ('bolt', 'gear')) end as p
    from w join items using (id)) select id, array_to_string(p, ',') as phrases from h""")
def i26_phrases(spark, sf_dir):
    t = _items(spark, sf_dir).select("id", F.split(F.concat_ws(" ", "title", "type", "title"), " ").alias("w"))
    hits = T.recognise_phrases("w", ("bolt", "gear", "red bolt", "hot gear", "red bolt tail"))
    return t.select("id", F.array_join(F.transform(hits, lambda x: x["phrase"]), ",").alias("phrases"))


# ---- J, K: maps and rounding

@query("""select p_partkey, p_name as name, case when p_size % 2 = 0 then p_type else p_brand end as kind, case when p_size % 3 = 0 then 'big' end as extra from part""")
def j3_merge_objects(spark, sf_dir):
    base = F.create_map(F.lit("name"), F.col("p_name"), F.lit("kind"), F.col("p_brand"))
    over = F.map_filter(F.create_map(F.lit("kind"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit("extra"), F.when(F.col("p_size") % 3 == 0, F.lit("big"))), lambda k, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    d = table(spark, sf_dir, "part").select("p_partkey", F.map_concat(kept, over).alias("m"))
    return d.select("p_partkey", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("name", "kind", "extra")])


@query("""select a.p_partkey, array_to_string(list_filter([case when a.p_brand <> b.p_brand then 'brand' end, case when a.p_name <> b.p_name then 'name' end, case when a.p_size % 5 <> b.p_size % 5 then 'size' end], lambda x: x is not null), ',') as changed
    from part a join part b on b.p_partkey = a.p_partkey + 1""")
def j6_changed_paths(spark, sf_dir):
    m = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("size"), (F.col("p_size") % 5).cast("string"))
    a = table(spark, sf_dir, "part").select("p_partkey", m.alias("a"))
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", F.array_join(T.changed_paths("a", "b"), ",").alias("changed"))


_STAGES = ("priced", "picked", "shipped", "closed")


@query("""with o as (select o_orderkey, o_totalprice, o_orderstatus, count(l_orderkey) as n, max(l_shipdate) as ship from orders left join lineitem on l_orderkey = o_orderkey group by all),
    s as (select o_orderkey, 'priced' as stage, round(o_totalprice, 2)::varchar is not null as there, null as reason from o union all select o_orderkey, 'picked', n > 0, case when n = 0 then 'NO_LINES' end from o union all
    select o_orderkey, 'shipped', ship is not null, case when ship is null then 'NOT_SHIPPED' end from o union all select o_orderkey, 'closed', o_orderstatus = 'F', case when o_orderstatus <> 'F' then 'STILL_OPEN' end from o)
    select stage, there, reason, count(*) as n from s group by all""")
def j7_stage_samples(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max("l_shipdate").alias("ship"))
    o = table(spark, sf_dir, "orders").join(li, "o_orderkey", "left")
    value = {"priced": (F.col("o_totalprice").isNotNull(), F.lit(None)), "picked": (F.col("n").isNotNull(), F.lit("NO_LINES")), "shipped": (F.col("ship").isNotNull(), F.lit("NOT_SHIPPED")),
             "closed": (F.col("o_orderstatus") == "F", F.lit("STILL_OPEN"))}
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), value[s][0].alias("there"), F.when(~value[s][0], value[s][1]).cast("string").alias("reason")) for s in _STAGES])
    return o.select(F.explode(stages).alias("s")).groupBy("s.stage", "s.there", "s.reason").agg(F.count("*").alias("n"))


@query("""select l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice::decimal(18,4), 1)::double as even, floor(l_extendedprice * 10 + .5) / 10 as up from lineitem""")
def k12_rounding(spark, sf_dir):
    """Half to even on decimals, and half up as floor(x + 1/2)."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_extendedprice").cast("decimal(18,4)"), 1).cast("double").alias("even"),
                                                   (F.floor(F.col("l_extendedprice") * 10 + 0.5) / 10).alias("up"))


# ---- M: lexical matches and searches

_LEX = """, k as (select distinct title as a, 'title' as f, b from (select distinct title from items) x join (select distinct title || ' ' || maker as b, title as t2 from items) y on split_part(title, ' ', 1) = split_part(t2, ' ', 1) or split_part(title, ' ', 2) = split_part(t2, ' ', 2)),
    v as (select *, list_distinct(list_filter(string_split_regex(a, '[\\s-]+'), lambda x: length(x) >= 2)) as p, list_distinct(list_filter(string_split_regex(b, '[\\s-]+'), lambda x: length(x) >= 2)) as q from k),
    w as (select *, len(list_intersect(p, q)) as s, len(p) as n, len(q) as m, least(length(a), length(b)) / greatest(length(a), length(b))::double as r, 1 - levenshtein(a, b) / greatest(length(a), length(b))::double as e from v),
    z as (select *, case when a = b then 'exact' when s > 0 and (n = 1 or m = 1) then 'exact' when contains(a, b) or contains(b, a) then case when r >= .18 then 'contains' end
      when s > 0 and s / n >= .5 and s / n * .82 + s / m * .18 >= .35 then 'token-overlap' when least(length(a), length(b)) >= 4 and greatest(length(a), length(b)) <= 80 and e >= .58 then 'fuzzy' end as kind from w) """


@query(_ITEMS + _LEX + """select a, b, kind, round(case kind when 'contains' then least(.96, .62 + r * .34) when 'token-overlap' then s / n * .82 + s / m * .18 when 'fuzzy' then e * .86 when 'exact' then case when a = b then 1 else .98 end end, 6) as score from z where kind is not null""")
def m9_lexical_kinds(spark, sf_dir):
    i = _items(spark, sf_dir)
    word = lambda c: F.explode(F.split(c, " ")).alias("w")
    a = i.select(F.col("title").alias("a")).distinct().select("a", word("a"))
    b = i.select("title", F.concat_ws(" ", "title", "maker").alias("b")).distinct().select("b", word("title"))
    score, kind = L.lexical_match("a", "b", True)
    return a.join(b, "w").select("a", "b").distinct().select("a", "b", kind.alias("kind"), F.round(score, 6).alias("score")).filter("kind is not null")


@query(_ITEMS + """, q as (select distinct category as query, [category, 'gea', 'brand#1'] as ks from items), d as (select query, unnest(ks) as k, (select sum(length(x)) from unnest(ks) t(x)) as n from q),
    h as (select distinct query, id, k, d.n from d join items on list_bool_or([contains(w, k) for w in string_split(title || ' ' || maker, ' ')])),
    s as (select query, id, count(*) as hits, least(.99, .3 + sum(length(k)) / max(n) * .58 + least(.12, count(*) * .04)) as score from h group by 1, 2)
    select query, id, hits, round(score, 6)::double as score from s qualify row_number() over (partition by query order by round(score, 9) desc, id) <= 5""")
def m14_keyword_search(spark, sf_dir):
    i = _items(spark, sf_dir)
    q = i.select(F.col("category").alias("query")).distinct().withColumn("ks", F.array("query", F.lit("gea"), F.lit("brand#1")))
    return L.keyword_search(q, i.withColumn("s", F.concat_ws(" ", "title", "maker")), "query", "ks", "id", "s").select("query", "id", "hits", F.round("score", 6).alias("score"))


#: Of every fiftieth item: its title without the first letter, with a wrong one or in a wrong order, and its maker; so no first letter can be trusted.
_ASKED = """, q as (select id as query, case id // 50 % 3 when 0 then 'x' || substr(title, 2) when 1 then substr(title, 2) || ' ' || left(title, 3) else string_agg_words end || ' ' || maker as text
      from (select *, array_to_string(list_reverse(string_split(title, ' ')), ' ') as string_agg_words from items) where id % 50 = 0),
    d as (select query, text, unnest(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) as t from q), n as (select query, count(*) as n from d group by 1)"""


def _asked(items):
    title = F.col("title")
    turn = F.floor(F.col("id") / 50) % 3
    text = (F.when(turn == 0, F.concat(F.lit("x"), F.substr(title, F.lit(2)))).when(turn == 1, F.concat_ws(" ", F.substr(title, F.lit(2)), F.left(title, F.lit(3))))
            .otherwise(F.array_join(F.reverse(F.split(title, " ")), " ")))
    return items.filter("id % 50 = 0").select(F.col("id").alias("query"), F.concat_ws(" ", text, "maker").alias("text"))


_TAGS = _ITEMS + _ASKED + """, tags as (select id, unnest(string_split(title, ' ')) as tag, .9 as w from items union all select id, title, .95 from items union all select id, maker, .7 from items union all select id, type, .4 from items),
    split as (select distinct tag, unnest(string_split(tag, ' ')) as v from tags), bi as (select v, [substr(v, i, 2) for i in range(1, length(v))] as g from (select distinct v from split union select distinct t from d) u),
    pr as (select t, y.v as v, x.g as x, y.g as y from (select distinct t from d) a join bi x on x.v = t cross join bi y where y.v in (select v from split)),
    sim as (select t, v, case when t = v then 1.0 when least(length(t), length(v)) >= 4 and (starts_with(t, v) or starts_with(v, t)) then .82 when least(length(t), length(v)) < 2 then 0
      else 2.0 * list_sum([least(len(list_filter(x, lambda z: z = k)), len(list_filter(y, lambda z: z = k))) for k in list_distinct(x)]) / (len(x) + len(y)) end as s from pr),
    f as (select query, t, tag, max(s) as s from (select query, t, tag, s from d join sim using (t) join split using (v) where s > 0 union all select query, t, tag, 1.0 from d join (select distinct tag from tags) g on contains(text, tag)) group by all),
    b as (select query, id, t, max(s * w) as s from f join tags using (tag) group by all),
    c as (select query, id, count(*) filter (round(s, 9) >= .52) as matched, sum(s) / max(n) as cov, max(s) as best from b join n using (query) group by 1, 2),
    o as (select *, least(.99, cov * .62 + best * .32 + least(.12, (matched - 1) * .06)) as score from c where matched > 0)"""


@query(_TAGS + """ select query, id, matched, round(score, 6)::double as score from o where round(score, 9) >= .38 qualify row_number() over (partition by query order by round(score, 9) desc, id) <= 5""")
def m10_tag_match(spark, sf_dir):
    i = _items(spark, sf_dir)
    tags = i.select("id", F.explode(F.split("title", " ")).alias("tag"), F.lit(0.9).alias("w")).union(i.select("id", "title", F.lit(0.95))).union(i.select("id", "maker", F.lit(0.7))).union(i.select("id", "type", F.lit(0.4)))
    return L.tag_match(_asked(i), tags, "query", "text", "id", "tag", "w").select("query", "id", "matched", F.round("score", 6).alias("score"))



@query(_TAGS + """, m as (select query, id, matched, round(score, 6)::double as score from o where round(score, 9) >= .38 qualify row_number() over (partition by query order by round(score, 9) desc, id) <= 5),
    r as (select *, row_number() over (partition by query order by score desc, id) as k, lead(score) over (partition by query order by score desc, id) as next from m)
    select query, id, score, round(score - next, 6) as lead, score >= .5 and (matched >= 2 or next is null or round(score - next, 9) >= .08) as accepted from r where k = 1""")
def m16_gated_matches(spark, sf_dir):
    """The gate over the matches by tags: the best of a query is accepted on two tags or a clear lead."""
    m = m10_tag_match(spark, sf_dir)
    return EV.hypothesis_gate(m, "query", "id", "score", "matched").withColumn("lead", F.round("lead", 6))


_SIMILAR = """, p as (select a.id, b.id as other, a.title as t1, b.title as t2, a.{0} = b.{0} as s0, a.{1} = b.{1} as s1, a.{2} = b.{2} as s2 from items a join items b on a.id <> b.id and (a.{0} = b.{0} or a.{1} = b.{1} or a.{2} = b.{2})),
    j as (select *, len(list_intersect(string_split(t1, ' '), string_split(t2, ' '))) / len(list_distinct(list_concat(string_split(t1, ' '), string_split(t2, ' '))))::double as j from p) """


@query(_ITEMS + _SIMILAR.format("category", "region", "maker") + """select id, other, round(least(.96, .12 + s0::int * .42 + s1::int * .2 + s2::int * .1 + j * .16), 6)::double as score from j
    qualify row_number() over (partition by id order by round(least(.96, .12 + s0::int * .42 + s1::int * .2 + s2::int * .1 + j * .16), 9) desc, other) <= 5""")
def m12_similar_items(spark, sf_dir):
    return L.similar_items(_items(spark, sf_dir), "id", "title", {"category": 0.42, "region": 0.2, "maker": 0.1}).select("id", "other", F.round("score", 6).alias("score"))


@query(_ITEMS + _SIMILAR.format("maker", "type", "region") + """select id, other, round((s0::int * .4 + s1::int * .12 + s2::int * .1 + j * .25) * .68, 6)::double as score from j
    qualify row_number() over (partition by id order by round((s0::int * .4 + s1::int * .12 + s2::int * .1 + j * .25) * .68, 9) desc, other) <= 3""")
def m11_metadata_similarity(spark, sf_dir):
    blend = 0.68
    weights = {"maker": 0.4 * blend, "type": 0.12 * blend, "region": 0.1 * blend}
    return L.similar_items(_items(spark, sf_dir), "id", "title", weights, base=0.0, title_weight=0.25 * blend, k=3).select("id", "other", F.round("score", 6).alias("score"))


@query(_ITEMS + _ASKED + """, w as (select id, unnest(string_split(title, ' ')) as g, .6 as f from items union all select id, maker, .3 from items union all select id, unnest(string_split(type, ' ')), .1 from items),
    e as (select t, g, 1 - levenshtein(t, g) / greatest(length(t), length(g))::double as s from (select distinct t from d) cross join (select distinct g from w) where 1 - levenshtein(t, g) / greatest(length(t), length(g))::double >= .6),
    b as (select query, id, t, max(s * f) as s from d join e using (t) join w using (g) group by all),
    c as (select query, id, sum(s) / max(n) as score from b join n using (query) group by 1, 2) select query, id, round(score, 6)::double as score from c qualify row_number() over (partition by query order by round(score, 9) desc, id) <= 5""")
def m15_weighted_fuzzy(spark, sf_dir):
    i = _items(spark, sf_dir)
    q = _asked(i).withColumn("ts", F.array_distinct(F.filter(F.split("text", " "), lambda x: x != "")))
    return L.weighted_fuzzy_search(q, i, "query", "ts", "id", {"title": 0.6, "maker": 0.3, "type": 0.1}).select("query", "id", F.round("score", 6).alias("score"))


@query("""with p as (select a.p_partkey, string_split(a.p_name || ' 1999', ' ') as seen, string_split(b.p_name || ' 1999', ' ') as base, string_split(c.p_name, ' ') as chal from part a join part b on b.p_partkey = a.p_partkey + 1 join part c on c.p_partkey = a.p_partkey + 2),
    u as (select p_partkey, len(list_filter(base, lambda x: x <> '1999' and not list_contains(chal, x) and list_contains(seen, x))) as b, len(list_filter(chal, lambda x: not list_contains(base, x) and list_contains(seen, x))) as c from p)
    select p_partkey, case when b > 0 and c = 0 then 'BASELINE_SUPPORT' when c > 0 and b = 0 then 'CHALLENGER_SUPPORT' else 'ABSTAIN' end as decision from u""")
def m18_pairwise_decision(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    year = F.concat("p_name", F.lit(" 1999"))
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.split(year, " ").alias("base"))
    c = p.select((F.col("p_partkey") - 2).alias("p_partkey"), F.split("p_name", " ").alias("chal"))
    return p.select("p_partkey", F.split(year, " ").alias("seen")).join(b, "p_partkey").join(c, "p_partkey").select("p_partkey", L.pairwise_decision("seen", "base", "chal").alias("decision"))


@query("""select p_partkey, case when p_size = 1 then 'known_bad_reference' when p_size % 7 = 0 or p_size % 11 = 0 then 'suspect_reference' when p_size % 5 = 0 then 'suspect_metadata' when p_size < 4 or p_size % 13 = 0 then 'manual_review' else 'trusted' end as status,
    (p_size = 1)::int + (p_size % 7 = 0)::int + (p_size % 11 = 0)::int + (p_size % 5 = 0)::int + (p_size < 4)::int + (p_size % 13 = 0)::int as reasons from part""")
def m19_reliability(spark, sf_dir):
    s = F.col("p_size")
    status, why = L.reliability(s == 1, s % 7 == 0, s % 11 == 0, s % 5 == 0, s >= 4, s % 13 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", status.alias("status"), F.size(why).alias("reasons"))


@query(_ITEMS + """, o as (select id, unnest(list_distinct(string_split(title || ' ' || maker, ' '))) as token from items), d as (select i.id, o.token, case when i.size % 2 = 0 then 1 else .5 end as c from items i join o on o.id = case when i.size % 9 = 0 then (select min(id) from items) else i.id end),
    f as (select token, ln((select count(*) + 1 from items) / (count(*) + 1.0)) + 1 as idf from o group by 1), w as (select id, token, idf * c as w from d join f using (token)), t as (select id, sum(w) as n from w group by 1),
    s as (select w.id, o.id as oid, sum(w) as s, count(*) as m from w join o using (token) group by 1, 2), r as (select s.id, oid, s / n as s, m from s join t using (id)),
    b as (select id, coalesce(max(s) filter (oid = id), 0) as own, max_by({'o': oid, 's': s, 'm': m}, {'s': round(s, 9), 'o': -oid}) as b from r group by 1)
    select id, round(own, 6)::double as own, b.o as best_id, round(b.s, 6)::double as best, b.m as n_matched, b.o <> id and b.s >= .65 and b.s - own >= .3 and b.m >= 2 as substantial from b""")
def m20_alternate_identity(spark, sf_dir):
    i = _items(spark, sf_dir)
    o = i.select("id", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "title", "maker"), " "))).alias("token"))
    first = i.agg(F.min("id").alias("f"))
    src = i.crossJoin(F.broadcast(first)).select(F.col("id").alias("ref"), F.when(F.col("size") % 9 == 0, F.col("f")).otherwise(F.col("id")).alias("id"), F.when(F.col("size") % 2 == 0, 1.0).otherwise(0.5).alias("c"))
    d = src.join(o, "id").select(F.col("ref").alias("id"), "token", "c")
    n = i.agg(F.count("*").alias("n"))
    w = o.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return L.alternate_identity(d, o, w, "id", "token", "c").select("id", F.round("own", 6).alias("own"), "best_id", F.round("best", 6).alias("best"), "n_matched", "substantial")


@query("""with o as (select l_partkey as item, l_returnflag as field, l_linenumber % 2 as axis, l_suppkey % 5 as v from lineitem where l_discount >= .05), e as (select l_partkey as item, l_returnflag as field, l_linenumber % 2 as axis, l_suppkey % 5 as v from lineitem where l_discount < .05),
    k as (select distinct o.item, o.field, o.axis from o join e using (item, field, axis)) select * from k where not exists (select 1 from o join e using (item, field, axis, v) where o.item = k.item and o.field = k.field and o.axis = k.axis)""")
def m21_metadata_conflicts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("field"), (F.col("l_linenumber") % 2).alias("axis"), (F.col("l_suppkey") % 5).alias("v"), "l_discount")
    return L.metadata_conflicts(li.filter("l_discount >= 0.05"), li.filter("l_discount < 0.05"), ("item", "field", "axis"), "v")


# ---- M6, M7: items of even size against items of odd size that share the first word of the title or the maker

_IDENTITY = _ITEMS + """, p as (select a.id as item, b.id as other, a.title = b.title as eq, contains(a.title || ' x', b.title) or a.region = b.region as inn, a.maker = b.maker as mk,
      1 - levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title))::double as sim, (a.category = b.category)::int + (a.type = b.type)::int + (a.region = b.region)::int as su,
      list_filter([case when abs(a.size - b.size) > 30 then 'year' end, case when a.type <> b.type and a.size % 3 = 0 then 'category' end], lambda x: x is not null) as h0, (a.id * 7 + b.id) % 97 = 0 as media, (a.id * 7 + b.id) % 97 = 0 or (a.id + b.id) % 31 = 0 as ev
      from items a join items b on a.size % 2 = 0 and b.size % 2 = 1 and (a.category = b.category or a.maker = b.maker)),
    h as (select *, case when media and not (eq or inn) then list_concat(h0, ['title_unconfirmed']) else h0 end as hard from p),
    k as (select *, eq and mk and su >= 2 and len(hard) = 0 as match, not list_has_any(hard, ['year', 'category']) as yc from h),
    c as (select *, len(hard) = 0 and ((media and mk and su >= 2) or match) as automatic, media or match or (mk and (eq or (sim >= .8 and yc))) or (mk and (inn or sim >= .62) and yc) as plausible from k),
    f as (select *, case when automatic then 'high' when plausible then 'medium' else 'low' end as confidence from c where plausible or ev or eq or sim >= .45) """


def _identity(spark, sf_dir):
    i = _items(spark, sf_dir)
    a = i.filter("size % 2 = 0").select(*[F.col(c).alias(f"a_{c}") for c in i.columns])
    b = i.filter("size % 2 = 1").select(*[F.col(c).alias(f"b_{c}") for c in i.columns])
    c = F.col
    by = lambda f: a.join(b, c(f"a_{f}") == c(f"b_{f}"))
    pairs = by("category").union(by("maker")).dropDuplicates(["a_id", "b_id"])
    same = lambda f: c(f"a_{f}") == c(f"b_{f}")
    hard = F.array_compact(F.array(F.when(F.abs(c("a_size") - c("b_size")) > 30, F.lit("year")), F.when(~same("type") & (c("a_size") % 3 == 0), F.lit("category"))))
    media = (c("a_id") * 7 + c("b_id")) % 97 == 0
    return i, R.identity_candidates(
        pairs, title_equal=same("title"), contained=F.concat("a_title", F.lit(" x")).contains(c("b_title")) | same("region"), same_maker=same("maker"), similarity=T.edit_similarity("a_title", "b_title"),
        support=same("category").cast("int") + same("type").cast("int") + same("region").cast("int"), hard=hard, strong_media=media, evidence=media | ((c("a_id") + c("b_id")) % 31 == 0))


@query(_IDENTITY + "select item, other, confidence, array_to_string(hard, ',') as contradictions, round(sim, 6) as similarity from f")
def m6_identity_candidates(spark, sf_dir):
    f = _identity(spark, sf_dir)[1]
    return f.select(F.col("a_id").alias("item"), F.col("b_id").alias("other"), "confidence", F.array_join("contradictions", ",").alias("contradictions"), F.round("similarity", 6).alias("similarity"))


@query(_IDENTITY + "select confidence, count(*) as n, count(distinct item) as items, min(other) as first from f group by 1")
def c12_identity_search(spark, sf_dir):
    return _identity(spark, sf_dir)[1].groupBy("confidence").agg(F.count("*").alias("n"), F.count_distinct("a_id").alias("items"), F.min("b_id").alias("first"))


@query(_IDENTITY + """, g as (select item, count(*) filter (plausible) as p, count(*) filter (automatic and plausible) as a, count(*) filter (ev) as e, min(other) filter (automatic and plausible) as s from f group by 1),
    j as (select id, coalesce(p, 0) as p, coalesce(a, 0) as a, coalesce(e, 0) as e, s, size % 11 = 0 as collides from items left join g on g.item = id where size % 2 = 0)
    select id as item, case when p = 1 and a = 1 and not collides then 're_slug' when p = 0 and e = 0 and not collides then 'true_new' else 'manual_review' end as class, case when p = 1 and a = 1 and not collides then s end as selected from j""")
def m7_identity_plan(spark, sf_dir):
    i, f = _identity(spark, sf_dir)
    items = i.filter("size % 2 = 0").select(F.col("id").alias("item"), "size")
    return R.identity_plan(items, f.withColumnRenamed("a_id", "item").withColumnRenamed("b_id", "other"), "item", "other", items.filter("size % 11 = 0"))


def _reviews(spark, sf_dir):
    """Reviewed products: item texts in other spellings, against all items that share a word or the maker, with the maker's number spelled out."""
    i = _items(spark, sf_dir)
    maker = F.translate("maker", "0123456789#", "abcdefghij")
    left = i.filter("size % 5 = 0").select(F.col("id").alias("p"), F.concat_ws(" ", "title", maker).alias("title"), maker.alias("brand"), F.lit(None).cast("string").alias("kind"))
    right = i.select(F.col("id").alias("c"), F.replace("title", F.lit(" "), F.lit("-")).alias("slug"), F.col("title").alias("official"), maker.alias("winery"), F.col("category").alias("grapes"), F.col("type").alias("category"))
    words = R.ReviewWords(generic=("economy", "promo"), grapes=("red", "blue", "hot", "cold", "small", "big", "old", "new", "green"))
    w = lambda c: F.explode(F.split(c, " ")).alias("w")
    pairs = left.select("p", w("title")).join(right.select("c", w("official")), "w").select("p", "c").distinct().join(left, "p").join(right, "c")
    return R.score_reviews(pairs, words)


@query()
def m2_match_reviews(spark, sf_dir):
    """The similarity is not in SQL; tests check ranks, caps and the gate."""
    return R.match_reviews(_reviews(spark, sf_dir), "p", "c").select("p", "c", "score", "status", "rank", F.array_join("caps", ",").alias("caps"))


@query()
def m4_discovery_status(spark, sf_dir):
    """Built on m2; the status of the best match of each reviewed product."""
    best = R.match_reviews(_reviews(spark, sf_dir), "p", "c", k=1).withColumn("n_titles", F.lit(1) + (F.col("p") % 9 == 0).cast("int"))
    return R.discovery_status(best).select("p", "c", "score", "discovery", F.array_join("reasons", ",").alias("reasons"))


@query(_ITEMS + """, a as (select title, maker from items where size % 7 = 0), s as (select x.title as a, x.maker as m, y.title as b, y.maker as n, 1 - levenshtein(x.title, y.title) / greatest(length(x.title), length(y.title))::double as s from (select distinct title, maker from a) x, (select distinct title, maker from items) y)
    select a, m, b, n, round(s, 6) as score from s qualify row_number() over (partition by a, m order by s desc, b, n) <= 3""")
def c11_full_scoring(spark, sf_dir):
    """Every product against every row of the catalog of distinct texts, which a bound on its rows keeps small enough to broadcast."""
    i = _items(spark, sf_dir).select("title", "maker", "size")
    catalog = i.select(F.col("title").alias("b"), F.col("maker").alias("n")).distinct()
    return L.score_all(i.filter("size % 7 = 0").select(F.col("title").alias("a"), F.col("maker").alias("m")).distinct(), catalog, T.edit_similarity("a", "b"), ("a", "m"), ("b", "n"), 3).select(
        "a", "m", "b", "n", F.round("score", 6).alias("score"))


@query(_ITEMS + """, w as (select i.id, x.token from items i, unnest(string_split(title || ' ' || maker, ' ')) x(token)), q as (select o_orderkey % 97 as span, o_orderpriority as p from orders), s as (select distinct span, case when p like '1%' then 'red' when p like '2%' then 'bolt' when p like '3%' then 'brand#7' else 'none' end as token from q)
    select span, count(distinct id) as supported, min(id) as first from s join w using (token) group by 1""")
def c21_pool_support(spark, sf_dir):
    """Which pool rows the tokens of a span support, by equality on distinct tokens."""
    i = _items(spark, sf_dir).select("id", F.explode(F.split(F.concat_ws(" ", "title", "maker"), " ")).alias("token"))
    p = F.col("o_orderpriority")
    token = F.when(p.startswith("1"), "red").when(p.startswith("2"), "bolt").when(p.startswith("3"), "brand#7").otherwise("none")
    s = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("span"), token.alias("token")).distinct()
    return s.join(i, "token").groupBy("span").agg(F.count_distinct("id").alias("supported"), F.min("id").alias("first"))


@query()
def m17_text_candidates(spark, sf_dir):
    """The similarity is not in SQL; tests hold the ranks against plain Python."""
    q = spark.createDataFrame([("a", "reed bolt brand 12 2001"), ("b", "hot gizmos"), ("c", "smal ring brand 7")], "query string, text string")
    return L.text_candidates(q, _items(spark, sf_dir).withColumn("name", F.concat_ws(" ", "title", "maker")), "query", "text", "id", "name").select(
        "query", "id", "strong", "exact", "year", F.round("top3", 6).alias("top3"), F.round("char", 6).alias("char"), "rank")
