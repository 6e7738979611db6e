"""Queries of payload fields, link discovery, typed text features and the evidence behind decisions.

Where the given tables lack a table of the original, both sides derive it by the same SQL expression from whole tables; the rule of the row is written twice.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evidence as EV
from tessera.operators import payloads as PL
from tessera.operators.relational import numbered
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import pages as PG

# ---- A: payloads and pages


@query("""with n as (select p_partkey, unnest([p_brand || ' ' || p_type, p_type || ' ' || p_size, ' ', p_brand || ' ' || p_type]) as name from part), p as (select distinct p_partkey, name from n where name <> ' '),
    d as (select name, row_number() over (order by name) as id from (select distinct p_brand || ' ' || p_type as name from part)),
    a as (select * from d union all select name, (select max(id) from d) + row_number() over (order by name) from (select distinct name from p where name not in (select name from d)))
    select p_partkey, name, id from p join a using (name)""")
def a9_dimension_upsert(spark, sf_dir):
    """Names that the dimension holds keep their ids, new ones are numbered on; the bridge has each item's names once."""
    part = table(spark, sf_dir, "part")
    first = F.concat_ws(" ", "p_brand", "p_type")
    dimension = numbered(part.select(first.alias("name")).distinct(), ["name"], "id")
    bridge, after = PL.bridge_rows(part, "p_partkey", F.array(first, F.concat_ws(" ", "p_type", F.col("p_size").cast("string")), F.lit(" "), first), dimension)
    return bridge.join(after, "id").select("p_partkey", "name", "id")


_PAYLOAD = """case p_size % 5
    when 0 then concat('{"id": ', p_partkey, ', "title": "  ', p_name, ' ", "rating": ', p_size, '.5, "link": "/p/', p_partkey, '", "manufacturer": {"name": "', p_brand, '"}, "characteristics": {"size": ', p_size, ', "kind": "', p_type, '"}}')
    when 1 then concat('{"title": "", "name": "', p_name, '", "total_rating": null, "rating": "', p_size, '", "url": "/u/', p_partkey, '", "manufacturer": {"title": "", "name": "', p_brand, '"}, "properties": [{"a": 1}, ', p_size, ']}')
    when 2 then concat('{"name": ["', p_name, '"], "product_link": "", "link": "/l/', p_partkey, '", "manufacturer": [1], "kind": "', p_type, '", "price": ', p_size, ', "rating": true}')
    when 3 then concat('{"title": {"title": {"name": "', p_name, '"}}, "description": "  ", "category_name": "', p_type, '", "attrs": "text", "params": {"b": ', p_size, '}, "characteristics": null}')
    else concat('[{"title": "', p_name, '"}]') end"""


@query(f"""with t as (select p_partkey, p_size, p_name, p_brand, p_type, {_PAYLOAD} as payload from part)
    select p_partkey, case p_size % 5 when 0 then p_name when 1 then p_name when 3 then p_name end as title, case p_size % 5 when 0 then p_size + .5 when 1 then p_size when 2 then 1 end::double as total_rating,
      case when p_size % 5 < 3 then substr('pul', p_size % 5 + 1, 1) end as link_kind, case when p_size % 5 < 2 then json_extract_string(payload, '$.manufacturer.name') end as manufacturer,
      case when p_size % 5 = 3 then p_type end as category_name, case p_size % 5 when 0 then 'kind,size' when 2 then 'kind,price' when 3 then 'b' end as keys,
      case when p_size % 5 = 1 then '[{{"a":1}},' || p_size || ']' end as listed from t""")
def a10_product_fields(spark, sf_dir):
    t = PL.product_fields(table(spark, sf_dir, "part").select("p_partkey", F.expr(_PAYLOAD).alias("payload")), "payload")
    return t.select("p_partkey", "title", "total_rating", F.substring("product_link", 2, 1).alias("link_kind"), "manufacturer", "category_name",
                    F.array_join(F.array_sort(F.map_keys("characteristics")), ",").alias("keys"), F.col("characteristics_list").alias("listed"))


@query("""with n as (select page_id, regexp_extract(html, '<nav>.*?</nav>', 0, 's') as nav from pages), l as (select distinct page_id, u.a as url, u.b as title from
      (select page_id, unnest(list_transform(regexp_extract_all(nav, '<a href="[^"]*">[^<]*</a>'), lambda x: {'a': regexp_extract(x, 'href="/([^"]*)"', 1), 'b': trim(regexp_extract(x, '>([^<]*)<', 1))})) as u from n)),
    d as (select page_id, 'https://site.example/' || replace(replace(replace(url, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as url, replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title from l where title <> '' and url <> ''),
    c as (select page_id, rtrim(regexp_replace(url, '[?#].*$', ''), '/') as url, title from d)
    select url, min(title) as title, count(distinct title) as titles, count(distinct page_id) as pages from c where url not in ('https://site.example/the', 'https://site.example/de', 'https://site.example') group by url""")
def a13_product_links(spark, sf_dir):
    """Links of the pages' menus as products; a block of reviews, put to every fifth page, links two of them with query and fragment."""
    block = '<div class="box reviews"><a href="/the?from=list#top">more</a> <a href="https://site.example/de/">more</a> <a href="https://other.example/que">more</a></div>'
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit(block), "html")).otherwise(F.col("html")))
    return PG.discover_links(pages, "page_id", "html", "https://site.example/", ["nav"], ["reviews"])[0]


_VARIANT = """concat(case l_linenumber % 4 when 0 then 'https://cdn.site.example' when 1 then 'https://site.example' when 2 then 'http://CDN.site.example:8080' else 'https://u@other.example' end,
    case l_partkey % 4 when 0 then '/files/cache/full/' when 1 then '/files/cache/print/' when 2 then '/files/cache/small/' else '/files/' end, l_orderkey, '.jpg?v=', l_linenumber % 3)"""
_RANKS = ((None, "/cache/small/", 4), ("cdn.site.example", "/cache/full/", 0), ("cdn.site.example", "/cache/print/", 1), ("site.example", "/cache/full/", 2))


@query(f"""with u as (select l_orderkey, l_linenumber % 4 as h, l_partkey % 4 as p, {_VARIANT} as url from lineitem),
    r as (select *, case when p = 2 then 4 when h in (0, 2) and p = 0 then 0 when h in (0, 2) and p = 1 then 1 when h = 1 and p = 0 then 2 else 3 end as rank from u)
    select l_orderkey, (min({{'r': rank, 'u': url}})).u as preferred, min(rank) as rank, count(distinct url) as variants from r group by 1""")
def a14_image_variants(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_VARIANT).alias("url"))
    return PG.preferred_variants(u, "l_orderkey", "url", _RANKS, 3)


# ---- B, C: guards, phrases, dictionaries

_ROW = """concat('{"brand": "', p_brand, '", "size": ', p_size, ', "note": null, "box": {"w": ', p_size % 3, ', "h": 2}}')"""
_EXPECTED = """case p_partkey % 8 when 0 then concat('{"brand": "', p_brand, '"}') when 1 then concat('{"brand": "', p_brand, '", "size": ', p_size + 1, '}') when 2 then concat('{"size": "', p_size, '"}')
    when 3 then '{"note": null}' when 4 then '{"other": null}' when 5 then concat('{"box": {"h": 2, "w": ', p_size % 3, '}}') when 6 then '{}' else 'none' end"""


@query("""select p_partkey, p_partkey % 8 in (0, 3, 5, 6) as held from part""")
def b10_still_equal(spark, sf_dir):
    """Reviewed values guard a change: it applies where the row still holds them, whatever the order of keys."""
    return table(spark, sf_dir, "part").select("p_partkey", PL.still_equal(F.expr(_ROW), F.expr(_EXPECTED)).alias("held"))


_CLAUSES = """concat('Found at a fair, ', case p_size % 6 when 0 then 'award Vintage ' when 1 then 'vintage: ' when 2 then 'год урожая ' when 3 then 'vintage 2001 bottling, vintage ' when 4 then
    concat('competition ', p_name, ' ', p_name, ' ', p_name, ' of ', p_name, ' vintage ') else 'made in ' end, 1990 + p_size, case p_partkey % 5 when 0 then ' bottled late' when 1 then ', bottled late' when 2 then '.5 l' when 3 then
    concat(' the ', p_name, ' ', p_name, ' bottled late') else '; award of 2003; vintage 1997' end)"""


@query(rf"""with t as (select p_partkey, {_CLAUSES} as text from part), s as (select p_partkey, unnest(string_split(replace(text, ';', ','), ',')) as seg from t),
    m as (select p_partkey, regexp_extract(seg, '^(.*?(?:^| ))((?i:vintage|год урожая))[ :]+((?:19|20)[0-9][0-9])(.*)$', ['b', 'p', 'y', 'a']) as m from s),
    y as (select p_partkey, list(distinct m.y order by m.y) as years from m where m.y <> '' and not regexp_matches(m.a, '^[./][0-9]') and not regexp_matches(right(m.b, 60), '(?i)award|competition|bottl')
      and not regexp_matches(left(m.a, 35), '(?i)award|competition|bottl') group by 1)
    select p_partkey, coalesce(array_to_string(years, ','), '') as years from part left join y using (p_partkey)""")
def b15_vintage_years(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.phrase_years(F.expr(_CLAUSES)), ",").alias("years"))


_NAMES = """concat(upper(p_name), ';  ', replace(p_name, ' ', ','), ', ', p_type, ' x,', chr(10), p_type)"""
_DICTIONARY = """with w as (select distinct unnest(string_split(p_name, ' ')) as name from part), g as (select min(p_partkey) as id, p_name as name from part group by 2 union all select 1000000000 + min(p_partkey), p_type from part group by p_type
      union all select 2000000000 + min(p_partkey), lower(p_type) || '  X' from part group by p_type union all select 3000000000 + min(p_partkey), ' ' || lower(p_type) from part where p_size % 2 = 0 group by p_type),
    k as (select *, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) as k from g), t as (select distinct p_partkey, unnest(string_split_regex({0}, '[,;\\n]')) as raw_token from part),
    m as (select t.p_partkey, raw_token, list(id order by id) filter (id is not null) as ids, list(name order by id) filter (id is not null) as names from t left join k on k.k = lower(trim(regexp_replace(raw_token, '\\s+', ' ', 'g'))) where trim(raw_token) <> '' group by all)
    """.format(_NAMES)


def _dictionary_relations(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    least = lambda df, name, base: df.groupBy(name.alias("name")).agg((F.min("p_partkey") + base).alias("id")).select("id", "name")
    low = F.lower("p_type")
    rows = [least(p, F.col("p_name"), 0), least(p, F.col("p_type"), 1_000_000_000), least(p, F.concat(low, F.lit("  X")), 2_000_000_000), least(p.filter("p_size % 2 = 0"), F.concat(F.lit(" "), low), 3_000_000_000)]
    dictionary = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    return EV.dictionary_relations(p.select("p_partkey", F.expr(_NAMES).alias("raw")), "p_partkey", "raw", dictionary)


@query(_DICTIONARY + "select distinct p_partkey, ids[1] as id, names[1] as name from m where len(ids) = 1")
def c17_dictionary_relations(spark, sf_dir):
    return _dictionary_relations(spark, sf_dir)[0]


@query(_DICTIONARY + """select p_partkey, raw_token, case when ids is null then 'no_exact_dictionary_match' else 'ambiguous_normalization' end as reason, coalesce(array_to_string(ids, ','), '') as candidates
    from m where ids is null or len(ids) > 1""")
def c17_unresolved_tokens(spark, sf_dir):
    x = _dictionary_relations(spark, sf_dir)[1]
    return x.withColumn("candidates", F.array_join(x["candidates"].cast("array<string>"), ","))


# ---- D, E: roll-up and priority


@query("""with o as (select user_id, count(*) as observations, count(*) filter (event_id % 3 > 0) as valid_observations, round(avg((value / 100)::decimal(18,6)) filter (event_id % 3 > 0)::decimal(18,9), 4)::double as average_validity
      from events where event_type in ('view', 'click') group by 1),
    r as (select user_id, count(*) as regions, count(*) filter (event_id % 4 >= 2) as supported_regions, round(avg((value / 50)::decimal(18,6))::decimal(18,9), 4)::double as average_consensus,
      count(*) filter (event_type = 'signup') as semantic_regions, count(*) filter (event_type = 'signup' and value >= 0.75) as high_semantic_regions from events where event_type in ('purchase', 'signup') group by 1),
    p as (select user_id, round(avg(value::decimal(18,6))::decimal(18,9), 2)::double as average_confidence from events where event_type = 'error' group by 1), u as (select distinct user_id from events where event_type is not null)
    select user_id, coalesce(observations, 0) as observations, coalesce(valid_observations, 0) as valid_observations, coalesce(observations - valid_observations, 0) as rejected_observations,
      coalesce(average_validity, 0) as average_validity, coalesce(regions, 0) as regions, coalesce(supported_regions, 0) as supported_regions, coalesce(average_consensus, 0) as average_consensus, coalesce(semantic_regions, 0) as semantic_regions,
      coalesce(high_semantic_regions, 0) as high_semantic_regions, coalesce(average_confidence, 0) as average_confidence from u left join o using (user_id) left join r using (user_id) left join p using (user_id)""")
def d41_evidence_quality(spark, sf_dir):
    """Views and clicks stand for observations, purchases and signups for regions (signups with a meaning), errors for passes."""
    e = table(spark, sf_dir, "events")
    observations = e.filter("event_type in ('view', 'click')").select("user_id", (F.col("event_id") % 3 > 0).alias("valid"), (F.col("value") / 100).alias("validity"))
    regions = e.filter("event_type in ('purchase', 'signup')").select("user_id", (F.col("event_id") % 4).alias("support"), (F.col("value") / 50).alias("consensus"),
                                                                      F.when(F.col("event_type") == "signup", "producer").otherwise("unknown").alias("kind"), F.col("value").alias("confidence"))
    return EV.evidence_quality(observations, regions, e.filter("event_type = 'error'").select("user_id", F.col("value").alias("confidence")), "user_id")


@query("""with p as (select p_partkey, p_size / 50.0 as score, p_partkey % 97 = 0 as known, p_size % 7 = 0 as reason from part)
    select p_partkey, row_number() over (order by not known, score desc, p_partkey) as diagnostic_rank, case when known or score >= .85 then 'high' when score >= .7 then 'medium' when score >= .55 or reason then 'low' else 'none' end as priority_level from p""")
def e13_diagnostic_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("score"), (F.col("p_partkey") % 97 == 0).alias("known"),
                                            F.when(F.col("p_size") % 7 == 0, F.array(F.lit("seven"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return EV.diagnostic_priority(p, "p_partkey", "score", "reasons", "known").select("p_partkey", "diagnostic_rank", "priority_level")


# ---- I, K: typed features and votes


@query(r"""with t as (select doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ё', 'е'), '[^\p{L}\p{N}\s-]', ' ', 'g'), '\s+', ' ', 'g')) || ' cabemet fanag0ria 2o25 kaberne' as t from documents where text is not null)
    select doc_id, sha256(replace(replace(regexp_replace(replace(replace(replace(replace(t, 'fanag0ria', 'fanagoria'), 'cabemet', 'cabernet'), 'kaberne', 'cabernet'), 'saperav1', 'saperavi'), '2o2([0-9])', '202\1', 'g'), '202!', '2021'), 'abrau durso', 'abrau-durso')) as digest from t""")
def i7_recognised_text(spark, sf_dir):
    """Whole texts, each with four misread words at its end."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.sha2(T.recognised_text(F.concat("text", F.lit("\n CABEMET,fanag0ria 2O25!kaberne"))), 256).alias("digest"))


_STYLES = """concat(case p_size % 9 when 0 then 'Semi-Sweet RED ' when 1 then 'extra brut &amp; Rosé ' when 2 then 'Semi Dry white, golden ' when 3 then '<b>brut</b> ' when 4 then 'dry RUBY ' when 5 then 'sweet orange ' when 6 then 'pinkish white ' else '' end, p_name, ' ', p_type)"""


@query(f"""with t as (select p_partkey, lower(regexp_replace(regexp_replace({_STYLES}, '<b>|</b>|&amp;|-', ' ', 'g'), '[ ,]+', ' ', 'g')) as t from part), c as (select *, list_filter(['rose', 'red', 'white'], lambda k: regexp_matches(t, case k when 'rose' then 'rose|pink' when 'red' then 'red|ruby' else 'white|gold' end)) as f from t)
    select p_partkey, case when regexp_matches(t, 'rose|pink') then 'rose' when contains(t, 'red') then 'red' when regexp_matches(t, 'bel|white') then 'white' when contains(t, 'orange') then 'orange' else 'other' end as category,
      case when contains(t, 'semi sweet') then 'semi_sweet' when contains(t, 'semi dry') then 'semi_dry' when contains(t, 'extra brut') then 'extra_brut' when contains(t, 'brut') then 'brut' when contains(t, 'sweet') then 'sweet' when contains(t, 'dry') then 'dry' end as sweetness,
      case when len(f) = 1 then f[1] end as colour from c""")
def i9_word_classes(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", T.normalized(F.expr(_STYLES)).alias("t"))
    return t.select("p_partkey", T.first_class("t", T.CATEGORY, F.lit("other")).alias("category"), T.first_class("t", T.SWEETNESS).alias("sweetness"), T.sole_class("t", T.COLOUR).alias("colour"))


_KINDS = "element_at(array('color', 'region', 'producer', 'classification', 'product-name', 'free-text', 'unknown', 'vintage'), cast(p_size % 8 + 1 as int))"
_FIELDS = "element_at(array('color', 'region', 'manufacturer', 'category', 'title', 'alias', 'description', 'sku'), cast(p_partkey % 8 + 1 as int))"


@query("""with t as (select p_partkey, ['color', 'region', 'producer', 'classification', 'product-name', 'free-text', 'unknown', 'vintage'][p_size % 8 + 1] as k,
      ['color', 'region', 'producer', 'classification', 'product-name', 'product-name', 'free-text', 'unknown'][p_partkey % 8 + 1] as f from part)
    select p_partkey, case when k = 'unknown' or f = 'unknown' then .65 when k = f then 1 when (k, f) = ('product-name', 'producer') then .78 when (k, f) = ('producer', 'product-name') then .72 when (k, f) = ('classification', 'product-name') then .68
      when (k, f) = ('region', 'free-text') then .58 when k = 'free-text' and f in ('product-name', 'producer', 'region') then .55 else .18 end::double as fit from t""")
def i11_field_fit(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.field_fit(F.expr(_KINDS), F.expr(_FIELDS)).alias("fit"))


_METRICS = ("inliers", "ratio", "grid", "hull", "span")


@query("""with l as (select l_orderkey, l_linenumber, max(l_quantity) as inliers, max(l_discount) as ratio, min(l_tax) as grid, max(l_extendedprice) as hull, nullif(min(l_partkey % 5), 4)::double as span from lineitem group by 1, 2),
    p as (select *, unnest(['inliers', 'ratio', 'grid', 'hull', 'span']) as m, unnest([inliers, ratio, grid, hull, span]) as v from l),
    v as (select a.l_orderkey, a.l_linenumber // 2 as mode, count(*) filter (abs(a.v - b.v) > 1e-12) as told, count(*) filter (a.v - b.v > 1e-12) as base, count(*) filter (b.v - a.v > 1e-12) as other
      from p a join p b on a.l_orderkey = b.l_orderkey and a.m = b.m and (a.l_linenumber, b.l_linenumber) in ((1, 2), (3, 4)) group by all),
    w as (select l_orderkey, count(*) = 2 as available, coalesce(bool_and(told >= 4 and base >= 4), false) as veto, coalesce(bool_or(told >= 4 and other >= 4), false) as support, sum(told)::bigint as told from v group by 1)
    select o_orderkey, coalesce(available, false) as available, coalesce(available and veto, false) as strict_veto, coalesce(available and support, false) as soft_support, case when available then told end as told from orders left join w on o_orderkey = l_orderkey""")
def k9_pair_support(spark, sf_dir):
    """Lines one and two of an order are baseline and challenger in one mode, lines three and four in the other."""
    part = F.col("l_partkey") % 5
    line = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 4").groupBy("l_orderkey", "l_linenumber").agg(F.struct(
        F.max("l_quantity").alias("inliers"), F.max("l_discount").alias("ratio"), F.min("l_tax").alias("grid"), F.max("l_extendedprice").alias("hull"), F.nullif(F.min(part), F.lit(4)).cast("double").alias("span")).alias("m"))
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*(F.any_value(F.when(F.col("l_linenumber") == i, F.col("m")), ignoreNulls=True).alias(f"m{i}") for i in range(1, 5)))
    there = F.col("m1").isNotNull() & F.col("m2").isNotNull() & F.col("m3").isNotNull() & F.col("m4").isNotNull()
    a, b = EV.metric_votes(F.col("m1"), F.col("m2"), _METRICS), EV.metric_votes(F.col("m3"), F.col("m4"), _METRICS)
    votes = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").select("o_orderkey", there.alias("there"), a.alias("a"), b.alias("b"))
    return votes.select("o_orderkey", F.expr("if(there, a.available + b.available, null)").alias("told"), EV.pair_support(F.col("a"), F.col("b"), F.col("there")).alias("s")).select("o_orderkey", "told", "s.*")


# ---- N, O: failures and drift

@query("""with c as (select l_orderkey as c, l_partkey as id, max(l_discount) * 10 as score, max(l_tax) * 10 as identity, max(l_quantity) / 50 as geometry, min(l_discount) * 5 as conflict, bool_or(l_returnflag <> 'R') as pooled from lineitem group by 1, 2),
    r as (select *, row_number() over (partition by c order by score desc, id) as rank, row_number() over (partition by c order by geometry desc, id) as rival from c),
    t as (select c, min(id) as truth, round(max(score) filter (rank = 1) - max(score) filter (rank = 2), 9) as margin, max(id) filter (rank = 1) as top, max(id) filter (rank = 2) as second, max(id) filter (rival = 1) as rv,
      round(max(geometry) filter (rival = 1) - max(geometry) filter (rival = 2), 9) as ahead from r group by 1),
    x as (select t.*, o_orderpriority = '1-URGENT' as suspect, g.pooled, round(f.identity - g.identity, 9) as di, round(g.conflict, 9) as gc, round(f.geometry - g.geometry, 9) as dg, p.p_brand = q.p_brand as siblings from t join orders on c = o_orderkey
      join r g on g.c = t.c and g.id = truth join r f on f.c = t.c and f.rank = 1 join part p on p.p_partkey = top left join part q on q.p_partkey = second),
    y as (select c, list_filter([case when suspect then 'TARGET_SUSPECT' end, case when pooled then 'RERANK_ERROR' else 'RETRIEVAL_MISS' end, case when margin is null or margin < .03 then 'LOW_INFORMATION' end, case when siblings then 'SIBLING_AMBIGUITY' end,
      case when di > .25 or gc > .3 then 'OCR_CONFLICT' end, case when dg > .25 then 'GEOMETRY_CONFLICT' end, case when rv <> truth and ahead > .03 then 'SOURCE_CONFLICT' end], lambda z: z is not null) as f from x)
    select c as o_orderkey, f[1] as kind, array_to_string(f[2:], ',') as further from y""")
def n17_failure_taxonomy(spark, sf_dir):
    """An order is a case, its parts are ranked by discount; the truth is its smallest part, brands are the groups of siblings, quantity is the source on its own."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("id")).agg(
        (F.max("l_discount") * 10).alias("score"), (F.max("l_tax") * 10).alias("identity"), (F.max("l_quantity") / 50).alias("geometry"), (F.min("l_discount") * 5).alias("conflict"), F.bool_or(F.col("l_returnflag") != "R").alias("pooled"))
    place = lambda c: F.row_number().over(W.partitionBy("case").orderBy(F.desc(c), "id"))
    ranked = own.withColumn("rank", place("score")).withColumn("rival", place("geometry"))
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), (F.col("o_orderpriority") == "1-URGENT").alias("suspect"))
    cases = ranked.groupBy("case").agg(F.min("id").alias("truth"), F.round(at(1) - at(2), 9).alias("margin")).join(orders, "case")
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"))
    out = EV.failure_taxonomy(cases, ranked, groups, ranked.select("case", "id", F.col("rival").alias("rank"), F.col("geometry").alias("score")))
    return out.select(F.col("case").alias("o_orderkey"), "kind", F.array_join("further", ",").alias("further"))


@query(r"""with d as (select doc_id, coalesce(text, '') as t from documents), f as (select doc_id, unnest(['numbers', 'names']) as field, unnest([list_sort(list_distinct(regexp_extract_all(t, '[0-9]{4}'))), list_sort(list_distinct(regexp_extract_all(t, '[A-Z][a-z]{5,}')))]) as om,
      unnest([list_sort(list_distinct(regexp_extract_all(t, '[0-9]{4,}'))), list_sort(list_distinct(regexp_extract_all(t, '[A-Z][a-z]{5,}')))]) as nm from d),
    g as (select *, list_filter(om, lambda x: length(x) > 6) as oc, list_filter(nm, lambda x: length(x) > 6) as nc, case when len(om) = 0 then [field] else [] end as os, case when len(nm) = 0 then [field] else [] end as ns from f),
    h as (select doc_id, field, unnest(['matched', 'conflicts', 'missing', 'weight', 'matches_before', 'matches_after', 'conflicts_before', 'conflicts_after']) as item,
      unnest([(om <> nm)::bigint, (oc <> nc)::bigint, (os <> ns)::bigint, (len(om) <> len(nm))::bigint, len(om), len(nm), len(oc), len(nc)]) as n from g)
    select field, item, sum(n)::bigint as n from h group by all union all select '*', 'vectors', count(*) from d union all
    select '*', 'changed', count(distinct doc_id) from h where n > 0 and item in ('matched', 'conflicts', 'missing', 'weight')""")
def o9_feature_drift(spark, sf_dir):
    """Two parsers of whole texts: the new one keeps numbers of more than four digits whole, and reads names as before."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))

    def feature(field: str, pattern: str):
        m = F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))))
        return F.struct(m.alias("matched"), F.filter(m, lambda x: F.length(x) > 6).alias("conflicts"), F.when(F.size(m) == 0, F.array(F.lit(field))).otherwise(F.array().cast("array<string>")).alias("missing"),
                        F.size(m).cast("double").alias("weight")).alias(field)
    parse = lambda number: d.select("doc_id", feature("numbers", number), feature("names", "[A-Z][a-z]{5,}"))
    return EV.parser_drift(parse("[0-9]{4}"), parse("[0-9]{4,}"), "doc_id", ["numbers", "names"])
