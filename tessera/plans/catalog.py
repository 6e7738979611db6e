"""Catalog queries: payload fields, typed text features, provenance folds, ranks among equals, plans and audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import geometry as GEO
from tessera.operators import datasets as D
from tessera.operators import evaluate as E
from tessera.operators import fusion as FU
from tessera.operators import relational as R
from tessera.operators import wordjoin as J
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import pages as PG


# ---- A: payloads and exports

@query("""select event_id, case when json_extract_string(props, '$.k') is null then 'no_key'
    when cast(json_extract_string(props, '$.k') as bigint) >= 50 then 'out_of_range' end as reason from events
    where json_extract_string(props, '$.k') is null or cast(json_extract_string(props, '$.k') as bigint) >= 50""")
def a8_payload_rejects(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    reason = F.when(k.isNull(), "no_key").when(k >= 50, "out_of_range")
    return table(spark, sf_dir, "events").select("event_id", reason.alias("reason")).filter("reason is not null")


@query("""select distinct p_partkey, ('0x' || substr(md5(word), 1, 15))::bigint as word_id from (select p_partkey, unnest(string_split(p_name, ' ')) as word from part)""")
def a9_bridge_rows(spark, sf_dir):
    """Ids come from the words themselves, so a growing vocabulary needs no numbering in one task."""
    w = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select("p_partkey", F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("long").alias("word_id"))


@query("""select event_id, coalesce(json_extract_string(props, '$.score'), json_extract_string(props, '$.k'), '0') as value from events""")
def a10_first_present_field(spark, sf_dir):
    f = [F.get_json_object("props", p) for p in ("$.score", "$.k")]
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(*f, F.lit("0")).alias("value"))


@query("""select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, len(regexp_extract_all(html, '<img ')) as images,
    coalesce(cast(list_max(regexp_extract_all(html, '\\b(?:19|20)[0-9][0-9]\\b')) as int), 0) as last_year from pages""")
def a12_page_parse(spark, sf_dir):
    years = F.regexp_extract_all("html", F.lit(r"\b(?:19|20)[0-9][0-9]\b"), F.lit(0))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<img ")).cast("long").alias("images"),
        F.coalesce(F.array_max(F.transform(years, lambda x: x.cast("int"))), F.lit(0)).alias("last_year"))


def _product_pages(spark, sf_dir):
    """The pages with product microdata in front of their closing tag, as the given pages hold none."""
    i = F.col("page_id").cast("string")
    mark = F.concat(F.lit("<link rel=canonical href='https://shop.example/p/"), i, F.lit("'><div itemscope itemtype='https://schema.org/Product'><span itemprop=brand itemscope><b itemprop=name>Brand &amp; "),
                    (F.col("page_id") % 7).cast("string"), F.lit("</b></span><p itemprop=name>Wine "), i, F.lit(" <i>red</i></p><div itemprop=aggregateRating><meta itemprop=ratingValue content='"),
                    (F.col("page_id") % 5).cast("string"), F.lit(",5'></div>"),
                    F.array_join(F.transform(F.sequence(F.lit(0), F.col("page_id") % 3), lambda k: F.concat(F.lit("<div itemprop=review id=review-"), (F.col("page_id") * 10 + k).cast("string"), F.lit(
                        "><a itemprop=url href='https://shop.example/r/"), k.cast("string"), F.lit("'>x</a><span itemprop=name>Note "), k.cast("string"), F.lit("</span><script>no()</script></div>"))), ""), F.lit("</div>"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.replace("html", F.lit("</body></html>"), F.lit("")), mark, F.lit("</body></html>")).alias("html"))


@query("""select page_id, 'Wine ' || page_id || ' red' as title, 'Brand & ' || page_id % 7 as brand, page_id % 5 + .5::double as rating, 'https://shop.example/p/' || page_id as url, page_id % 3 + 1 as n_teasers,
    array_to_string([(page_id * 10 + k) || ':Note ' || k for k in range(0, page_id % 3 + 1)], ',') as teasers from pages where html is not null""")
def a11_product_pages(spark, sf_dir):
    p = PG.parse_pages(_product_pages(spark, sf_dir).filter("html is not null"), "page_id", "html", "product")
    return p.select("page_id", "title", "brand", "rating", "url", F.size("teasers").cast("long").alias("n_teasers"), F.array_join(F.transform("teasers", lambda t: F.concat(t["id"], F.lit(":"), t["title"])), ",").alias("teasers"))


@query("""select page_id, 'r' || '' || page_id as key, page_id::varchar as review_id, 'Tasted in ' || (1990 + page_id % 30) || ' after 2 years. End' as body, 'https://img.example/full/p' || page_id || '.jpg' as image, 2::bigint as n_variants,
    case when page_id % 30 < 15 then (1990 + page_id % 30) || ',' || 2015 when page_id % 30 > 25 then 2015 || ',' || (1990 + page_id % 30) when page_id % 30 = 25 then '2015' else (1990 + page_id % 30) || ',2015' end as years from pages where html is not null""")
def a12_review_pages(spark, sf_dir):
    """The pages with a review's microdata: quoted parts and scripts are no body, variants of a picture are one image."""
    i = F.col("page_id").cast("string")
    mark = F.concat(F.lit("<link rel=canonical href='https://shop.example/reviews/n"), i, F.lit("'><article itemscope itemtype='http://schema.org/Review'><h2 itemprop=name>Of 2015</h2><div itemprop=reviewBody>Tasted in "), (F.col("page_id") % 30 + 1990).cast("string"),
                    F.lit(" after 2 years.<blockquote>In 1950</blockquote><script>1951</script> End</div><a href='https://img.example/small/P"), i, F.lit("-120x90.jpg'><img src='local.jpg' data-original='https://img.example/full/p"), i, F.lit(".jpg'></a></article>"))
    pages = table(spark, sf_dir, "pages").filter("html is not null").select("page_id", F.concat(F.replace("html", F.lit("</body></html>"), F.lit("")), mark).alias("html"))
    r = PG.parse_pages(pages, "page_id", "html", "review", ["/full/"])
    return r.select("page_id", F.concat(F.lit("r"), "page_id").alias("key"), "review_id", "body", F.get("images", F.lit(0))["preferred"].alias("image"), F.size(F.get("images", F.lit(0))["variants"]).cast("long").alias("n_variants"), F.array_join("years", ",").alias("years"))


_PAYLOAD = """with j as (select p_partkey, case when p_partkey % 9 = 0 then null else p_name end as slug, p_type as title, p_brand as brand, p_size, p_retailprice from part)"""


@query(_PAYLOAD + """ select slug, title, case when p_partkey % 2 = 0 then brand end as category_name, brand || ' Estate' as manufacturer_name, case p_partkey % 4 when 0 then 'https://cdn.example/a/' || p_partkey || '.png' when 1 then 'https://media.example/u/' || p_partkey || '.png' when 2 then 'https://media.example/' || p_partkey || '.png' end as image_url,
    p_size::double / 10 as public_rating from j where slug is not null""")
def a4_flat_payloads(spark, sf_dir):
    """List payloads as JSON text to flat catalog rows; a payload without its slug is rejected, addresses are made absolute."""
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey").cast("string")
    image = F.expr("p_partkey % 4")
    url = F.when(image == 0, F.concat(F.lit("https://cdn.example/a/"), i, F.lit(".png"))).when(image == 1, F.concat(F.lit("/u/"), i, F.lit(".png"))).when(image == 2, F.concat(i, F.lit(".png")))
    body = F.to_json(F.struct(F.when(F.expr("p_partkey % 9 <> 0"), F.col("p_name")).alias("slug"), F.col("p_type").alias("title"), F.when(F.expr("p_partkey % 2 = 0"), F.col("p_brand")).alias("category"),
                              F.concat("p_brand", F.lit(" Estate")).alias("manufacturer"), (F.col("p_size") / 10).alias("publicRating"), F.struct(url.alias("url"), F.lit("alt").alias("altText")).alias("image")))
    good, _ = R.flatten_list_item(p.select(body.alias("payload")), "payload", "https://media.example/")
    return good.select("slug", "title", "category_name", "manufacturer_name", "image_url", "public_rating")


@query("""select l_orderkey, arg_min(l_linenumber, (case l_shipmode when 'N' then 0 when 'A' then 1 else 2 end) * 100 + l_linenumber) as chosen
    from (select *, l_returnflag as l_shipmode from lineitem) group by l_orderkey""")
def a14_preferred_variant(spark, sf_dir):
    order = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", order * 100 + F.col("l_linenumber")).alias("chosen"))


# ---- B: predicates

@query("""select doc_id from documents where lang is distinct from 'en' and coalesce(length(trim(text)), 0) < 200""")
def b5_null_safe_worklist(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(
        ~F.col("lang").eqNullSafe(F.lit("en")) & (F.coalesce(F.length(F.trim("text")), F.lit(0)) < 200)).select("doc_id")


@query("""select o.o_orderkey from orders o join orders p on p.o_orderkey = o.o_orderkey where
    (case when o.o_orderkey % 5 = 0 then null else o.o_orderstatus end) is distinct from p.o_orderstatus""")
def b7_changed_only(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.withColumn("new_status", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))).drop("o_orderstatus")
    return new.join(o, "o_orderkey").filter(~F.col("new_status").eqNullSafe(F.col("o_orderstatus"))).select("o_orderkey")


@query("""select conv_id from conversations group by conv_id having bool_or(text ilike '%then%')""")
def b9_exists_in_array(spark, sf_dir):
    # one boolean a conversation is kept instead of its texts
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.bool_or(F.coalesce(F.col("text").ilike("%then%"), F.lit(False))).alias("hit")).filter("hit").select("conv_id")


@query("""select p_partkey from part where p_brand is not distinct from 'Brand#13' and p_type is not distinct from 'ECONOMY'""")
def b10_containment_guard(spark, sf_dir):
    seen = {"p_brand": "Brand#13", "p_type": "ECONOMY"}
    df = table(spark, sf_dir, "part")
    for c, v in seen.items():
        df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
    return df.select("p_partkey")


@query("""select doc_id, try_cast(nullif(regexp_extract(text, '\\b([0-9]{4})\\b', 1), '') as int) as year from documents where regexp_matches(text, '\\b[0-9]{4}\\b')""")
def b14_first_year(spark, sf_dir):
    year = F.nullif(F.regexp_extract("text", r"\b([0-9]{4})\b", 1), F.lit("")).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", year.alias("year")).filter("year is not null")


@query("""select p_partkey, p_name from part where p_partkey = 7 or (p_name ilike 'bol%' or p_name ilike '% bol%')
    order by p_partkey limit 50 offset 10""")
def b16_alias_search_page(spark, sf_dir):
    hit = (F.col("p_partkey") == 7) | F.exists(F.split("p_name", " "), lambda x: x.ilike("bol%"))
    return R.page(table(spark, sf_dir, "part").filter(hit).select("p_partkey", "p_name"), ["p_partkey"], 50, 10)


# ---- C: joins

@query("""with u as (select p_name from part group by p_name having count(*) = 1)
    select p_partkey, l_linenumber, l_orderkey from part join lineitem on l_partkey = p_partkey
    where l_quantity > 45 and l_returnflag = 'R' and p_type = 'ECONOMY' and p_name not in (select p_name from u)""")
def c4_guarded_override(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_type = 'ECONOMY'").select("p_partkey", "p_name")
    single = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n = 1").select("p_name")
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 45 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_orderkey")
    return li.join(p.join(single, "p_name", "left_anti"), "p_partkey").select("p_partkey", "l_linenumber", "l_orderkey")


_EVIDENCE = """with a as (select s_suppkey as id, s_nationkey as nation, round(s_acctbal) as bal, split_part(s_name, '#', 2) as num from supplier), b as (select c_custkey as cid, c_nationkey as nation, round(c_acctbal) as bal, split_part(c_name, '#', 2) as num from customer),
    k as (select id, (select count(*) from b where b.nation = a.nation) as by_nation, (select count(*) from b where b.bal = a.bal) as by_balance, (select count(*) from b where b.num = a.num) as by_number, (select count(*) from b where b.bal = a.bal and b.nation = a.nation) as by_both from a) """


@query(_EVIDENCE + "select id, by_nation, by_balance, by_number, by_both, case when by_both > 0 or by_number = 1 then 'strong' when by_balance > 0 then 'weak' else 'none' end as evidence from k")
def c13_evidence_join(spark, sf_dir):
    """Evidence of four keys.  Each key is counted on the other side before the join, so a key that many rows share makes no pairs."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.round("s_acctbal").alias("bal"), F.split_part("s_name", F.lit("#"), F.lit(2)).alias("num"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.round("c_acctbal").alias("bal"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("num"))
    for name, keys in (("by_nation", ["nation"]), ("by_balance", ["bal"]), ("by_number", ["num"]), ("by_both", ["nation", "bal"])):
        a = a.join(b.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    kind = F.when((F.col("by_both") > 0) | (F.col("by_number") == 1), "strong").when(F.col("by_balance") > 0, "weak").otherwise("none")
    return a.select("id", "by_nation", "by_balance", "by_number", "by_both", kind.alias("evidence"))


@query("""select coalesce(l.doc_id, d.doc_id) as doc_id, case when d.doc_id is null then 'orphan_label' when l.doc_id is null then 'unlabelled'
    when l.quality = 1 and l.toxic = 1 then 'contradiction' end as violation from documents d full join labels l on d.doc_id = l.doc_id
    where d.doc_id is null or l.doc_id is null or (l.quality = 1 and l.toxic = 1)""")
def c27_consistency_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("in_docs"))
    v = F.when(F.col("in_docs").isNull(), "orphan_label").when(F.col("in_labels").isNull(), "unlabelled").when(F.expr("quality = 1 and toxic = 1"), "contradiction")
    return d.join(table(spark, sf_dir, "labels").withColumn("in_labels", F.lit(1)), "doc_id", "full").select("doc_id", v.alias("violation")).filter("violation is not null")


@query("""with k as (select distinct unnest(string_split(p_name, ' ')) as term from part), w as (select distinct case l_linenumber % 4 when 0 then 'x' || substr(w, 2) when 1 then w || 's' when 2 then left(w, length(w) - 1) else w end as word
      from (select l_linenumber, unnest(string_split(p_name, ' ')) as w from lineitem join part on p_partkey = l_partkey)),
    s as (select word, term, 1 - levenshtein(word, term) / greatest(length(word), length(term))::double as score from w cross join k where abs(length(word) - length(term)) <= greatest(1, ceil(length(word) * .26)))
    select word, term, round(score, 6) as score from s where score >= .74 qualify row_number() over (partition by word order by score desc, length(term), term) = 1""")
def c28_nearest_keyword(spark, sf_dir):
    """Words of the lines, some of them misspelled, and the equal or nearest keyword of the catalog."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))
    kind = F.col("l_linenumber") % 4
    word = (F.when(kind == 0, F.concat(F.lit("x"), F.substr("w", F.lit(2)))).when(kind == 1, F.concat("w", F.lit("s"))).when(kind == 2, F.left("w", F.length("w") - 1)).otherwise(F.col("w")))
    seen = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(word.alias("word")).distinct()
    return J.nearest_words(seen, parts.select(F.col("w").alias("term")), "word", "term", 0.74, 0.26).select("word", "term", F.round("similarity", 6).alias("score"))


@query("""with s as (select *, regexp_replace(url, '[0-9]+/?([?#].*)?$', '') as stem from pages)
    select stem, min(page_id) as original, count(*) as n, count(*) filter (url <> stem) as variants from s group by stem having count(*) > 1""")
def c31_variant_pairing(spark, sf_dir):
    s = table(spark, sf_dir, "pages").withColumn("stem", F.regexp_replace("url", r"[0-9]+/?([?#].*)?$", ""))
    return s.groupBy("stem").agg(F.min("page_id").alias("original"), F.count("*").alias("n"), F.count_if(F.col("url") != F.col("stem")).alias("variants")).filter("n > 1")


# ---- D: aggregates

@query("""select coalesce(event_type, '*') as source, count(*) as n, count(distinct user_id) as users, count(distinct props) as codes from events group by grouping sets ((event_type), ())""")
def d8_code_stats(spark, sf_dir):
    # two levels of distinct pairs instead of an expanded distinct over every grouping set
    e = table(spark, sf_dir, "events")
    shape = [F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("codes")]
    return e.groupBy(F.col("event_type").alias("source")).agg(*shape).union(e.agg(*shape).select(F.lit("*").alias("source"), "n", "users", "codes"))


@query("""select count(*) as n, count(*) filter (text is null or text = '') as missing, count(*) filter (n_chars <> length(text)) as mismatched,
    min(n_chars) as least, max(n_chars) as most, round(avg(n_chars), 6) as mean from documents""")
def d10_size_audit(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.count_if(t.isNull() | (t == "")).alias("missing"), F.count_if(F.col("n_chars") != F.length(t)).alias("mismatched"),
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("""select o_custkey, coalesce(string_agg(o_orderkey, ',' order by o_orderkey) filter (o_orderstatus = 'F'), '') as finals from orders group by o_custkey""")
def d17_filtered_ordered_list(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))).alias("k"))
    return g.select("o_custkey", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("finals"))


@query("""select s, count(*) as versions, sum(n) as artifacts from (select o_custkey % 20 as s, o_orderstatus, count(*) as n from orders group by 1, 2) group by s""")
def d19_nested_counts(spark, sf_dir):
    inner = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("s"), "o_orderstatus").agg(F.count("*").alias("n"))
    return inner.groupBy("s").agg(F.count("*").alias("versions"), F.sum("n").alias("artifacts"))


@query("""select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)""")
def d23_unused_assets(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query("""select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type""")
def d29_latency_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("""with r as (select l_suppkey, l_partkey, l_discount, rank() over (partition by l_partkey order by l_discount desc) as rk from lineitem)
    select l_suppkey, min(l_discount) as least, round(avg(l_discount), 6) as mean, max(l_discount) as most, min(rk) as best_rank, max(rk) as worst_rank from r group by l_suppkey""")
def d32_history_per_item(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_discount", F.rank().over(W.partitionBy("l_partkey").orderBy(F.desc("l_discount"))).alias("rk"))
    return r.groupBy("l_suppkey").agg(F.min("l_discount").alias("least"), F.round(F.avg("l_discount"), 6).alias("mean"), F.max("l_discount").alias("most"),
                                      F.min("rk").cast("long").alias("best_rank"), F.max("rk").cast("long").alias("worst_rank"))


@query("""select p_name, count(*) as members, min(p_partkey) as first_key from part group by p_name, p_brand, p_type having count(*) > 1""")
def d35_duplicate_signature(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name", "p_brand", "p_type").agg(F.count("*").alias("members"), F.min("p_partkey").alias("first_key")) \
        .filter("members > 1").select("p_name", "members", "first_key")


@query("""select lang, count(*) as n, count(*) filter (regexp_matches(text, '[0-9]')) as digits, count(*) filter (contains(text, '@')) as ats,
    round(avg(case when contains(text, chr(10)) then 1.0 else 0.0 end), 6) as broken_share from documents group by lang""")
def d38_feature_coverage(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(t.rlike("[0-9]")).alias("digits"), F.count_if(F.contains(t, F.lit("@"))).alias("ats"),
        F.round(F.avg(F.when(F.contains(t, F.lit("\n")), 1.0).otherwise(0.0)), 6).alias("broken_share"))


@query("""select case when doc_id % 10 < 7 then 'train' when doc_id % 10 < 9 then 'validation' else 'test' end as split, count(*) as n,
    count(quality) as labelled, count(*) filter (toxic = 1) as toxic from documents left join labels using (doc_id) group by 1""")
def d39_split_counts(spark, sf_dir):
    m = F.col("doc_id") % 10
    split = F.when(m < 7, "train").when(m < 9, "validation").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy(split.alias("split")).agg(
        F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("""select user_id, arg_min(event_type, (ts, event_id)) as origin, arg_max(event_type, (ts, event_id)) as last_action, count(distinct event_type) > 1 as changed from events group by user_id""")
def d45_provenance_fold(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("origin"), F.max_by("event_type", at).alias("last_action"),
                                                                 (F.count_distinct("event_type") > 1).alias("changed"))


@query("""select o_orderpriority as version, count(*) filter (o_orderstatus = 'O') as queued, count(*) filter (o_orderstatus = 'F') as finished from orders group by 1""")
def d46_queue_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("version")).agg(F.count_if(s == "O").alias("queued"), F.count_if(s == "F").alias("finished"))


# ---- E, F, G: ranks, orders, unions

@query("""select user_id, event_id, event_type from events where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def e3_latest_completed(spark, sf_dir):
    return R.latest_per_key(table(spark, sf_dir, "events").filter("event_type = 'purchase'"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""with l as (select user_id, event_id, ts from events where event_type = 'signup' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select e.user_id, count(*) as after_review, min(e.event_id) as first_event from l join events e on e.user_id = l.user_id and e.ts > l.ts group by e.user_id""")
def e7_dependent_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = R.latest_per_key(e.filter("event_type = 'signup'"), "user_id", "ts", "event_id").select("user_id", F.col("ts").alias("reviewed_at"))
    return e.join(last, "user_id").filter("ts > reviewed_at").groupBy("user_id").agg(F.count("*").alias("after_review"), F.min("event_id").alias("first_event"))


@query("""select p_type, p_partkey, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as final_rank from part""")
def e9_final_rank(spark, sf_dir):
    return FU.rank_by(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", ("p_type",), "final_rank").select("p_type", "p_partkey", F.col("final_rank").cast("long").alias("final_rank"))


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as strict_rank from lineitem)
    select l_orderkey, l_linenumber, strict_rank, min(strict_rank) over (partition by l_orderkey, l_partkey) as equivalent_rank from r""")
def e14_equivalent_rank(spark, sf_dir):
    """The outer window's partitioning is met by the inner one's, so there is one shuffle."""
    strict = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")).cast("long")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", strict.alias("strict_rank"))
    return r.select("l_orderkey", "l_linenumber", "strict_rank", F.min("strict_rank").over(W.partitionBy("l_orderkey", "l_partkey")).alias("equivalent_rank"))


@query("""select l_orderkey, l_linenumber, round(l_extendedprice / max(l_extendedprice) over (partition by l_orderkey), 6) as share_of_largest from lineitem""")
def e16_share_of_largest(spark, sf_dir):
    most = F.max("l_extendedprice").over(W.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / most, 6).alias("share_of_largest"))


@query("""select conv_id, max(turn) + 1 as next_revision, count(*) as versions from conversations group by conv_id""")
def e18_next_revision(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_revision"), F.count("*").alias("versions"))


@query("""select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderstatus = 'F' desc, o_orderpriority, o_totalprice desc, o_orderkey) <= 3""")
def f3_candidate_order(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "orders"), "o_custkey", [F.desc(F.col("o_orderstatus") == "F"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("""select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2 or o_orderkey % 7 = 0""")
def f4_shortlist_with_current(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("rn", rn).filter("rn <= 2 or o_orderkey % 7 = 0").select("o_custkey", "o_orderkey")


@query("""select s, p_partkey, margin from ((select 'lowest' as s, p_partkey, round(p_retailprice - p_size, 6) as margin from part order by 3, 2 limit 5)
    union all (select 'highest' as s, p_partkey, round(p_retailprice - p_size, 6) as margin from part order by 3 desc, 2 limit 5))""")
def f7_margin_examples(spark, sf_dir):
    m = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") - F.col("p_size"), 6).alias("margin"))
    low, high = m.orderBy("margin", "p_partkey").limit(5), m.orderBy(F.desc("margin"), "p_partkey").limit(5)
    return low.select(F.lit("lowest").alias("s"), "*").union(high.select(F.lit("highest").alias("s"), "*"))


@query("""select o_orderkey, max(conf) as conf, min(tier) as tier from (select o_orderkey, o_orderstatus as tier, 1 as conf from orders where o_orderstatus = 'F'
    union all select o_orderkey, 'queue', 0 from orders where o_orderpriority like '1%') group by o_orderkey""")
def g2_status_overlay(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderstatus").alias("tier"), F.lit(1).alias("conf"))
    b = o.filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey", F.lit("queue").alias("tier"), F.lit(0).alias("conf"))
    return a.union(b).groupBy("o_orderkey").agg(F.max("conf").alias("conf"), F.min("tier").alias("tier"))


@query("""with b as (select lower(p_name) as t, max(p_size) as conf from part where p_partkey % 3 = 0 group by 1),
    x as (select lower(p_name) as t, max(p_size) as conf from part where p_partkey % 3 <> 0 group by 1)
    select t, conf, 'base' as layer from b union all select t, conf, 'extra' from x where t not in (select t from b)""")
def g7_layer_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("t"), "p_size", (F.col("p_partkey") % 3 == 0).alias("base"))
    b, x = (p.filter(c).groupBy("t").agg(F.max("p_size").alias("conf")) for c in (F.col("base"), ~F.col("base")))
    return b.withColumn("layer", F.lit("base")).union(x.join(b, "t", "left_anti").withColumn("layer", F.lit("extra")))


# ---- H: writes as merges

@query("""with d as (select p_partkey, true as primary_flag from part where p_size > 40), b as (select p_partkey, p_size < 10 as primary_flag from part where p_partkey % 2 = 0)
    select coalesce(b.p_partkey, d.p_partkey) as p_partkey, coalesce(b.primary_flag, false) or coalesce(d.primary_flag, false) as primary_flag from b full join d on b.p_partkey = d.p_partkey""")
def h2_or_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = p.filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") < 10).alias("old"))
    d = p.filter("p_size > 40").select("p_partkey", F.lit(True).alias("new"))
    f = F.lit(False)
    return b.join(d, "p_partkey", "full").select("p_partkey", (F.coalesce("old", f) | F.coalesce("new", f)).alias("primary_flag"))


@query("""select c_custkey, coalesce(s.phase, c_mktsegment) as segment from customer left join (select o_custkey, max(o_orderstatus) filter (o_totalprice > 300000) as phase from orders group by 1) s on o_custkey = c_custkey""")
def h4_coalesce_update(spark, sf_dir):
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_totalprice") > 300000, F.col("o_orderstatus"))).alias("phase"))
    return table(spark, sf_dir, "customer").join(new, "c_custkey", "left").select("c_custkey", F.coalesce("phase", "c_mktsegment").alias("segment"))


@query("""select event_id, kind, round(v, 6) as rating from (select event_id, unnest(['value', 'k']) as kind, unnest([value, cast(json_extract(props, '$.k') as double)]) as v from events) where v is not null and v <= 100""")
def h11_rating_snapshots(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("double")
    both = F.array(F.struct(F.lit("value").alias("kind"), F.col("value").alias("v")), F.struct(F.lit("k").alias("kind"), k.alias("v")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(both).alias("x")).filter("x.v <= 100").select("event_id", "x.kind", F.round("x.v", 6).alias("rating"))


@query("""select page_id, case when url like 'https://%' then 'already' when url like 'http://%' then 'moved' else 'missing' end as state,
    case when url like 'http://%' then 'https://' || substr(url, 8) else url end as new_url from pages""")
def h15_path_rewrite(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.when(u.startswith("https://"), "already").when(u.startswith("http://"), "moved").otherwise("missing").alias("state"),
        F.when(u.startswith("http://"), F.concat(F.lit("https://"), F.substring("url", 8, 1 << 30))).otherwise(u).alias("new_url"))


@query("""select e.event_id, cast(json_extract(props, '$.k') as bigint) as k from events e where event_id not in (select o_orderkey from orders where o_orderstatus = 'F')""")
def h16_backfill_absent(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return table(spark, sf_dir, "events").join(done, "event_id", "left_anti").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---- I, J, K: scalar features

@query("""select event_id, strftime(ts, '%Y-%m-%d') as day, strftime(ts + interval 36 hour, '%Y-%m-%d') as lease_day, ts < timestamp '2024-01-15' as early from events""")
def i27_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format(F.col("ts") + F.expr("interval 36 hours"), "yyyy-MM-dd").alias("lease_day"),
                                                 (F.col("ts") < F.lit("2024-01-15").cast("timestamp")).alias("early"))


@query("""select p_partkey, sha256(p_name || '|' || p_brand || '|' || p_size) as digest from part""")
def i29_row_digest(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string")), 256).alias("digest"))


@query("""select o_orderkey, (o_orderstatus <> 'F')::int + (o_orderpriority like '1%')::int + (o_totalprice > 200000)::int as votes,
    o_orderstatus = 'F' and o_totalprice > 200000 as veto from orders""")
def k9_metric_votes(spark, sf_dir):
    s, big = F.col("o_orderstatus"), F.col("o_totalprice") > 200000
    return table(spark, sf_dir, "orders").select("o_orderkey", ((s != "F").cast("int") + F.col("o_orderpriority").startswith("1").cast("int") + big.cast("int")).alias("votes"),
                                                 ((s == "F") & big).alias("veto"))


# ---- M, N, O: decisions and audits

@query("""select l_orderkey, best, round(gap, 6) as gap, case when best >= 0.5 and (gap >= 0.08 or tags >= 2) then 'accept' else 'abstain' end as decision from
    (select l_orderkey, max(l_discount) * 10 as best, max(l_discount) * 10 - coalesce(max(l_discount, 2)[2], 0) * 10 as gap, count(*) as tags from lineitem group by l_orderkey)""")
def m16_hypothesis_gate(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.slice(F.sort_array(F.collect_list("l_discount"), asc=False), 1, 2).alias("d"), F.count("*").alias("tags"))
    g = g.select("l_orderkey", "tags", (F.col("d")[0] * 10).alias("best"), (F.col("d")[0] * 10 - F.coalesce(F.get("d", F.lit(1)), F.lit(0.0)) * 10).alias("gap"))
    ok = (F.col("best") >= 0.5) & ((F.col("gap") >= 0.08) | (F.col("tags") >= 2))
    return g.select("l_orderkey", "best", F.round("gap", 6).alias("gap"), F.when(ok, "accept").otherwise("abstain").alias("decision"))


@query("""select doc_id, concat_ws(',', case when text is null or trim(text) = '' then 'empty' end, case when length(text) < 200 then 'short' end,
    case when lang is null then 'no_language' end, case when length(text) > 20000 then 'long' end) as flags from documents""")
def n17_failure_flags(spark, sf_dir):
    t, n = F.col("text"), F.length("text")
    flags = F.array(F.when(t.isNull() | (F.trim("text") == ""), "empty"), F.when(n < 200, "short"), F.when(F.col("lang").isNull(), "no_language"), F.when(n > 20000, "long"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_compact(flags), ",").alias("flags"))


@query("""with c as (select unnest([0, 10, 20, 30, 40]) as least_size), s as (select least_size, count(*) as n, round(avg(p_retailprice), 6) as mean from c join part on p_size >= least_size group by 1)
    select * from s where n >= 10 order by mean desc, least_size limit 1""")
def o4_best_config(spark, sf_dir):
    """Five thresholds of a grid: each part is repeated for the thresholds that it meets, so the grid costs one pass and one aggregate."""
    p = table(spark, sf_dir, "part").select("p_retailprice", F.explode(F.filter(F.array(*[F.lit(x) for x in (0, 10, 20, 30, 40)]), lambda x: F.col("p_size") >= x)).alias("least_size"))
    s = p.groupBy("least_size").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))
    return s.filter("n >= 10").orderBy(F.desc("mean"), "least_size").limit(1)


_GRID = """with g as (select row_number() over (order by oi, attr, geom, dino) - 1 as config, * from (select unnest([0, .3, .6]) as oi), (select unnest([0, .2]) as attr), (select unnest([0, .3, .6]) as geom), (select unnest([0, .25, .5]) as dino)),
    l as (select l_orderkey as query, l_orderkey % 5 as dataset, l_linenumber as cid, l_suppkey % 3 = 0 as truth, l_linestatus = 'O' as sibling, l_extendedprice / 100000 as a, l_quantity / 50 as oi_, l_discount * 5 as attr_, l_tax * 5 as geom_, l_partkey % 10 / 10.0 as dino_ from lineitem),
    z as (select query, any_value(dataset) as dataset, arg_max({'t': truth, 's': sibling}, (round(a, 9), -cid)) as b from l group by 1),
    p as (select config, query, arg_max({'t': truth, 's': sibling}, (round(.5 * a + oi * oi_ + attr * attr_ + geom * geom_ + dino * dino_::double, 9), -cid)) as p from l, g group by 1, 2),
    m as (select config, dataset, count(*) as n, count(*) filter (p.t) as exact, count(*) filter (b.t and not p.t) as broken, count(*) filter (p.s and not p.t) as siblings, count(*) filter (b.t) as base_exact, count(*) filter (b.s and not b.t) as base_siblings from p join z using (query) group by 1, 2)"""


def _weight_grid(spark, sf_dir):
    names = ("a", "oi", "attr", "geom", "dino")
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), (F.col("l_orderkey") % 5).alias("dataset"), F.col("l_linenumber").alias("cid"), (F.col("l_suppkey") % 3 == 0).alias("truth"), (F.col("l_linestatus") == "O").alias("sibling"),
        *[x.alias(n) for n, x in zip(names, (F.col("l_extendedprice") / 100000, F.col("l_quantity") / 50, F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_partkey") % 10 / 10))])
    grid = E.weight_grid({"a": (0.5,), "oi": (0.0, 0.3, 0.6), "attr": (0.0, 0.2), "geom": (0.0, 0.3, 0.6), "dino": (0.0, 0.25, 0.5)})
    return E.weight_grid_metrics(li, grid, F.col("a"))


@query(_GRID + " select config::int as config, dataset, n, exact, broken, siblings, base_exact, base_siblings from m")
def o4_weight_grid(spark, sf_dir):
    """The 54 weightings of four terms beside the baseline, five datasets."""
    return _weight_grid(spark, sf_dir)


@query(_GRID + """, c as (select config, round(avg(exact / n), 9) as macro, sum(exact) as exact, sum(broken) as broken, sum(broken) <= .2 * sum(n) and bool_and(dataset <> 1 or exact >= base_exact - 3) and bool_and(dataset <> 3 or exact >= base_exact - 2) and sum(siblings) <= sum(base_siblings) as feasible from m group by 1)
    select config::int as config, round(macro, 7) as macro, exact::bigint as exact, broken::bigint as broken, feasible, (select count(*) from c where feasible) as n_feasible from c order by feasible desc, c.macro desc, exact desc, broken, config limit 1""")
def o4_selected_weights(spark, sf_dir):
    """The best of them under the constraints, and how many meet these."""
    m, allowance = _weight_grid(spark, sf_dir), {1: 3, 3: 2}
    met = E.feasible_weights(m, allowance).agg(F.count_if("feasible").alias("n_feasible"))
    return E.select_weights(m, allowance).crossJoin(F.broadcast(met)).withColumn("macro", F.round("macro", 7))  # one row each


@query("""with a as (select l_orderkey, arg_max(l_linenumber, (l_extendedprice, l_linenumber)) as top1 from lineitem group by 1),
    b as (select l_orderkey, arg_max(l_linenumber, (l_quantity, l_linenumber)) as top1 from lineitem group by 1)
    select l_orderkey, a.top1 as before, b.top1 as after from a join b using (l_orderkey) where a.top1 <> b.top1""")
def o8_changed_decisions(spark, sf_dir):
    # both variants come out of one aggregate, no join
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("before"),
                                                                   F.max_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("after"))
    return g.filter("before <> after")


@query("""select count(*) as n, count(*) filter (regexp_extract(url, '://([^/]*)', 1) is distinct from regexp_extract(url, '://([^/?#]*)', 1)) as host_drift,
    count(*) filter (regexp_extract(url, '([0-9]+)$', 1) is distinct from regexp_extract(url, '/([0-9]+)', 1)) as id_drift from pages""")
def o9_parser_drift(spark, sf_dir):
    def drift(a, b):
        return F.count_if(~F.regexp_extract("url", a, 1).eqNullSafe(F.regexp_extract("url", b, 1)))
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("n"), drift("://([^/]*)", "://([^/?#]*)").alias("host_drift"), drift("([0-9]+)$", "/([0-9]+)").alias("id_drift"))


# ---- P, Q: datasets and audits

@query("""with g as (select sha256(text) as h, doc_id from documents where text is not null), r as (select h, min(doc_id) as anchor, count(*) as n from g group by h having count(*) > 1)
    select r.anchor, g.doc_id, n from g join r using (h) where g.doc_id <> r.anchor""")
def p1_forbidden_members(spark, sf_dir):
    """Members of an equal-content group against its anchor: the group stands for its pairs, which are never listed."""
    g = table(spark, sf_dir, "documents").filter("text is not null").select(F.sha2("text", 256).alias("h"), "doc_id")
    r = g.groupBy("h").agg(F.min("doc_id").alias("anchor"), F.count("*").alias("n")).filter("n > 1")
    return g.join(r, "h").filter("doc_id <> anchor").select("anchor", "doc_id", "n")


_FORBIDDEN = """with d as (select doc_id, sha256(text) as h, source, n_chars, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) as lead from documents),
    g as (select distinct h as grp, 'identical_content' as reason, false as soft, doc_id as key from d where h is not null union select distinct lead, 'same_series', false, doc_id from d where lead is not null union select distinct source || ':' || (n_chars // 50), 'similar_length', true, doc_id from d where source is not null and n_chars is not null),
    m as (select * from g qualify count(*) over (partition by grp, reason) > 1),"""


def _forbidden(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source", "n_chars", F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(2))).alias("lead"))
    series = d.filter("lead is not null").select(F.col("lead").alias("group"), F.lit("same_series").alias("reason"), F.col("doc_id").alias("key"))
    length = d.filter("source is not null and n_chars is not null").select(F.concat("source", F.lit(":"), F.expr("n_chars div 50").cast("string")).alias("group"), F.lit("similar_length").alias("reason"), F.col("doc_id").alias("key"))
    return D.forbidden_membership(d, "doc_id", "h", series.union(length), ["similar_length"])


@query(_FORBIDDEN + " z as (select 1) select grp as \"group\", reason, soft as hard_only, count(*) as members, min(key) as first from m group by 1, 2, 3")
def p1_forbidden_groups(spark, sf_dir):
    """Groups of equal content, of one series (equal first words) and, against hard negatives only, of similar length in one source."""
    return _forbidden(spark, sf_dir).groupBy("group", "reason", "hard_only").agg(F.count("*").alias("members"), F.min("key").alias("first"))


@query(_FORBIDDEN + """ pairs as (select x.key as a, y.key as b, list_sort(list(distinct x.reason)) as reasons, bool_and(x.soft) as soft from m x join m y on x.grp = y.grp and x.reason = y.reason and x.key <> y.key group by 1, 2),
    c as (select doc_id as a, doc_id + k as b from documents, generate_series(0, 40) t(k) where doc_id + k in (select doc_id from documents))
    select a, b, coalesce(array_to_string(reasons, ','), '') as reasons, a <> b and coalesce(soft, true) as negative, a <> b and reasons is null as hard_negative from c left join pairs using (a, b)""")
def p1_pair_verdicts(spark, sf_dir):
    """Every document and the forty that follow it as candidate pairs; the oracle lists all forbidden pairs."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    c = ids.select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.col("doc_id"), F.col("doc_id") + 40)).alias("b")).join(ids.withColumnRenamed("doc_id", "b"), "b", "left_semi")
    return D.pair_verdicts(c, _forbidden(spark, sf_dir), "a", "b").withColumn("reasons", F.array_join("reasons", ","))


@query("""select lang, quality, count(*) as n, count(*) filter (toxic = 1) as excluded from documents join labels using (doc_id) group by lang, quality""")
def p5_policy_report(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(
        F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("excluded"))


@query("""select o_orderkey, case when n is null then 'inconsistent' when o_orderstatus = 'F' and late > 0 then 'failed' else 'success' end as state from orders
    left join (select l_orderkey, count(*) as n, count(*) filter (l_linestatus = 'O') as late from lineitem group by 1) on l_orderkey = o_orderkey""")
def q9_binding_audit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("late"))
    state = F.when(F.col("n").isNull(), "inconsistent").when((F.col("o_orderstatus") == "F") & (F.col("late") > 0), "failed").otherwise("success")
    return table(spark, sf_dir, "orders").join(li, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


# ---- R: batch twins of stream rules

@query("""select event_id, round(least(greatest(.32 * (k / 100) + .34 * least(value / 500, 1) + .18 * (case when event_type = 'click' then 1 else 0 end) + .16, 0), 1), 6) as score
    from (select event_id, value, event_type, coalesce(cast(json_extract(props, '$.k') as double), 0) as k from events)""")
def r10_frame_score(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    score = 0.32 * (k / 100) + 0.34 * F.least(F.col("value") / 500, F.lit(1.0)) + 0.18 * (F.col("event_type") == "click").cast("int") + 0.16
    return table(spark, sf_dir, "events").select("event_id", F.round(GEO.clamp(score), 6).alias("score"))


@query("""select user_id, round(avg(value), 6) as confidence from (select user_id, value from events qualify row_number() over (partition by user_id order by value desc, event_id) <= 8) group by user_id""")
def r15_session_confidence(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "events"), "user_id", [F.desc("value"), "event_id"], 8).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("confidence"))
