"""Text, array and geometry function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import geometry as K
from tessera.functions import text as T
from tessera.operators import regions
from tessera.plans.registry import query
from tessera.session import table


def _pairs(spark, sf_dir):
    """Part names next to the name 13 keys on."""
    p = table(spark, sf_dir, "part")
    q = p.select((F.col("p_partkey") - 13).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", F.col("p_name").alias("a"), F.col("other").alias("b"))


_PAIRS = "with p as (select x.p_partkey, x.p_name as a, y.p_name as b from part x join part y on y.p_partkey = x.p_partkey + 13) "


@query("""select doc_id, trim(regexp_replace(translate(lower(text), 'ё', 'е'), '[^\\p{L}\\p{N}]+', ' ', 'g')) as norm from documents""")
def i1_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_match_text("text").alias("norm"))


@query("""select doc_id, length(text) - length(replace(text, '.', '')) as stops, len(regexp_extract_all(text, '[A-Z]')) as capitals from documents""")
def i2_character_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("long").alias("stops"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("capitals"))


@query("""with t as (select page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&((amp|AMP|middot|copy|COPY|nbsp|lt|LT|gt|GT|quot|QUOT|laquo|raquo|#39|#[xX]27);?|(hellip|ndash|mdash|lsquo|rsquo|ldquo|rdquo|euro);)', ' ', 'g') as t from pages)
    select page_id, coalesce(array_to_string(regexp_extract_all(replace(lower(t), 'ß', 'ss'), '[\\p{L}\\p{N}]+'), ' '), '') as norm from t""")
def i2_normalized(spark, sf_dir):
    """Pages, as they hold tags and character references; those that HTML also reads without their semicolon (``&amp``) are decoded too."""
    return table(spark, sf_dir, "pages").select("page_id", T.normalized("html").alias("norm"))


@query("""select o_orderkey, array_to_string(list_sort(list_distinct([(1990 + o_orderkey % 40)::varchar, '2001', strftime(o_orderdate, '%Y')])), ',') as years from orders""")
def i8_year_set(spark, sf_dir):
    """Digits that belong to longer numbers are no years."""
    text = F.concat(F.lit("of "), (F.col("o_orderkey") % 40 + 1990).cast("string"), F.lit(", no. 120034 (2001), 2001/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" x19991"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.year_set(text), ",").alias("years"))


@query("""select n_name, translate(lower(n_name), 'аеорсух', 'aeopcyx') as folded, lower(n_name) as latin from nation""")
def i3_transliterate(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", T.fold_lookalikes(F.lower("n_name")).alias("folded"), T.transliterate("n_name").alias("latin"))


@query("""select p_partkey, list_aggregate(list_sort(list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))), 'string_agg', ' ') as tokens from part""")
def i5_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.tokens(F.concat_ws(" ", "p_name", "p_type"))), " ").alias("tokens"))


@query("""select p_partkey, case string_split(p_name, ' ')[1] when 'red' then 'crimson' when 'blue' then 'azure' else string_split(p_name, ' ')[1] end as first from part""")
def i6_synonyms(spark, sf_dir):
    t = T.canonical(F.split("p_name", " "), {"red": "crimson", "blue": "azure"})
    return table(spark, sf_dir, "part").select("p_partkey", F.get(t, F.lit(0)).alias("first"))


@query("""select o_orderkey, try_cast(regexp_extract('order of ' || strftime(o_orderdate, '%Y-%m-%d'), '((?:19|20)[0-9]{2})', 1) as int) as year from orders""")
def i8_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.first_year(F.concat(F.lit("order of "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year"))


@query("""select p_partkey, case when p_type like '%ECONOMY%' then 'economy' when p_size > 30 then 'large' when p_name like '%bolt%' then 'bolt' else 'other' end as style from part""")
def i9_classifier(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_type").rlike("ECONOMY"), "economy").when(F.col("p_size") > 30, "large").when(F.col("p_name").rlike("bolt"), "bolt").otherwise("other").alias("style"))


_LINES = """with t as (select p_partkey, case p_size % 7 when 0 then (1980 + p_size)::varchar when 1 then (4600000000 + p_partkey)::varchar when 2 then (p_size / 2.0)::varchar || ' %' when 3 then (p_size * 10)::varchar || ' ml' when 4 then p_size || ' - ' || p_partkey % 9 when 5 then p_name else '?!' end as t from part) """


@query(_LINES + r"""select p_partkey, case when regexp_matches(t, '^(19|20)[0-9]{2}$') then 'year' when regexp_matches(t, '^[0-9]{8,14}$') then 'barcode' when regexp_matches(t, '[0-9]+([.,][0-9]+)?\s*%') then 'percentage'
    when regexp_matches(t, '[0-9]+([.,][0-9]+)?\s*(ml|l)(\W|$)') then 'volume' when regexp_matches(t, '^[0-9\s.,-]+$') then 'number' when regexp_matches(t, '\p{L}') then 'text' else 'other' end as kind from t""")
def i10_text_type(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    kinds = {0: (s + 1980).cast("string"), 1: (k + 4600000000).cast("string"), 2: F.concat((s / 2).cast("decimal(5,1)").cast("string"), F.lit(" %")), 3: F.concat((s * 10).cast("string"), F.lit(" ml")),
             4: F.concat(s.cast("string"), F.lit(" - "), (k % 9).cast("string")), 5: F.col("p_name"), 6: F.lit("?!")}
    text = F.coalesce(*[F.when(s % 7 == i, t) for i, t in kinds.items()])
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", T.text_type("t")["kind"].alias("kind"))


@query(_PAIRS + "select p_partkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b))::double, 6) as sim from p")
def i12_edit_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.edit_similarity("a", "b"), 6).alias("sim"))


@query(_PAIRS + """, x as (select p_partkey, substr(a, i, 2) as g, count(*) as c from p, generate_series(1, 40) t(i) where i < length(a) group by all),
    y as (select p_partkey, substr(b, i, 2) as g, count(*) as c from p, generate_series(1, 40) t(i) where i < length(b) group by all),
    s as (select x.p_partkey, sum(least(x.c, y.c)) as common from x join y using (p_partkey, g) group by 1)
    select p_partkey, round(2.0 * coalesce(common, 0) / (length(a) + length(b) - 2), 6) as dice from p left join s using (p_partkey)""")
def i14_dice(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.dice("a", "b"), 6).alias("dice"))


@query(_PAIRS + "select p_partkey, case when a = b then 1.0 when starts_with(a, b) or starts_with(b, a) then 0.82 else 0.0 end::double as sim from p")
def i15_prefix(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", T.prefix_similarity("a", "b").alias("sim"))


@query(_PAIRS + """, s as (select p_partkey, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) as i, len(list_distinct(string_split(a || ' ' || b, ' '))) as u from p)
    select p_partkey, round(i / u::double, 6) as jaccard from s""")
def i16_jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.jaccard(F.split("a", " "), F.split("b", " ")), 6).alias("jaccard"))


@query(_PAIRS + """select p_partkey, round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / greatest(len(string_split(a, ' ')), len(string_split(b, ' ')))::double, 6) as overlap from p""")
def i17_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.round(T.overlap_of_larger(F.split("a", " "), F.split("b", " ")), 6).alias("overlap"))


@query("""select p_partkey, case when p_name = t then 1.0 when contains(p_name, t) then 0.85 else 0.0 end::double as score from (select p_partkey, p_name, string_split(p_name, ' ')[1] as t from part)""")
def i18_substring(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.substring_score("p_name", F.get(F.split("p_name", " "), F.lit(0))).alias("score"))


@query("""with t as (select conv_id, turn, string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') as w from conversations) select conv_id, turn, case when trim(array_to_string(w, '')) = '' then 0 else greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) end as n from t""")
def i19_ngrams(spark, sf_dir):
    w = F.filter(F.split(T.normalize_match_text("text"), " "), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.token_ngrams(w)).cast("long").alias("n"))


@query("""select page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) as base from pages""")
def i23_basename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.basename("url").alias("base"))


@query("""select p_partkey, substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-' || substr(md5(p_name), 13, 4) || '-' || substr(md5(p_name), 17, 4) || '-' || substr(md5(p_name), 21, 12) as uid from part""")
def i30_uuid(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.deterministic_uuid("p_name").alias("uid"))


@query("""with recursive f as (select c_custkey, c_name as s, 0 as i, 2166136261::hugeint as h from customer union all
    select c_custkey, s, i + 1, (xor(h::bigint, ascii(substr(s, i + 1, 1))::bigint)::hugeint * 16777619) % 4294967296 from f where i < length(s)),
    g as (select c_custkey, h % 100 as b from f where i = length(s)) select case when b < 70 then 'train' when b < 90 then 'validation' else 'test' end as split, count(*) as n from g group by 1""")
def i28_hash_split(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(T.split_of("c_name").alias("split")).agg(F.count("*").alias("n"))


@query("""select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), -1) as k, coalesce(cast(json_extract(props, '$.missing') as bigint), -1) as d from events""")
def j1_json_path(spark, sf_dir):
    v = F.parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.variant_get(v, "$.k", "bigint"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "bigint"), F.lit(-1)).alias("d"))


@query("""select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderkey) filter (o_orderstatus = 'F') as accepted from orders group by 1""")
def j2_filtered_children(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    kept = F.transform(F.filter("o", lambda x: x["o_orderstatus"] == "F"), lambda x: x["o_orderkey"].cast("string"))
    return g.select("o_custkey", F.when(F.size(kept) > 0, F.array_join(kept, ",")).alias("accepted"))


@query("""select user_id, string_agg(event_type || '=' || m, ',' order by event_type) as best from (select user_id, event_type, cast(max(value) as decimal(18, 2))::varchar as m from events group by all) group by 1""")
def j4_max_map(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").cast("decimal(18,2)").cast("string").alias("m"))
    return g.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "m"))), lambda x: F.concat_ws("=", x["event_type"], x["m"])), ",").alias("best"))


@query(_PAIRS + """, s as (select p_partkey, list_sort(list_intersect(string_split(a, ' '), string_split(b, ' '))) as m, list_sort(list_distinct(string_split(a, ' '))) as x from p)
    select p_partkey, array_to_string(m, ' ') as matched, len(x) - len(m) as missing from s""")
def j5_matched_sets(spark, sf_dir):
    a, b = F.split("a", " "), F.split("b", " ")
    return _pairs(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(F.array_intersect(a, b)), " ").alias("matched"), F.size(F.array_except(a, b)).cast("long").alias("missing"))


def _boxes(spark, sf_dir):
    """Rectangles derived from lineitem: one image per order, one box per line."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("long").alias("box_id"), F.col("l_partkey"),
        (F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 30).cast("double").alias("y"),
        (F.col("l_quantity") + 5).alias("width"), (F.col("l_quantity") / 2 + 8).alias("height"), (F.col("l_extendedprice") / 110000).alias("score"))


_BOXES = """with b as (select l_orderkey as image, l_linenumber as box_id, l_partkey, (l_partkey % 40)::double as x, (l_suppkey % 30)::double as y, l_quantity + 5 as w, l_quantity / 2 + 8 as h,
    l_extendedprice / 110000 as score from lineitem) """


@query(_BOXES + """, p as (select a.image, a.box_id as a, b.box_id as b, a.l_partkey as pa, b.l_partkey as pb, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) as i,
    a.w * a.h as aa, b.w * b.h as ab from b a join b on a.image = b.image and (a.box_id, a.l_partkey) < (b.box_id, b.l_partkey))
    select image, a, b, pa, pb, round(i, 4) as shared, round(aa + ab - i, 4) as joint, i / aa >= .62 as covered from p where i > 0""")
def k1_rectangle_join(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("image", "box_id", "l_partkey", F.struct("x", "y", "width", "height").alias("r"))
    a, c = b.alias("a"), b.alias("c")
    j = a.join(c, F.expr("a.image = c.image and (a.box_id < c.box_id or (a.box_id = c.box_id and a.l_partkey < c.l_partkey))"))
    j = j.select("a.image", F.col("a.box_id").alias("a"), F.col("c.box_id").alias("b"), F.col("a.l_partkey").alias("pa"), F.col("c.l_partkey").alias("pb"), F.col("a.r").alias("ra"), F.col("c.r").alias("rc"))
    return j.filter(K.intersection("ra", "rc") > 0).select("image", "a", "b", "pa", "pb", F.round(K.intersection("ra", "rc"), 4).alias("shared"), F.round(K.area("ra") + K.area("rc") - K.intersection("ra", "rc"), 4).alias("joint"), (K.coverage("ra", "rc") >= 0.62).alias("covered"))


@query("""select l_orderkey, l_linenumber, l_partkey, round(case when l_quantity <= 5 or l_quantity >= 48 then 0 when l_quantity < 15 then (l_quantity - 5) / 10 when l_quantity > 38 then (48 - l_quantity) / 10 else 1 end, 6)::double as fit from lineitem""")
def k2_band_fit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(K.band("l_quantity", 5, 15, 38, 48), 6).cast("double").alias("fit"))


@query(_BOXES + """select image, box_id, l_partkey, round(.4 * least(score, 1) + .3 * least(w / 55, 1) + .3 * (1 - least(sqrt(pow(x + w / 2 - 30, 2) + pow(y + h / 2 - 25, 2)) / 60, 1)), 6) as object_score from b""")
def k3_object_score(spark, sf_dir):
    frame = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(60.0).alias("width"), F.lit(50.0).alias("height"))
    near = 1 - F.least(K.centre_distance(F.struct("x", "y", "width", "height"), frame) / 60, F.lit(1.0))
    return _boxes(spark, sf_dir).select("image", "box_id", "l_partkey", F.round(0.4 * F.least("score", F.lit(1.0)) + 0.3 * F.least(F.col("width") / 55, F.lit(1.0)) + 0.3 * near, 6).alias("object_score"))


@query()
def k6_suppress(spark, sf_dir):
    """Greedy suppression depends on order inside an image; tests compare it with a plain loop."""
    return regions.suppress(_boxes(spark, sf_dir).select("image", F.expr("(image * 10 + box_id) * 100000 + l_partkey").alias("box_id"), "x", "y", "width", "height", "score"), 0.3)


@query()
def d40_consensus(spark, sf_dir):
    """Greedy grouping inside an image; tests compare it with a plain loop."""
    b = _boxes(spark, sf_dir)
    return regions.consensus(b.select("image", (F.col("l_partkey") % 4).cast("string").alias("text"), "x", "y", "width", "height", "score"))


@query("""select l_partkey, round(sum(least(v, 1) * w), 6) as total, max(v > 1)::int as capped from (select l_partkey, l_quantity / 40 as v, .5 as w from lineitem union all select l_partkey, l_discount * 12, .3 from lineitem) group by 1""")
def k11_capped_sum(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    terms = F.array(F.struct((F.col("l_quantity") / 40).alias("v"), F.lit(0.5).alias("w")), F.struct((F.col("l_discount") * 12).alias("v"), F.lit(0.3).alias("w")))
    t = li.select("l_partkey", F.explode(terms).alias("t")).select("l_partkey", "t.v", "t.w")
    return t.groupBy("l_partkey").agg(F.round(F.sum(F.least("v", F.lit(1.0)) * F.col("w")), 6).alias("total"), F.max((F.col("v") > 1).cast("int")).alias("capped"))
