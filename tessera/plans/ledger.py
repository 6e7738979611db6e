"""Ledger queries: clause features, change attribution, fingerprints, insertions, id allocation, snapshots and invariants."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.registry import query
from tessera.session import table

#: Letters of two scripts that look alike, in the same order.
LATIN, CYRILLIC = "aceopxyABCEHKMOPTX", "асеорхуАВСЕНКМОРТХ"


# ---- B: predicates

@query("""select doc_id, len([c for c in string_split(text, '.') if regexp_matches(c, '[0-9]') and not contains(c, '@')]) as clauses from documents where text is not null""")
def b15_clauses_with_exclusion(spark, sf_dir):
    hits = F.filter(F.split("text", r"\."), lambda c: c.rlike("[0-9]") & ~F.contains(c, F.lit("@")))
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(hits).cast("long").alias("clauses"))


# ---- C: joins

@query("""with b as (select o_orderkey, o_orderstatus as before from orders), a as (select o_orderkey, case when o_totalprice > 250000 then 'H'
      when o_orderpriority like '1%' then 'U' else o_orderstatus end as after, case when o_totalprice > 250000 then 'price' when o_orderpriority like '1%' then 'urgent' end as rule from orders)
    select o_orderkey, before, after, rule from b join a using (o_orderkey) where before is distinct from after""")
def c32_change_attribution(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    dear, urgent = F.col("o_totalprice") > 250000, F.col("o_orderpriority").startswith("1")
    after = o.select("o_orderkey", F.when(dear, "H").when(urgent, "U").otherwise(F.col("o_orderstatus")).alias("after"), F.when(dear, "price").when(urgent, "urgent").alias("rule"))
    before = o.select("o_orderkey", F.col("o_orderstatus").alias("before"))
    return before.join(after, "o_orderkey").filter(~F.col("before").eqNullSafe(F.col("after"))).select("o_orderkey", "before", "after", "rule")


# ---- D: aggregates

@query("""select source, count(*) as n, count(*) filter (n_chars is distinct from length(text)) as mismatched,
    coalesce(min(doc_id) filter (n_chars is distinct from length(text)), -1) as first_mismatch from documents group by source""")
def d11_size_mismatches(spark, sf_dir):
    wrong = ~F.col("n_chars").eqNullSafe(F.length("text").cast("long"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(wrong).alias("mismatched"), F.coalesce(F.min(F.when(wrong, F.col("doc_id"))), F.lit(-1).cast("long")).alias("first_mismatch"))


@query("""select count(*) as n, cast(sum(cast('0x' || substr(sha256(p_partkey || '|' || p_name || '|' || p_size), 1, 8) as bigint)) as bigint) as digest from part""")
def d33_table_fingerprint(spark, sf_dir):
    """Order-free: row digests are added, so that tasks combine their sums."""
    row = F.sha2(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("string")), 256)
    return table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")).alias("digest"))


@query("""with l as (select l_suppkey as sup, l_partkey as item from lineitem union select p_size % 10 + 1, p_partkey from part)
    select sup, count(*) as items, count(distinct p_brand) as signatures from l join part on p_partkey = item group by sup having count(*) > 1""")
def d34_many_to_one(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sup"), F.col("l_partkey").alias("item"))
    plausible = part.select((F.col("p_size") % 10 + 1).cast("long").alias("sup"), F.col("p_partkey").alias("item"))
    signed = links.union(plausible).distinct().join(part.select(F.col("p_partkey").alias("item"), "p_brand"), "item")
    return signed.groupBy("sup").agg(F.count("*").alias("items"), F.count_distinct("p_brand").alias("signatures")).filter("items > 1")


@query("""select event_type, count(*) as n, round(avg(value), 6) as mean, count(*) filter (value < 10) as weak, round(avg(case when props is null then 0.0 else 1.0 end), 6) as covered from events group by event_type""")
def d41_evidence_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") < 10).alias("weak"),
        F.round(F.avg(F.col("props").isNotNull().cast("double")), 6).alias("covered"))


@query("""select l_returnflag as scope, l_linestatus as state, count(*) as n, round(sum(l_quantity) * 0.5, 6) as cost from lineitem group by 1, 2""")
def d44_cost_by_scope(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("scope"), F.col("l_linestatus").alias("state")).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity") * 0.5, 6).alias("cost"))


# ---- E, F, G: ranks, orders, unions

@query("""select l_partkey, l_orderkey, l_linenumber from lineitem where l_returnflag = 'N' qualify row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) = 1""")
def e4_latest_verified(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'")
    return R.first_per_key(li, "l_partkey", [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""select o_custkey, o_orderkey from orders where o_orderstatus = 'F' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def e5_latest_finished(spark, sf_dir):
    return R.latest_per_key(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""with r as (select p_partkey, p_type, row_number() over (partition by p_type order by p_size desc, p_partkey) as rk from part)
    select p_partkey, rk, case when rk <= 3 then 'high' when rk <= 10 then 'medium' else 'low' end as priority from r""")
def e13_diagnostic_priority(spark, sf_dir):
    rk = F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("p_size"), "p_partkey")).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", rk.alias("rk")).withColumn(
        "priority", F.when(F.col("rk") <= 3, "high").when(F.col("rk") <= 10, "medium").otherwise("low"))


@query("""with d as (select l_orderkey, l_linenumber, l_partkey, cast(round(l_discount * 1000000) as bigint) as d from lineitem),
    c as (select *, count(*) over (partition by l_orderkey order by d desc range between unbounded preceding and 1 following)
      - count(*) over (partition by l_orderkey, l_partkey order by d desc range between unbounded preceding and 1 following) as unexplained from d)
    select l_orderkey, l_linenumber, l_partkey, unexplained from c where unexplained > 0""")
def e15_self_sanity(spark, sf_dir):
    """Lines of other parts ranked at or above a line within 1e-6, in whole millionths.  Range frames count them, so no pairs of an order are listed."""
    def above(*keys):
        return F.count("*").over(W.partitionBy(*keys).orderBy(F.desc("d")).rangeBetween(W.unboundedPreceding, 1))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_discount") * 1000000).cast("long").alias("d"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", (above("l_orderkey") - above("l_orderkey", "l_partkey")).alias("unexplained")).filter("unexplained > 0")


@query("""select p_partkey, p_name from part order by lower(coalesce(p_name, '')), p_brand, p_partkey limit 50""")
def f6_title_order(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.lower(F.coalesce("p_name", F.lit(""))), "p_brand", "p_partkey").limit(50).select("p_partkey", "p_name")


@query("""select p_partkey, p_name, l_orderkey, l_linenumber, l_extendedprice from lineitem join part on p_partkey = l_partkey order by l_extendedprice desc, l_orderkey, l_linenumber limit 20""")
def f8_top_matches(spark, sf_dir):
    """Every line has its part, so the limit goes before the join and twenty rows are joined."""
    top = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_partkey").alias("p_partkey"))
    top = top.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "left_semi").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(F.broadcast(top), "p_partkey")


@query("""with t as (select p_type, p_partkey, p_name from part qualify row_number() over (partition by p_type order by p_retailprice desc, p_partkey) <= 10),
    w as (select distinct p_type, p_partkey, unnest(string_split(p_name, ' ')) as word from t) select p_type, word, count(*) as n from w group by 1, 2""")
def f10_family_tokens(spark, sf_dir):
    top = R.first_per_key(table(spark, sf_dir, "part"), "p_type", [F.desc("p_retailprice"), "p_partkey"], 10)
    return top.select("p_type", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word")).groupBy("p_type", "word").agg(F.count("*").alias("n"))


@query("""select sha256(text) as content, max(doc_id) as kept, count(*) as n from documents where text is not null group by 1 having count(distinct coalesce(lang, '')) = 1""")
def g5_trainable_subset(spark, sf_dir):
    """The last of equal contents is kept; contents with two languages are a conflict and go."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select(F.sha2("text", 256).alias("content"), "doc_id", F.coalesce("lang", F.lit("")).alias("l"))
    # least and greatest language stand for the distinct count and combine before the shuffle
    return d.groupBy("content").agg(F.max("doc_id").alias("kept"), F.count("*").alias("n"), (F.min("l") == F.max("l")).alias("one")).filter("one").drop("one")


# ---- H: writes as merges

@query("""with b as (select p_partkey, p_brand, 'base' as layer from part where p_partkey % 2 = 0), d as (select p_partkey, p_brand, 'new' as layer from part where p_size > 25)
    select * from b union all select * from d where p_partkey not in (select p_partkey from b)""")
def h3_insert_absent(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = p.filter("p_partkey % 2 = 0").select("p_partkey", "p_brand", F.lit("base").alias("layer"))
    d = p.filter("p_size > 25").select("p_partkey", "p_brand", F.lit("new").alias("layer"))
    return b.union(d.join(b, "p_partkey", "left_anti"))


@query("""with b as (select p_partkey, p_size from part where p_partkey % 3 <> 0), d as (select p_partkey, p_size + (p_partkey % 5 = 0)::int as new_size from part where p_partkey % 2 = 0)
    select case when b.p_partkey is null then 'insert' when d.p_partkey is null then 'untouched' when p_size = new_size then 'same' else 'update' end as action, count(*) as n
    from b full join d on b.p_partkey = d.p_partkey group by 1""")
def h9_dry_run_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = p.filter("p_partkey % 3 <> 0").select("p_partkey", "p_size")
    d = p.filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).alias("new_size"))
    action = F.when(F.col("p_size").isNull(), "insert").when(F.col("new_size").isNull(), "untouched").when(F.col("p_size") == F.col("new_size"), "same").otherwise("update")
    return b.join(d, "p_partkey", "full").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("""select p_partkey, (select max(p_partkey) from part) + row_number() over (order by p_brand, p_name, p_partkey) as new_id from part where p_size > 40""")
def h13_allocate_ids(spark, sf_dir):
    """Gapless ids without a global window: a row's rank in its brand, after the counts of earlier brands (a table of a few dozen brands)."""
    p = table(spark, sf_dir, "part")
    new = p.filter("p_size > 40").select("p_partkey", "p_brand", "p_name")
    rank = F.row_number().over(W.partitionBy("p_brand").orderBy("p_name", "p_partkey"))
    counts = new.groupBy("p_brand").agg(F.count("*").alias("c")).crossJoin(p.agg(F.max("p_partkey").alias("top")))
    offset = counts.select("p_brand", (F.sum("c").over(W.orderBy("p_brand").rowsBetween(W.unboundedPreceding, 0)) - F.col("c") + F.col("top")).alias("offset"))
    return new.withColumn("rank", rank).join(offset, "p_brand").select("p_partkey", (F.col("offset") + F.col("rank")).alias("new_id"))


# ---- I: text features

@query(f"""select p_partkey, translate(p_name, '{LATIN}', '{CYRILLIC}') as folded, translate(translate(p_name, '{LATIN}', '{CYRILLIC}'), '{CYRILLIC}', '{LATIN}') as unfolded from part""")
def i4_confusables(spark, sf_dir):
    folded = F.translate("p_name", LATIN, CYRILLIC)
    return table(spark, sf_dir, "part").select("p_partkey", folded.alias("folded"), F.translate(folded, CYRILLIC, LATIN).alias("unfolded"))


@query(r"""select doc_id, sha256(regexp_replace(regexp_replace(text, '([a-z])0([a-z])', '\1o\2', 'g'), ' +', ' ', 'g')) as digest from documents where text is not null""")
def i7_typo_fixes(spark, sf_dir):
    fixed = F.regexp_replace(F.regexp_replace("text", "([a-z])0([a-z])", "$1o$2"), " +", " ")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2(fixed, 256).alias("digest"))


@query("""select event_id, case event_type when 'purchase' then 1.0 when 'click' then 0.5 when 'view' then 0.25 else 0.0 end as fit from events""")
def i11_type_fit(spark, sf_dir):
    fit = F.create_map(*[F.lit(x) for x in ("purchase", 1.0, "click", 0.5, "view", 0.25)])
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(fit, F.col("event_type")), F.lit(0.0)).alias("fit"))


@query("""with w as (select distinct item_id, unnest(string_split(lower(text), ' ')) as w from benchmark),
    k as (select * from w where length(w) >= 4 qualify row_number() over (partition by item_id order by length(w) desc, w) <= 6)
    select item_id, string_agg(w, ' ' order by length(w) desc, w) as keywords from k group by item_id""")
def i21_keywords(spark, sf_dir):
    words = F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: F.length(w) >= 4)
    ranked = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 6)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(ranked["w"], " ").alias("keywords")).filter("keywords <> ''")


# ---- P, Q, R: datasets, invariants, batch twins of stream rules

@query("""with s as (select doc_id, cast('0x' || substr(sha256(cast(doc_id as varchar)), 1, 8) as bigint) % 10 as b from documents)
    select case when b < 8 then 'train' when b = 8 then 'validation' else 'test' end as split, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from s group by 1""")
def p7_split_manifest(spark, sf_dir):
    b = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 10
    split = F.when(b < 8, "train").when(b == 8, "validation").otherwise("test")
    return table(spark, sf_dir, "documents").groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("""select o_orderkey, sha256(o_orderstatus || '|' || coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey), '')) as snapshot
    from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderstatus""")
def p8_frozen_snapshot(spark, sf_dir):
    """Layers are folded per item before the join, so each side is shuffled once."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    layer = F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"))), ",")
    return table(spark, sf_dir, "orders").join(li, "o_orderkey", "left").select(
        "o_orderkey", F.sha2(F.concat("o_orderstatus", F.lit("|"), F.coalesce(layer, F.lit(""))), 256).alias("snapshot"))


@query("""select 'repeated_key' as invariant, (select count(*) from (select p_partkey from part group by 1 having count(*) > 1)) as violations
    union all select 'empty_name', (select count(*) from part where coalesce(trim(p_name), '') = '')
    union all select 'orphan_line', (select count(*) from lineitem where l_partkey not in (select p_partkey from part))
    union all select 'bad_discount', (select count(*) from lineitem where l_discount < 0 or l_discount > 1)""")
def q8_plan_invariants(spark, sf_dir):
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    bad = {"repeated_key": p.groupBy("p_partkey").count().filter("count > 1"), "empty_name": p.filter("coalesce(trim(p_name), '') = ''"),
           "orphan_line": li.join(p.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti"), "bad_discount": li.filter("l_discount < 0 or l_discount > 1")}
    return R.union_aligned(*[df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("invariant"), "violations") for name, df in bad.items()])


@query("""select user_id, event_type, round(least(1.0, max(value) / 500 + 0.06 * (count(*) - 1)), 6) as score from events group by 1, 2""")
def r5_repeat_score(spark, sf_dir):
    score = F.least(F.lit(1.0), F.max("value") / 500 + 0.06 * (F.count("*") - 1))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(score, 6).alias("score"))
