"""Readers, writers, frozen datasets and graphs: the given tables are written in the format, read again and compared."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import relational
from tessera.plans.registry import query
from tessera.session import scratch, table
from tessera.sources import catalog, exports


_folder = scratch


@query("""select p_partkey::varchar as id, p_name as title, nullif(case when p_size % 4 = 0 then ' ' else p_brand end, ' ') as maker, length(sha256('x')) as digest_length from part""")
def a1_catalog_csv(spark, sf_dir):
    path = _folder(spark, "a1")
    src = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Key No"), F.col("p_name").alias("Title"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_brand")).alias("Maker, full"))
    src.write.option("header", True).option("sep", ";").csv(path)
    got = catalog.read_catalog_csv(spark, path, {"Key No": "id", "Title": "title", "Maker, full": "maker"}, delimiter=";")
    return got.select("id", "title", "maker", F.length("row_sha256").cast("long").alias("digest_length"))


@query("""select p_partkey as id, p_name as name, case when p_size % 3 > 0 then p_type end as category, p_brand as maker from part""")
def a5_detail_payload(spark, sf_dir):
    named = lambda c: F.struct(c.alias("name"))
    payload = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), named(F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise(F.lit(" "))).alias("category"), named(F.col("p_brand")).alias("maker")))
    p = table(spark, sf_dir, "part").select(payload.alias("payload"))
    return p.select(*catalog.detail_row(F.col("payload"))[:4])


@query("""select n_name || '.txt' as name, 'txt' as extension, length(n_name) as size, sha256(n_name) as sha256 from nation""")
def a15_file_inventory(spark, sf_dir):
    """One small file per nation, written by executors."""
    path = _folder(spark, "a15")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_name").alias("file")).write.partitionBy("file").option("lineSep", "\u0000").text(path)
    f = catalog.file_inventory(spark, path, "*.txt")
    # a text file ends with its separator: sizes and digests are those of the content without it
    body = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("path", F.translate(F.col("content").cast("string"), "\u0000", "").alias("body"))
    named = F.url_decode(F.regexp_extract("path", "file=([^/]+)/", 1))
    return f.join(body, "path").select(F.concat(named, F.lit(".txt")).alias("name"), "extension", (F.col("size") - 1).alias("size"), F.sha2("body", 256).alias("sha256"))


@query("""select p_brand || '/' || p_type || '/' || p_size as slug, count(*) as n, min(p_name) as first from part group by 1""")
def a16_token_file(spark, sf_dir):
    path = _folder(spark, "a16")
    g = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("slug")).agg(F.sort_array(F.collect_list("p_name")).alias("tokens"))
    exports.write_jsonl(g, path)
    return catalog.read_tokens(spark, path).select("slug", F.size("tokens").cast("long").alias("n"), F.col("tokens")[0].alias("first"))


@query("select event_id, ts, user_id, event_type, value, props from events")
def a17_jsonl(spark, sf_dir):
    path = _folder(spark, "a17")
    e = table(spark, sf_dir, "events")
    exports.write_jsonl(e, path)
    return catalog.read_jsonl(spark, path, e.schema).select(*e.columns)


@query("""select l_orderkey::varchar as l_orderkey, '[' || string_agg(l_partkey, ',' order by l_partkey) || ']' as parts from (select distinct l_orderkey, l_partkey from lineitem) group by l_orderkey""")
def a18_report(spark, sf_dir):
    path = _folder(spark, "a18")
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    exports.write_report(g, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("select vec_id as row_id, label, len(embedding)::bigint as dim from embeddings where embedding is not null")
def a19_embedding_bundle(spark, sf_dir):
    a, b = _folder(spark, "a19v"), _folder(spark, "a19r")
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    e.select(F.col("vec_id").alias("row_id"), "embedding").write.parquet(a)
    e.select(F.col("vec_id").alias("row_id"), "label").write.parquet(b)
    dim = e.select(F.max(F.size("embedding"))).first()[0] or 0
    return catalog.read_embeddings(spark, a, b, dim).select("row_id", "label", F.size("embedding").cast("long").alias("dim"))


def _records(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    items = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("flag"))).alias("lines"))
    q, flag = F.col("child.q"), F.col("child.flag")
    return exports.task_records(items, "l_orderkey", "lines", {"amount": (q >= 25, q), "flag": (flag != "N", flag), "both": ((q >= 25) & (flag != "N"), F.concat(flag, q.cast("string")))})


_RECORDS = """with r as (select 'amount' as task, l_orderkey, l_partkey as child, l_quantity::varchar as value from lineitem where l_quantity >= 25 union all select 'flag', l_orderkey, l_partkey, l_returnflag from lineitem where l_returnflag <> 'N'
    union all select 'both', l_orderkey, l_partkey, l_returnflag || l_quantity::varchar from lineitem where l_quantity >= 25 and l_returnflag <> 'N') """


@query(_RECORDS + "select task, l_orderkey, child, value from r")
def a24_task_records(spark, sf_dir):
    return _records(spark, sf_dir)


def _split(records):
    return records.withColumn("split", F.when(F.col("l_orderkey") % 10 < 7, "train").when(F.col("l_orderkey") % 10 < 9, "validation").otherwise("test"))


@query(_RECORDS + "select task, case when l_orderkey % 10 < 7 then 'train' when l_orderkey % 10 < 9 then 'validation' else 'test' end as split, count(*) as n from r group by 1, 2")
def a21_frozen_export(spark, sf_dir):
    return exports.export_dataset(_split(_records(spark, sf_dir)), _folder(spark, "a21")).select("task", "split", "n")


@query(_RECORDS + "select task, case when l_orderkey % 10 < 7 then 'train' when l_orderkey % 10 < 9 then 'validation' else 'test' end as split, count(*) as n, count(*) as expected, true as ready from r group by 1, 2")
def a22_dataset_consumer(spark, sf_dir):
    path = _folder(spark, "a22")
    exports.export_dataset(_split(_records(spark, sf_dir)), path)
    return exports.consume_dataset(spark, path, "l_orderkey long, child long, value string")


@query("""with p as (select p_partkey as id, case when p_size % 3 = 0 then 'https://img.example/' || p_partkey when p_size % 3 = 1 then 'https://base.example/d/' || p_partkey || '.jpg' end as main, case when p_size % 4 = 0 then 'https://base.example/t/' || p_partkey end as thumb from part)
    select id, 'main' as kind, main as url from p where main is not null union all select id, 'thumb', thumb from p where thumb is not null""")
def a25_image_assets(spark, sf_dir):
    key, third = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    listed = F.to_json(F.struct(F.when(third == 0, F.concat(F.lit("https://img.example/"), key)).otherwise(F.lit(" ")).alias("image")))
    url = lambda c: F.struct(c.alias("url"))
    detail = F.to_json(F.struct(url(F.when(third == 1, F.concat(F.lit("/d/"), key, F.lit(".jpg")))).alias("image"), url(F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("t/"), key))).alias("thumb")))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), listed.alias("l"), detail.alias("d"))
    return catalog.image_assets(p, "id", "l", "d", "https://base.example/")


# ---- graphs, groups and checks

@query("""select o_custkey, count(*) as orders, sum(n) as lines, list_sum(list(n))::bigint as nested from (select o_orderkey, o_custkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2) group by 1""")
def p9_annotation_graph(spark, sf_dir):
    """Customer, its orders, their lines: nested from the bottom up."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("lines"))
    none = F.expr("cast(array() as array<struct<l_linenumber:int,l_partkey:bigint,l_quantity:double>>)")
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", none))
    g = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "lines")).alias("orders"))
    n = F.aggregate("orders", F.lit(0), lambda s, o: s + F.size(o["lines"])).cast("long")
    return g.select("o_custkey", F.size("orders").cast("long").alias("orders"), n.alias("lines"), n.alias("nested"))


@query("""with f as (select p_partkey, p_name, p_size % 3 as kind, p_brand || p_name as stem from part), g as (select stem, count(*) filter (kind = 0) as originals, count(*) filter (kind = 1) as thumbs, count(*) filter (kind = 2) as others, min(p_partkey) as first from f group by 1)
    select stem, case when originals > 0 and thumbs > 0 then 'pair' when originals > 0 then 'original' when thumbs > 0 then 'thumb' else 'standalone' end as kind, originals + thumbs + others as members, first from g""")
def p10_source_groups(spark, sf_dir):
    kind = F.col("p_size") % 3
    g = table(spark, sf_dir, "part").groupBy(F.concat("p_brand", "p_name").alias("stem")).agg(F.count_if(kind == 0).alias("o"), F.count_if(kind == 1).alias("t"), F.count("*").alias("members"), F.min("p_partkey").alias("first"))
    return g.select("stem", F.when((F.col("o") > 0) & (F.col("t") > 0), "pair").when(F.col("o") > 0, "original").when(F.col("t") > 0, "thumb").otherwise("standalone").alias("kind"), "members", "first")


@query("""with q as (select o_orderkey, o_custkey, case when c.c_custkey is null then 'no_customer' when o_totalprice < 1000 then 'too_small' when o_orderstatus = 'P' then 'pending' end as reason from orders left join customer c on c.c_custkey = o_custkey)
    select coalesce(reason, 'kept') as outcome, count(*) as n, min(o_orderkey) as first from q group by 1""")
def p6_proxy_queries(spark, sf_dir):
    """Query rows kept or excluded, the first reason counting."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    q = table(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    reason = F.when(F.col("known").isNull(), "no_customer").when(F.col("o_totalprice") < 1000, "too_small").when(F.col("o_orderstatus") == "P", "pending").otherwise("kept")
    return q.groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""select 'nation' as name, count(*) as n, 25 as expected, count(*) = 25 as ok from nation union all select 'region', count(*), 5, count(*) = 5 from region union all select 'lines per order', count(*), 0, count(*) = 0 from (select l_orderkey from lineitem group by 1 having count(*) > 7)""")
def q4_expected_counts(spark, sf_dir):
    over = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count().filter("count > 7")
    want = {"nation": (table(spark, sf_dir, "nation"), 25), "region": (table(spark, sf_dir, "region"), 5), "lines per order": (over, 0)}
    out = None
    for name, (df, n) in want.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(n).alias("expected"), (F.col("n") == n).alias("ok"))
        out = row if out is None else out.union(row)
    return out


@query("""with j as (select *, case when o_orderstatus = 'F' then 'finished' when o_orderpriority like '1%' then 'running' else 'queued' end as status from orders) select status, o_orderkey, n from (select status, o_orderkey, count(*) over (partition by status) as n, row_number() over (partition by status order by o_orderdate desc, o_orderkey) as rn from j) where rn between 6 and 10""")
def f12_job_page(spark, sf_dir):
    """The second page of five of each status, newest first, with the status's total."""
    status = F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderpriority").startswith("1"), "running").otherwise("queued")
    j = table(spark, sf_dir, "orders").withColumn("status", status)
    total = j.groupBy("status").agg(F.count("*").alias("n"))
    page = j.withColumn("rn", F.row_number().over(W.partitionBy("status").orderBy(F.desc("o_orderdate"), "o_orderkey"))).filter("rn between 6 and 10")
    return page.join(total, "status").select("status", "o_orderkey", "n")


@query("""select l_orderkey, max(l_linenumber) as revision, max_by(l_partkey, (l_linenumber, l_partkey)) as part from lineitem group by 1""")
def e19_latest_revision(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("revision"), F.col("l_partkey").alias("part"))
    return relational.first_per_key(li, ["l_orderkey"], [F.desc("revision"), F.desc("part")])


_NEAREST = """with k as (select distinct replace(p_name, ' ', '-') || '-' || (p_size % 4) as key, p_size % 2 as side from part), a as (select key from k where side = 0), b as (select key from k where side = 1),
    p as (select a.key as a, b.key as b, (select count(*) from range(1, least(length(a.key), length(b.key)) + 1) t(i) where substr(a.key, 1, i) = substr(b.key, 1, i)) as common from a join b on substr(a.key, 1, 8) = substr(b.key, 1, 8)),
    t as (select *, case when a = b then 0 when least(length(a), length(b)) >= 8 and common = least(length(a), length(b)) then 1 when common >= 12 then 2 end as tier from p) """


@query(_NEAREST + "select a, b, common, tier from (select *, rank() over (partition by a order by common desc, tier) as r from t where tier is not null) where r = 1")
def c16_nearest_names(spark, sf_dir):
    """Nearest file keys of missing ones by common prefix; distinct keys are compared once, by their first eight letters."""
    k = table(spark, sf_dir, "part").select(T.filename_key(F.concat("p_name", F.lit(" "), (F.col("p_size") % 4).cast("string"))).alias("key"), (F.col("p_size") % 2).alias("side")).distinct()
    a = k.filter("side = 0").select(F.col("key").alias("a"), F.substring("key", 1, 8).alias("p"))
    b = k.filter("side = 1").select(F.col("key").alias("b"), F.substring("key", 1, 8).alias("p"))
    n = F.least(F.length("a"), F.length("b"))
    common = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("a"), F.lit(1), i) == F.substring(F.col("b"), F.lit(1), i)))
    j = a.join(b, "p").withColumn("common", common)
    tier = F.when(F.col("a") == F.col("b"), 0).when((n >= 8) & (F.col("common") == n), 1).when(F.col("common") >= 12, 2)
    j = j.withColumn("tier", tier).filter("tier is not null")
    best = F.rank().over(W.partitionBy("a").orderBy(F.desc("common"), "tier"))
    return j.withColumn("r", best).filter("r = 1").select("a", "b", "common", "tier")
