"""Registered queries of the training-data operators: each over its whole table, with production parameters.

The two exact joins and the centroids have oracle SQL.  Tokenizers, trained models and tree walks cannot be stated in SQL; tests/llm holds each of
those against a plain version, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import centroids, decontaminate, embedding_dedup, html_text, langid, mixing, ngram_join, packing, pii, quality, token_counts, url_filter, whitening
from tessera.session import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), edits=token_counts.revision_edits())


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_html_text, op3_decontaminate, op4_ngram_join, op5_embedding_dedup,
                                    op6_packing, op7_langid, op8_pii, op9_quality, op10_url_filter, op11_centroids, op12_whitening, op13_mixing)}


_LINKED = """, reach as (with recursive r(a, b) as (select id, id from ids union select r.a, l.b from r join links l on l.a = r.b) select a, min(b) as c from r group by 1) """

ORACLES = {
    "op4_ngram_join": """with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from d),
        e as (select doc_id, unnest([hash(x) for x in s]) as h from s), n as (select doc_id, len(s) as n from s),
        o as (select x.doc_id as a, y.doc_id as b, count(*) as o from e x join e y on x.h = y.h and x.doc_id <> y.doc_id group by 1, 2),
        links as (select a, b from o join n p on p.doc_id = a join n q on q.doc_id = b where 100 * o >= 75 * (p.n + q.n - o)), ids as (select doc_id as id from documents)"""
        + _LINKED + "select n.doc_id, n.n as n_shingles, c as component_id from n join reach on reach.a = n.doc_id",
    "op5_embedding_dedup": """with v as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null and list_sum([x * x for x in embedding]) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= .93), ids as (select vec_id as id from embeddings)"""
        + _LINKED + """, k as (select a, count(*) as n from links group by 1) select i.id as vec_id, coalesce(k.n, 0) as n_links, r.c as component_id, i.id = r.c as kept from ids i join reach r on r.a = i.id left join k on k.a = i.id""",
}

#: Ten rounds of assignment and exact means, then the last assignment; a[i] and c[i] are the assignment and the centroids of round i.
_ROUND = """, a{i} as materialized (select v.r, arg_min(c.j, (list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.x, c.x)]), c.j)) as j from v, c{i} c group by 1),
        m{i} as (select a{i}.j, p, cast((sum(v.x[p]) - (sum(v.x[p]) % count(*) + count(*)) % count(*)) // count(*) as bigint) as y from a{i} join v using (r), range(1, 65) t(p) group by 1, 2),
        n{i} as (select j, list(y order by p) as x from m{i} group by 1),
        c{k} as materialized (select c.j, coalesce(n.x, c.x) as x from c{i} c left join n{i} n using (j))"""

ORACLES["op11_centroids"] = """with e as (select vec_id, embedding::double[] as e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        v as materialized (select row_number() over () as r, vec_id, [cast(floor(1024 * x) as bigint) for x in e] as x from e),
        c0 as materialized (select row_number() over (order by sha256('3:' || vec_id) nulls last, x) - 1 as j, x from v qualify j < 8)""" + "".join(_ROUND.format(i=i, k=i + 1) for i in range(10)) + """,
        f as (select v.r, arg_min((c.j, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.x, c.x)])), (list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.x, c.x)]), c.j)) as b from v, c10 c group by 1),
        g as (select vec_id, cast(b[1] as int) as cluster, cast(b[2] as bigint) as distance from f join v using (r))
        select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
        from g join c10 c on c.j = g.cluster"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
