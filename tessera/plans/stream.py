"""Batch twins of the streaming operators; tests run the streams over the same rows and compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.session import table
from tessera.streaming import sessions as S
from tessera.streaming import state as ST


@query("""select event_id, count(*) over w as seen, count(*) over w >= 2 and max(value) over w - min(value) over w <= 60 as stable from events
    window w as (partition by user_id order by epoch_us(ts) range between 14400000000 preceding and current row)""")
def r1_stability(spark, sf_dir):
    return S.stability(table(spark, sf_dir, "events"), "user_id", "ts", "value", 14400, 2, 60).select("event_id", "seen", "stable")


@query("""with c as (select user_id, ts, event_id, (event_type <> lag(event_type) over (partition by user_id order by ts, event_id))::int as s from events),
    g as (select *, sum(coalesce(s, 0)) over (partition by user_id order by ts, event_id) as island from c) select user_id, island, count(*) as n, min(ts) as start, max(ts) as stop from g group by 1, 2""")
def r2_stable_runs(spark, sf_dir):
    from pyspark.sql import Window as W
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    c = table(spark, sf_dir, "events").withColumn("s", F.coalesce((F.col("event_type") != F.lag("event_type").over(w)).cast("int"), F.lit(0))).withColumn("island", F.sum("s").over(w))
    return c.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))


@query("""select user_id, event_type, count(*) as occurrences, round(sum(value), 6) as score_sum, max(value) as best from events group by 1, 2""")
def r3_token_evidence(spark, sf_dir):
    return S.token_evidence(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@query("""with b as (select user_id, event_type, least(1.0, max(value) / 400 + .06 * (count(*) - 1)) as score from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by score desc, event_type) as rank,
    score - coalesce(lead(score) over (partition by user_id order by score desc, event_type), 0) as margin from b)
    select user_id, event_type, round(score, 6) as score, case when score >= .85 and margin >= .08 then 'stop' when score >= .6 then 'ask' else 'continue' end as decision from r where rank = 1""")
def r6_stop_rule(spark, sf_dir):
    from pyspark.sql import Window as W
    b = S.token_evidence(table(spark, sf_dir, "events"), "user_id", "event_type", "value").withColumn("score", S.candidate_scores(F.col("best") / 400, F.col("occurrences")))
    w = W.partitionBy("user_id").orderBy(F.desc("score"), "event_type")
    r = b.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).filter("rank = 1")
    return r.select("user_id", "event_type", F.round("score", 6).alias("score"), S.stop_rule(F.col("score"), F.col("margin")).alias("decision"))


@query("""select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2""")
def r7_windowed_counts(spark, sf_dir):
    return S.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "2 hours")


@query("""with c as (select user_id, ts, (ts >= lag(ts) over w + interval 30 minute)::int as s from events window w as (partition by user_id order by ts)),
    g as (select user_id, ts, sum(coalesce(s, 0)) over (partition by user_id order by ts) as k from c) select user_id, min(ts) as start, max(ts) + interval 30 minute as stop, count(*) as n from g group by user_id, k""")
def r7_sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "30 minutes", "2 hours")


@query()
def r9_flow_states(spark, sf_dir):
    """The state machine is a fold in time order; tests compare stream, batch and a plain loop."""
    return S.flow_batch(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "value")


@query("""with g as (select user_id, ts, (ts > lag(ts) over (partition by user_id order by ts) + interval 24 hour)::int as gap from events), s as (select user_id, max(ts) as last, sum(coalesce(gap, 0)) as recoveries from g group by 1)
    select user_id, recoveries::bigint as recoveries, case when last + interval 24 hour >= timestamp '2024-01-30 20:00:00' then 'alive' when recoveries >= 3 then 'failed' else 'requeue' end as status from s""")
def r12_leases(spark, sf_dir):
    return S.lease_status(table(spark, sf_dir, "events"), "user_id", "ts", F.expr("timestamp '2024-01-30 20:00:00'"), "24 hours").select("user_id", "recoveries", "status")


@query("""with e as (select event_id, case event_id % 6 when 0 then event_type || 'x' when 1 then left(event_type, 2) when 2 then 'x' || substr(event_type, 2) when 3 then translate(event_type, 'aceop', 'асеор') when 4 then (1990 + event_id % 40)::varchar else event_type end as token from events),
    d as (select distinct event_type as w from events), t as (select distinct token from e where not regexp_full_match(token, '(19|20)[0-9]{2}')),
    tf as (select distinct token, unnest([lower(token), translate(lower(token), 'авеёкмнорстухі', 'abeekmhopctyxi'), translate(lower(token), 'abeekmhopctyxi', 'авеёкмнорстухі')]) as a from t),
    df as (select distinct w, unnest([lower(w), translate(lower(w), 'авеёкмнорстухі', 'abeekmhopctyxi'), translate(lower(w), 'abeekmhopctyxi', 'авеёкмнорстухі')]) as b from d),
    s as (select token, w, max(1 - levenshtein(a, b) / greatest(length(a), length(b))::double) as s from tf cross join df where length(a) >= 2 and length(b) >= 2 group by 1, 2),
    b as (select token, w from s where s >= .78 qualify row_number() over (partition by token order by s desc, w) = 1) select token, coalesce(w, token) as canonical, count(*) as n from e left join b using (token) group by 1, 2""")
def r4_corrected_tokens(spark, sf_dir):
    """Tokens with a letter too many, cut, with a wrong first letter, with letters of another script, years, and right ones."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_id") % 6
    token = (F.when(kind == 0, F.concat("event_type", F.lit("x"))).when(kind == 1, F.left("event_type", F.lit(2))).when(kind == 2, F.concat(F.lit("x"), F.substr("event_type", F.lit(2))))
             .when(kind == 3, F.translate("event_type", "aceop", "асеор")).when(kind == 4, (F.col("event_id") % 40 + 1990).cast("string")).otherwise(F.col("event_type")))
    return S.correct_tokens(e.withColumn("token", token), "token", e, "event_type").groupBy("token", "canonical").agg(F.count("*").alias("n"))


@query("""with n as (select *, max(ts) over (partition by user_id) as newest, json_extract(props, '$.k')::bigint as k from events),
    o as (select case when k % 3 is distinct from user_id % 3 then 'foreign' when ts < newest - interval 3 day then 'late' else 'accepted' end as outcome, value from n) select outcome, count(*) as n, round(sum(value), 4) as value from o group by 1""")
def r8_admission(spark, sf_dir):
    from pyspark.sql import Window as W
    e = table(spark, sf_dir, "events").withColumn("newest", F.max("ts").over(W.partitionBy("user_id"))).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    a = S.admission(e, "ts", F.col("newest"), "3 days", [(F.col("k") % 3, F.col("user_id") % 3)])
    return a.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("""select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type, date_trunc('day', ts) order by ts, event_id) = 1""")
def r11_enqueue_once(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    return S.enqueue_once(e, ("user_id", "event_type", "day"), ("ts", "event_id")).select("event_id", "user_id", "event_type")


@query("""with y as (select user_id, 1990 + json_extract(props, '$.k')::bigint % 45 as year, least(value / 500, 1) as c, (event_id % 10) / 10.0 as q from events),
    v as (select user_id, year, sum(greatest(.15, c) * .55 + q * .3 + .075) as votes from y where year between 1900 and 2030 group by 1, 2)
    select user_id, year, round(votes::decimal(18,9), 5)::double as votes, row_number() over (partition by user_id order by round(votes, 6) desc, year) as rank from v qualify rank <= 3""")
def r13_year_votes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.get_json_object("props", "$.k").cast("long") % 45 + 1990).alias("year"), F.least(F.col("value") / 500, F.lit(1.0)).alias("c"), ((F.col("event_id") % 10) / 10).alias("q"))
    return S.year_votes(e, "user_id", "year", "c", "q").select("user_id", "year", F.round(F.col("votes").cast("decimal(18,9)"), 5).cast("double").alias("votes"), "rank")


@query("""with t as (select user_id, event_type as token, max(value) / 500 as score from events group by 1, 2), r as (select *, row_number() over w as r, count(*) filter (score > .55) over (partition by user_id order by score desc, token rows unbounded preceding) as s from t window w as (partition by user_id order by score desc, token)),
    b as (select user_id, token, 'strong' as bundle, 1.0 as w from r where score > .55 and s <= 10 union all select user_id, token, 'entity', .88 from r where token in ('signup', 'purchase') union all select user_id, token, 'wide', .72 from r where r <= 18),
    i as (select event_type as token, user_id % 20 as candidate, max(value) / 500 as score from events group by 1, 2), m as (select b.user_id, candidate, bundle, w, max(score) as s from b join i using (token) group by all)
    select user_id, candidate, round(max(s * w), 6)::double as score, string_agg(distinct bundle, ',' order by bundle) as sources from m group by 1, 2""")
def r14_query_bundles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.groupBy("user_id", F.col("event_type").alias("token")).agg((F.max("value") / 500).alias("score")).withColumn("entity", F.col("token").isin("signup", "purchase"))
    index = e.groupBy(F.col("event_type").alias("token"), (F.col("user_id") % 20).alias("candidate")).agg((F.max("value") / 500).alias("hit"))
    c = S.bundle_candidates(S.query_bundles(t, "user_id", "token", "score", "entity"), index, "user_id", "token", "candidate", "hit")
    return c.select("user_id", "candidate", F.round("score", 6).alias("score"), "sources")


# ---- state with timers: batch twins of the processors in tessera.streaming.state

def _frames(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long")
    token = F.array_distinct(F.array("event_type", F.concat(F.lit("k"), (k % 3).cast("string")), F.concat(F.lit("v"), F.floor(F.col("value") / 200).cast("string"))))
    return e.withColumn("tokens", F.array_compact(token)).withColumn("sharp", F.col("value") / 1000).withColumn("bright", k / 200)


@query("""with f as (select event_id, user_id, ts, list_distinct(list_filter([event_type, 'k' || json_extract(props, '$.k')::bigint % 3, 'v' || floor(value / 200)::bigint], lambda x: x is not null)) as t from events),
    p as (select a.user_id, a.event_id as id, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::double as j from f a join f b on a.user_id = b.user_id and b.ts between a.ts - interval 3 day and a.ts)
    select user_id, id, count(*) as seen, round(avg(j), 7) as similarity, count(*) >= 3 and round(avg(j), 9) >= .42 as stable from p group by 1, 2""")
def r1_token_stability(spark, sf_dir):
    """Frames of three days, since the events of a user lie hours apart."""
    s = ST.stability_table(_frames(spark, sf_dir), "user_id", "ts", "event_id", "tokens", ms=3 * 86_400_000, least=3, similarity=0.42)
    return s.withColumn("similarity", F.round("similarity", 7))


@query("""with f as (select event_id, user_id, ts, value / 1000 as a, json_extract(props, '$.k')::bigint / 200 as b from events),
    d as (select *, coalesce(round(abs(a - lag(a) over w) + abs(b - lag(b) over w), 9) >= .3, true) as moved, epoch_us(ts) - lag(epoch_us(ts)) over w as us from f window w as (partition by user_id order by ts, event_id)),
    i as (select *, sum(moved::int) over (partition by user_id order by ts, event_id) as island from d), s as (select user_id, event_id as id, sum(case when moved then 0 else us end) over (partition by user_id, island order by ts, event_id) / 1000 as ms from i)
    select user_id, id, ms as stable_ms, least(1, round(ms / 86400000, 9)) as score from s""")
def r2_stable_duration(spark, sf_dir):
    """A full day of stillness counts as 1."""
    s = ST.still_table(_frames(spark, sf_dir), "user_id", "ts", "event_id", ["sharp", "bright"], delta=0.3, full_ms=86_400_000)
    return s.withColumn("score", F.round("score", 9))


@query("""with e as (select *, min(ts) over (partition by user_id) + interval 5 day as e from events)
    select user_id, 'locked' as kind, null::bigint as id, max(e) as at, count(*) as n, max(value) as best from e where ts < e group by 1 union all select user_id, 'rejected', event_id, ts, null, null from e where ts >= e""")
def r7_locked_periods(spark, sf_dir):
    return ST.period_table(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", ms=5 * 86_400_000)


@query("""with e as (select user_id, ts, event_id, coalesce(lead(ts) over w, timestamp '2024-02-05 00:00:00') as nxt, max(json_extract(props, '$.k')::bigint = 7) over w as c from events window w as (partition by user_id order by ts, event_id)),
    x as (select user_id, ts, event_id, c, row_number() over (partition by user_id order by ts, event_id) as recoveries from e where ts + interval 20 hour < nxt),
    s as (select *, case when c then 'cancelled' when recoveries >= 3 then 'failed' else 'queued' end as status from x)
    select user_id, ts + interval 20 hour as at, recoveries::int as recoveries, status from s qualify coalesce(count(*) filter (status <> 'queued') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 0""")
def r12_lease_expiries(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("stop", F.get_json_object("props", "$.k").cast("long") == 7)
    return ST.lease_table(e, "user_id", "ts", "event_id", "stop", 20 * 3_600_000, F.expr("timestamp '2024-02-05 00:00:00'"))
