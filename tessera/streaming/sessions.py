"""Frame-stream state as Structured Streaming, each with a batch twin over the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import text as T
from tessera.operators import wordjoin as J


def stability(frames: DataFrame, key: str, ts: str, value: str, seconds: float, least: int, most_delta: float) -> DataFrame:
    """Batch: a row is stable when its key has at least ``least`` rows in the last ``seconds`` and their values spread at most ``most_delta``."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(t).rangeBetween(-int(seconds * 1_000_000), 0)
    n, spread = F.count("*").over(w), F.max(value).over(w) - F.min(value).over(w)
    return frames.withColumn("seen", n).withColumn("stable", (n >= least) & (spread <= most_delta))


def token_evidence(events: DataFrame, key: str, token: str, score: str) -> DataFrame:
    """Occurrences, sum and best score of a token per key.  The same expression runs on a stream (update mode) and on a table."""
    return events.groupBy(key, token).agg(F.count("*").alias("occurrences"), F.round(F.sum(score), 6).alias("score_sum"), F.max(score).alias("best"))


def windowed_counts(events: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per event-time window; on a stream rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")


def once_per_key(events: DataFrame, ts: str, key: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def candidate_scores(best: Column, seen: Column, step: float = 0.06) -> Column:
    """A candidate's score: its best observation and a little for each repeat, at most 1."""
    return F.least(F.lit(1.0), best + step * (seen - 1))


def stop_rule(score: Column, margin: Column, accept: float = 0.85, ask: float = 0.6) -> Column:
    return F.when((score >= accept) & (margin >= 0.08), "stop").when(score >= ask, "ask").otherwise("continue")


STATE = "n long, best double, phase string"


def _advance(n: int, best: float, phase: str, kind: str, value: float) -> tuple[int, float, str]:
    if phase == "done":
        return n, best, phase
    n, best = n + 1, max(best, value)
    if kind == "error":
        phase = "failed"
    elif kind == "purchase":
        phase = "done"
    elif phase != "failed":
        phase = "tracking" if n >= 3 else "waiting"
    return n, best, phase


def flow_batch(events: DataFrame, key: str, ts: str, kind: str, value: str) -> DataFrame:
    """One row per key: the state machine folded over its rows in time order."""
    kt = dict(events.dtypes)[key]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        s = (0, float("-inf"), "waiting")
        for k, v in g.sort_values([ts, kind, value])[[kind, value]].itertuples(index=False):
            s = _advance(*s, k, v)
        return pd.DataFrame([(g[key].iloc[0], *s)], columns=[key, "n", "best", "phase"])
    return events.groupBy(key).applyInPandas(run, f"{key} {kt}, {STATE}")


def flow_stream(events: DataFrame, key: str, ts: str, kind: str, value: str) -> DataFrame:
    """The same fold on a stream, one updated row per key and batch; rows of one micro-batch are taken in time order."""
    kt = dict(events.dtypes)[key]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = tuple(state.get) if state.exists else (0, float("-inf"), "waiting")
        g = pd.concat(list(frames))
        for a, v in g.sort_values([ts, kind, value])[[kind, value]].itertuples(index=False):
            s = _advance(*s, a, v)
        state.update(s)
        yield pd.DataFrame([(k[0], *s)], columns=[key, "n", "best", "phase"])
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kt}, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def lease_status(beats: DataFrame, job: str, ts: str, now: Column, lease: str, attempts: int = 3) -> DataFrame:
    """Jobs by their last heartbeat: alive, requeue or, after ``attempts`` recoveries (gaps longer than the lease), failed."""
    w = W.partitionBy(job).orderBy(ts)
    gap = F.col(ts) > F.lag(ts).over(w) + F.expr(f"interval {lease}")
    g = beats.withColumn("_gap", F.coalesce(gap, F.lit(False))).groupBy(job).agg(F.max(ts).alias("last"), F.count_if("_gap").alias("recoveries"))
    expired = F.col("last") + F.expr(f"interval {lease}") < now
    return g.withColumn("status", F.when(~expired, "alive").when(F.col("recoveries") >= attempts, "failed").otherwise("requeue"))


def correct_tokens(events: DataFrame, token: str, dictionary: DataFrame, word: str, least: float = 0.78) -> DataFrame:
    """Adds ``canonical``: the dictionary word nearest to the token by edit similarity, the token itself where none reaches ``least``.  On a stream
    give the distinct tokens as a table through ``token_corrections``."""
    return apply_corrections(events, token, token_corrections(events.select(token).distinct(), token, dictionary, word, least))


def token_corrections(tokens: DataFrame, token: str, dictionary: DataFrame, word: str, least: float = 0.78) -> DataFrame:
    """(token, canonical, similarity) of distinct tokens that have a canonical form.  Token and word are compared in all their spellings (as they are, and with look-alike
    letters of either script), whatever their first letters; of equally similar words the first by letters is taken.  A year stands for itself."""
    def spelled(df: DataFrame, c: str, name: str, form: str) -> DataFrame:
        low = F.lower(F.trim(name))
        forms = F.array(low, F.translate(low, *T.LOOKALIKE), F.translate(low, T.LOOKALIKE[1], T.LOOKALIKE[0]))
        return df.select(F.col(c).alias(name)).distinct().select(name, F.explode(F.array_distinct(F.filter(forms, lambda x: F.length(x) >= 2))).alias(form))

    year = F.col(token).rlike("^(19|20)[0-9]{2}$")
    t, d = spelled(tokens.filter(~year), token, "_t", "_a"), spelled(dictionary, word, "_w", "_b")
    near = J.edit_pairs(t, d, "_a", "_b", least).join(t, "_a").join(d, "_b").groupBy("_t", "_w").agg(F.max("similarity").alias("_s"))
    best = near.groupBy("_t").agg(F.min(F.struct((-F.col("_s")).alias("far"), "_w")).alias("_o"))
    years = tokens.filter(year).select(F.col(token)).distinct().select(token, F.col(token).alias("canonical"), F.lit(1.0).alias("similarity"))
    return best.select(F.col("_t").alias(token), F.col("_o._w").alias("canonical"), (-F.col("_o.far")).alias("similarity")).union(years)


def apply_corrections(events: DataFrame, token: str, corrections: DataFrame) -> DataFrame:
    """A stream-static join when ``events`` is a stream."""
    return events.join(corrections.select(token, "canonical"), token, "left").withColumn("canonical", F.coalesce("canonical", token))


def admission(events: DataFrame, ts: str, newest: Column, late: str, same: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Adds ``outcome``: foreign where one of the pairs (found, expected) differs, late where the row is more than ``late`` behind the newest, else accepted."""
    fits = F.lit(True)
    for a, b in same:
        fits &= a.eqNullSafe(b)
    late_row = F.col(ts) < newest - F.expr(f"interval {late}")
    return events.withColumn("outcome", F.when(~fits, "foreign").when(late_row, "late").otherwise("accepted"))


def enqueue_once(events: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each content key; the batch twin of ``once_per_key``."""
    w = W.partitionBy(*key).orderBy(*order)
    return events.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def year_votes(events: DataFrame, key: str, year: str, confidence: str, quality: str, profile: float = 0.5, k: int = 3) -> DataFrame:
    """(key, year, votes, rank): years by summed evidence.  Fixed values: the weights."""
    score = F.greatest(F.lit(0.15), F.col(confidence)) * 0.55 + F.col(quality) * 0.3 + profile * 0.15
    v = events.filter(F.col(year).between(1900, 2030)).groupBy(key, year).agg(F.sum(score).alias("votes"))
    w = W.partitionBy(key).orderBy(F.desc(F.round("votes", 6)), year)
    return v.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Name, weight and size of each bundle of query tokens.
BUNDLES = (("strong", 1.0, 10), ("entity", 0.88, 1000), ("wide", 0.72, 18))


def query_bundles(evidence: DataFrame, key: str, token: str, score: str, entity: str) -> DataFrame:
    """(key, bundle, weight, token) from accumulated tokens: the best of those above 0.55, those that name an entity, and the best of all."""
    w = W.partitionBy(key).orderBy(F.desc(score), token)
    e = evidence.withColumn("_r", F.row_number().over(w)).withColumn("_s", F.count_if(F.col(score) > 0.55).over(w.rowsBetween(W.unboundedPreceding, 0)))
    test = {"strong": F.col(score) > 0.55, "entity": F.col(entity), "wide": F.lit(True)}
    place = {"strong": F.col("_s"), "entity": F.lit(0), "wide": F.col("_r")}
    made = [F.when(test[n] & (place[n] <= size), F.struct(F.lit(n).alias("bundle"), F.lit(weight).alias("weight"))) for n, weight, size in BUNDLES]
    return e.select(key, token, F.explode(F.array_compact(F.array(*made))).alias("b")).select(key, "b.bundle", "b.weight", token)


def bundle_candidates(bundles: DataFrame, index: DataFrame, key: str, token: str, candidate: str, score: str) -> DataFrame:
    """(key, candidate, score, sources): candidates of all bundles, each bundle's best score times its weight, the best of them kept."""
    s = bundles.join(index, token).groupBy(key, candidate, "bundle", "weight").agg(F.max(score).alias("_s"))
    return s.groupBy(key, candidate).agg(F.max(F.col("_s") * F.col("weight")).alias("score"), F.array_join(F.sort_array(F.collect_set("bundle")), ",").alias("sources"))
