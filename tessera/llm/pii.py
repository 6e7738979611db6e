"""Personal data: fixed base patterns, and identifiers found by bootstrapped contexts.  DataFrame functions only.

Base spans.  Each kind is one regular expression, matched leftmost and without overlaps in the whole text; matches that
fail the kind's check are dropped.  The expressions are the stated ones, written without
backtracking: possessive runs, and starts tied to the beginning of a run or the end of the last match.
Matches are framed by a control sign, the text is split at it, and running lengths give code-point positions; they are summed in
two levels of ``BLOCK`` parts, so the work stays small in texts of very many matches.

Bootstrapping.  Instances are runs of letters, digits and joiners of any length, of five signs or more, that hold a digit or @.  Their lexical
patterns are the word before with all signs between it and the instance, and the word after likewise (digit runs as one 0, white
space as one space).  Seeds are the instances that overlap a base span, and those of the form ``SEED_FORM``.  Edges are
aggregated per (pattern, instance); a pattern with fewer than ``least_seeds`` distinct instances can never be trusted and leaves.
Each of ``rounds`` rounds scores all patterns and then all instances:

* a pattern's score is the mean score of its distinct instances times the share of all uses of its word
  in the corpus that stand beside an instance; it is trusted with ``least_score`` and ``least_seeds`` accepted instances;
* an instance's score is 1 if it is a seed, else one minus the product of (1 - score) over its trusted patterns, and
  it is accepted from ``least_score`` on, so patterns without any seed of their own can be trusted in later rounds.

Instances beside a pattern trusted after the last round that no base span covers are added as kind ``id``; a seed form is no span by itself.

A null text is empty, an empty table gives an empty result.  Repeated rows are judged each, null ids too.  Spans never cross documents.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns in a form that never backtracks far.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_JOIN = "._%+@/#-"
#: A run that may be an identifier: it holds a digit or @, and ends in a letter or digit.
TOKEN = rf"(?<![A-Za-z0-9{_JOIN}])(?=[A-Za-z._%+/#-]*+[0-9@])[A-Za-z0-9{_JOIN}]*[A-Za-z0-9]"
#: Identifiers by form: long hexadecimal keys with letters and digits.
SEED_FORM = r"^(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}+$"
LEAST = 5
_LAST_WORD, _FIRST_WORD = r"(?<!\p{L})(\p{L}++)(\P{L}*+)$", r"^(\P{L}*+)(\p{L}++)"
_MARK, _OTHER = "\x01", "\x02"
SPAN = "struct<k:int,s:int,e:int>"
#: Parts that are summed at a time.
BLOCK = 512


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _found(text: Column, pattern: str) -> Column:
    """array<struct<m: match, before, after: text to the neighbouring matches, s, e>> of all matches in order."""
    def starts(parts: Column) -> Column:
        """The place of each part, in blocks: a block's places are summed from the place where it begins."""
        n = F.size(parts)

        def block(acc: Column, b: Column) -> Column:
            part = F.slice(parts, b * BLOCK + 1, F.lit(BLOCK))
            inner = F.aggregate(part, F.struct(acc["at"].alias("at"), F.expr("cast(array() as array<int>)").alias("out")), lambda a, x: F.struct(
                (a["at"] + F.length(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
            return _let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], i["out"]).alias("out")))

        zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), zero, block)["out"]

    def matches(parts: Column) -> Column:
        def one(at: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), lambda i: F.struct(
                F.get(parts, i).alias("m"), F.get(parts, i - 1).alias("before"), F.get(parts, i + 1).alias("after"),
                F.get(at, i).alias("s"), (F.get(at, i) + F.length(F.get(parts, i))).alias("e")))
        none = F.expr("cast(array() as array<struct<m:string,before:string,after:string,s:int,e:int>>)")
        return F.when(F.size(parts) > 1, _let(starts(parts), one)).otherwise(none)

    return _let(F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK), matches)


def _luhn(m: Column) -> Column:
    digits = F.split(F.reverse(F.translate(m, " -", "")), "")
    values = F.transform(F.filter(digits, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small(p: Column) -> Column:
    d = F.regexp_replace(p, "^0+", "")
    return (F.length(d) <= 3) & (F.lpad(d, 3, "0") <= "255")


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": _luhn,
    "phone": lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e>> of all kinds, by kind as listed and then by start; k is the place in KINDS."""
    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER)

    def kind(k: int) -> Column:
        check = CHECKS[KINDS[k]]
        good = F.filter(_found(clean, PATTERNS[KINDS[k]]), lambda x: check(x["m"]))
        return F.transform(good, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    return F.concat(*map(kind, range(len(KINDS))))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in (*KINDS, "id")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def instances(text: Column) -> Column:
    """array<struct<inst, left, lword, right, rword, s, e>>: the possible identifiers of a text with their patterns on both sides; a side
    without a word is null."""
    def side(gap: Column, pattern: str, word: int, name: str) -> list[Column]:
        gap = F.lower(gap)
        w = F.nullif(F.regexp_extract(gap, pattern, word), F.lit(""))
        signs = F.regexp_replace(F.regexp_replace(F.regexp_extract(gap, pattern, 3 - word), "[0-9]+", "0"), r"[\s\p{Z}]+", " ")
        parts = (w, signs) if word == 1 else (signs, w)
        return [F.when(w.isNotNull(), F.concat(F.lit(name), *parts)).alias(f"{name}pat"), w.alias(f"{name}word")]

    def one(x: Column) -> Column:
        core = F.btrim(x["m"], F.lit(_JOIN))
        s = x["s"] + F.length(x["m"]) - F.length(F.ltrim(x["m"], F.lit(_JOIN)))
        return F.struct(F.lower(core).alias("inst"), *side(x["before"], _LAST_WORD, 1, "l"), *side(x["after"], _FIRST_WORD, 2, "r"),
                        s.alias("s"), (s + F.length(core)).alias("e"))

    clean = F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER)
    return F.filter(F.transform(_found(clean, TOKEN), one), lambda x: (F.length(x["inst"]) >= LEAST) & x["inst"].rlike("[0-9@]"))


def occurrences(seen: DataFrame) -> DataFrame:
    """(rid, pat, word, inst, s, e, base, seed) from (rid, base, tokens): one row per instance and side that has a word."""
    occ = seen.filter("size(tokens) > 0").select("rid", "base", F.explode("tokens").alias("t")).select(
        "rid", "t.*", F.exists("base", lambda b: (b["s"] < F.col("t.e")) & (b["e"] > F.col("t.s"))).alias("in_base"))
    sides = F.array(*[F.struct(F.col(f"{x}pat").alias("pat"), F.col(f"{x}word").alias("word")) for x in ("l", "r")])
    return occ.withColumn("side", F.explode(sides)).filter("side.pat is not null").select(
        "rid", "side.pat", "side.word", "inst", "s", "e", "in_base", (F.col("in_base") | F.col("inst").rlike(SEED_FORM)).alias("seed"))


def trusted_patterns(edges: DataFrame, uses: DataFrame, rounds: int = 3, least_score: float = 0.3, least_seeds: int = 5) -> DataFrame:
    """The patterns that are trusted after ``rounds`` rounds: (pat, score), from edges (pat, word, inst, seed, n), one row per pattern
    and instance, n the times they meet, and uses (word, uses) of the whole corpus."""
    enough = edges.groupBy("pat").agg(F.count("*").alias("c"), F.sum("n").alias("met")).filter(F.col("c") >= least_seeds)
    beside = edges.groupBy("word", F.left("pat", F.lit(1)).alias("side")).agg(F.sum("n").alias("by"))
    share = beside.join(uses, "word").select("word", "side", F.least(F.lit(1.0), F.col("by") / F.col("uses")).alias("share"))
    share = share.filter(F.col("share") >= least_score)  # a score is at most its share
    graph = (edges.join(enough.select("pat"), "pat").withColumn("side", F.left("pat", F.lit(1))).join(share, ["word", "side"])
             .select("pat", "inst", "share", "seed", F.col("seed").cast("double").alias("score")))
    graph = materialize(graph, "op8graph")

    def patterns(g: DataFrame) -> DataFrame:
        good = F.count(F.when(F.col("score") >= least_score, 1))
        return (g.groupBy("pat").agg((F.avg("score") * F.max("share")).alias("p"), good.alias("good"))
                .filter((F.col("p") >= least_score) & (F.col("good") >= least_seeds)).select("pat", "p"))

    for _ in range(rounds - 1):
        inst = graph.join(patterns(graph), "pat").groupBy("inst").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("q"))
        graph = materialize(graph.select("pat", "inst", "share", "seed").join(inst, "inst", "left").select(
            "pat", "inst", "share", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("q", F.lit(0.0))).alias("score")), "op8graph")
    return patterns(graph).select("pat", F.col("p").alias("score"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_score: float = 0.3,
                  least_seeds: int = 5) -> DataFrame:
    """Return (doc_id, base, found): arrays of spans (k, s, e) of the base patterns and of the bootstrapped ones."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = materialize(src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", base_spans(F.col("text")).alias("base"),
                                  instances(F.col("text")).alias("tokens")), "op8seen")
    occ = occurrences(seen)
    edges = materialize(occ.groupBy("pat", "word", "inst").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "op8edge")
    uses = (src.select(F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("word")).filter("word <> ''")
            .groupBy("word").agg(F.count("*").alias("uses")))
    good = trusted_patterns(edges, uses, rounds, least_score, least_seeds)
    new = (occ.filter("not in_base").join(good.select("pat"), "pat").groupBy("rid").agg(F.sort_array(F.collect_set(
        F.struct(F.lit(len(KINDS)).alias("k"), "s", "e"))).alias("found")))
    return seen.select("rid", "doc_id", "base").join(new, "rid", "left").select(
        "doc_id", "base", F.coalesce("found", F.expr(f"cast(array() as array<{SPAN}>)")).alias("found"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and the digest of base spans, and all spans as text."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return spans.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(F.concat("base", "found")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span of its text replaced by [kind]; all columns stay.  Overlapping spans become the first one's sign."""
    keyed = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "op8docs")
    spans = personal_data(keyed.select(F.col("__row").alias("doc_id"), F.col(text_col).alias("text")), **options)
    spans = spans.select(F.col("doc_id").alias("__row"), F.array_sort(F.transform(
        F.concat("base", "found"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))).alias("__spans")).filter("size(__spans) > 0")
    names = F.array(*[F.lit(f"[{x}]") for x in (*KINDS, "id")])
    t = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("__spans", zero, lambda a, x: F.when(x["s"] < a["at"], F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.get(names, x["k"])).alias("out"))))
    out = keyed.join(spans, "__row", "left").withColumn("__done", F.when(F.col("__spans").isNotNull(), done))
    text = F.when(F.col("__done").isNull(), t).otherwise(F.concat(F.col("__done.out"), F.expr(f"substr(`{text_col}`, __done.at + 1)")))
    return out.withColumn(text_col, text).select(*docs.columns)
