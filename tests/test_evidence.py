"""Payload fields, links, phrases and the evidence of decisions: edges, and plain versions where the oracle's data are narrow."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evidence as EV
from tessera.operators import payloads as PL
from tessera.operators.relational import numbered
from tessera.sources import pages as PG


def plain_years(text):
    """Every start of a phrase, its two windows cut out and searched."""
    years = set()
    for clause in re.split(r"(?<![0-9])\.|\.(?![0-9])|[!?;\n]", text or ""):
        for i in range(len(clause)):
            m = re.compile(r"(?i)\b(?:" + "|".join(T.VINTAGE) + r")\s*[:–—,-]?\s*((?:19|20)[0-9]{2})\b(?![./][0-9])").match(clause, i)
            if m and not re.search(r"год\s$", clause[:i]):
                near = clause[:i].rsplit(",", 1)[-1][-60:], clause[m.end():].split(",", 1)[0][:35]
                if not any(w in n.lower() for w in T.NO_VINTAGE for n in near):
                    years.add(m[1])
    return sorted(years)


def test_years_of_phrases_equal_the_plain_version(spark):
    rng = random.Random(3)
    parts = ["vintage 2003", "урожай 1998", "год урожая 2010 ", "Vintage, 2011 ", "винтажа — 2012", "vintage ", "Vintage: ", "vintage, ", "урожай ", "год урожая ", "Винтаж ", "2001", "1999", "2024", "1899", "20015", " ", ", ", ". ", "; ", "\n", ".5", "/12", "award ", "Награда ", "bottled ", "розлив ", "x" * 30, "wine ", "конкурс"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)] + ["", None, "vintage 2001" * 3, "award" + "x" * 55 + "vintage 2001", "award" + "x" * 56 + "vintage 2001", "award" + " " * 56 + "vintage 2001",
             "vintage 2001" + " " * 30 + "award", "vintage 2001" + " " * 31 + "award", "word " * 50_000 + "vintage 2001"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.phrase_years("t").alias("y")).collect()
    got = {r.i: r.y for r in rows}
    assert all(got[i] == plain_years(t) for i, t in enumerate(texts))
    assert sum(map(bool, got.values())) > 100
    with pytest.raises(ValueError):
        T.phrase_years("t", excluded=["x" * 40])


def test_numbers_follow_the_order_over_ranges(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("x").alias("_range"))
    assert [r.v for r in numbered(df.drop("_range"), ["v"], "n").orderBy("n").collect()] == sorted(r.v for r in df.collect())
    out = numbered(df.drop("_range"), ["v"], "n")
    assert sorted(r.n for r in out.collect()) == list(range(1, 5001)) and out.columns == ["v", "n"]
    assert numbered(df.limit(0), ["v"], "n").count() == 0


def test_bridge_keeps_known_ids_and_numbers_new_names(spark):
    items = spark.createDataFrame([(1, ["a", " b ", "a", ""]), (2, ["c", "b"]), (3, None), (4, [])], "k long, names array<string>")
    bridge, after = PL.bridge_rows(items, "k", F.col("names"), spark.createDataFrame([(7, "b"), (3, "z")], "id int, name string"))
    assert sorted(map(tuple, after.collect())) == [(3, "z"), (7, "b"), (8, "a"), (9, "c")]
    assert sorted(map(tuple, bridge.collect())) == [(1, 7), (1, 8), (2, 7), (2, 9)]
    empty = PL.bridge_rows(items, "k", F.col("names"), spark.createDataFrame([], "id long, name string"))[1]
    assert sorted(map(tuple, empty.collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_product_fields_of_odd_payloads(spark):
    payloads = [None, "", "[]", "5", "{", "{}", '{"title": null, "name": " n ", "total_rating": "", "rating": 2}', '{"title": {"name": [1]}, "x": null}', '{"properties": "p", "attrs": [], "y": 1}', '{"title": 5, "manufacturer": {"title": "  "}}']
    df = spark.createDataFrame([(i, p, "own") for i, p in enumerate(payloads)], "i long, payload string, other string")
    got = {r.i: r for r in PL.product_fields(df, "payload").collect()}
    assert all(got[i].title is None and got[i].characteristics is None for i in range(5)) and got[5].characteristics == {}
    assert (got[6].title, got[6].total_rating, got[6].other) == ("n", 2.0, "own")
    assert got[7].title is None and set(got[7].characteristics) == {"x"}
    assert got[8].characteristics_list == "[]" and got[8].characteristics is None
    assert (got[9].title, got[9].manufacturer) == ("5", None)


def test_reviewed_values_still_hold(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([1, 1.5, "1", None, True, [1, 2], {"a": 1, "b": 2}, {"b": 2, "a": 1}])
    rows = [({k: value() for k in "abc"[:rng.randint(0, 3)]}, {k: value() for k in "abc"[:rng.randint(0, 3)]}) for _ in range(400)]
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(rows)], "i long, a string, b string")
    same = lambda x, y: type(x) is type(y) and x == y
    got = {r.i: r.h for r in df.select("i", PL.still_equal(F.col("a"), F.col("b")).alias("h")).collect()}
    assert all(got[i] == all(k in a and same(a[k], v) for k, v in b.items()) for i, (a, b) in enumerate(rows))
    odd = spark.createDataFrame([(None, "{}"), ("{}", None), ("[]", "{}"), ("{}", "x"), ("{}", "{}")], "a string, b string")
    assert [r.h for r in odd.select(PL.still_equal(F.col("a"), F.col("b")).alias("h")).collect()] == [False] * 4 + [True]


def test_links_of_products_without_reviews(spark):
    base = "https://s.example/"
    pages = [(1, '<div class="names"><a href="/a/?x#y"> A <b>one</b></a><a href="/b">B</a><a href="/b"></a><a>none</a><a href="mailto:x">m</a><a href="https://t.example/c">c</a></div><a href="/d">outside</a>'),
             (2, '<link rel="canonical" href="https://s.example/r1"><div class="review"><a href="https://s.example/b/">B</a></div><p class="names"><a href="/a">Another</a><a href="/r1">R</a>'),
             (3, None), (4, ""), (5, '<div class="names"><a href="/">home</a><a href="http://[x">bad</a>'), (1, '<i class="names"><a href="/a">A one</a></i>')]
    products, origins = PG.discover_links(spark.createDataFrame(pages, "id long, html string"), "id", "html", base, ["names"], ["review"])
    assert [tuple(r) for r in products.collect()] == [("https://s.example/a", "A one", 2, 2)]
    assert sorted((r.url, r.title, r.id) for r in origins.collect()) == [("https://s.example/a", "A one", 1), ("https://s.example/a", "Another", 2)]


def test_variants_of_a_photo(spark):
    rules = ((None, "/small/", 4), ("a.example", "/full/", 0))
    rows = [(1, "https://a.example/full/x"), (1, "https://a.example/small/full/x"), (1, None), (2, "/full/x"), (2, "/full/x"), (3, "https://A.example:1/full/x?/small/"), (4, None)]
    got = {r.p: (r.preferred, r["rank"], r.variants) for r in PG.preferred_variants(spark.createDataFrame(rows, "p long, u string"), "p", "u", rules, 3).collect()}
    assert got == {1: ("https://a.example/full/x", 0, 2), 2: ("/full/x", 3, 1), 3: ("https://A.example:1/full/x?/small/", 0, 1)}


def test_votes_and_gate(spark):
    m = "struct<a: double, b: double, c: double, d: double>"
    df = spark.createDataFrame([(1, (1., 1., 1., 1.), (2., 2., 2., 2.)), (2, (1., None, 1., 1.), (1., 2., 0., 1. + 1e-13)), (3, None, (1., 1., 1., 1.))], f"i long, x {m}, y {m}")
    v = EV.metric_votes(F.col("x"), F.col("y"), "abcd")
    back = EV.metric_votes(F.col("y"), F.col("x"), "abcd")
    got = {r.i: (tuple(r.v), tuple(r.s), tuple(r.t)) for r in df.select("i", v.alias("v"), EV.pair_support(v, v, F.col("x").isNotNull()).alias("s"), EV.pair_support(back, back, F.col("x").isNotNull()).alias("t")).collect()}
    assert got == {1: ((0, 4, 4), (True, False, True), (True, True, False)), 2: ((1, 0, 1), (True, False, False), (True, False, False)), 3: ((0, 0, 0), (False, False, False), (False, False, False))}
    rows = [(1, 5, .9, 1), (1, 4, .9, 1), (2, 1, .5, 2), (2, 2, .49, 0), (3, 1, .5, None), (4, 1, .49, 9), (5, 1, .6, 1), (5, 2, .52, 1), (6, 1, None, 3)]
    gate = EV.hypothesis_gate(spark.createDataFrame(rows, "q long, id long, s double, n int"), "q", "id", "s", "n")
    assert {r.q: (r.id, r.accepted) for r in gate.collect()} == {1: (4, False), 2: (1, True), 3: (1, True), 4: (1, False), 5: (1, True)}


def test_kinds_of_failure(spark):
    cases = spark.createDataFrame([(1, 10, True, None), (2, 10, False, .5), (3, 10, None, .01)], "case long, truth long, suspect boolean, margin double")
    ranked = spark.createDataFrame([(2, 20, 1, True, .9, .9, .0), (2, 30, 2, True, .1, .1, .0), (2, 10, 3, True, .6, .7, .1), (3, 20, 1, True, .5, .5, .0), (3, 10, 2, False, .5, .2, .31)],
                                   "case long, id long, rank int, pooled boolean, identity double, geometry double, conflict double")
    groups = spark.createDataFrame([(20, "g"), (30, "g"), (20, "h"), (30, "h"), (10, "k")], "id long, grp string")
    rival = spark.createDataFrame([(2, 20, 1, .9), (2, 10, 2, .8), (3, 20, 1, .9)], "case long, id long, rank int, score double")
    got = {r.case: [r.kind, *r.further] for r in EV.failure_taxonomy(cases, ranked, groups, rival).collect()}
    assert got == {1: ["TARGET_SUSPECT", "RETRIEVAL_MISS", "LOW_INFORMATION"], 2: ["RERANK_ERROR", "SIBLING_AMBIGUITY", "OCR_CONFLICT", "SOURCE_CONFLICT"],
                   3: ["RETRIEVAL_MISS", "LOW_INFORMATION", "OCR_CONFLICT", "GEOMETRY_CONFLICT"]}


def test_priority_quality_and_drift_of_nulls(spark):
    df = spark.createDataFrame([(1, .9, None, None), (2, None, ["x"], False), (3, .1, [], True), (4, .7, [], None), (5, None, None, None)], "k long, s double, r array<string>, known boolean")
    got = sorted((r.diagnostic_rank, r.k, r.priority_level) for r in EV.diagnostic_priority(df, "k", "s", "r", "known").collect())
    assert got == [(1, 3, "high"), (2, 1, "high"), (3, 4, "medium"), (4, 2, "low"), (5, 5, "none")]
    none = spark.createDataFrame([], "k long, valid boolean, validity double")
    regions = spark.createDataFrame([(1, None, None, None, None), (1, 2, .5, "producer", .75)], "k long, support int, consensus double, kind string, confidence double")
    r = EV.evidence_quality(none, regions, spark.createDataFrame([(2, 1.0)], "k long, confidence double"), "k").collect()
    assert {x.k: (x.observations, x.regions, x.supported_regions, x.average_consensus, x.semantic_regions, x.high_semantic_regions, x.average_confidence) for x in r} == {1: (0, 2, 1, .5, 1, 1, 0.), 2: (0, 0, 0, 0., 0, 0, 1.)}
    f = "struct<matched: array<string>, conflicts: array<string>, missing: array<string>, weight: double>"
    old = spark.createDataFrame([(1, (["a"], [], [], 1.)), (2, None), (3, (["a"], [], [], 1.))], f"k long, f {f}")
    new = spark.createDataFrame([(1, (["a", "b"], [], [], 1.)), (2, None), (4, None)], f"k long, f {f}")
    assert {(x.field, x.item): x.n for x in EV.parser_drift(old, new, "k", ["f"]).collect() if x.n} == {("f", "matched"): 1, ("f", "matches_before"): 1, ("f", "matches_after"): 2, ("*", "vectors"): 2, ("*", "changed"): 1}


def test_dictionary_by_folded_names(spark):
    names = [(1, "Straße"), (2, "ＲＥＤ  one"), (3, "red\tONE"), (4, "white")]
    raw = [(1, " STRASSE;white,, White \n"), (2, "Red One"), (3, None), (4, "unknown"), (5, "")]
    good, bad = EV.dictionary_relations(spark.createDataFrame(raw, "k long, raw string"), "k", "raw", spark.createDataFrame(names, "id long, name string"))
    assert sorted(map(tuple, good.collect())) == [(1, 1, "Straße"), (1, 4, "white")]
    assert sorted((r.k, r.raw_token, r.reason, tuple(r.candidates)) for r in bad.collect()) == [(2, "Red One", "ambiguous_normalization", (2, 3)), (4, "unknown", "no_exact_dictionary_match", ())]


def test_typed_words(spark):
    df = spark.createDataFrame([("semi sweet red",), ("red white",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(T.first_class("t", T.CATEGORY), T.first_class("t", T.SWEETNESS), T.sole_class("t", T.COLOUR)).collect()]
    assert got == [("red", "semi_sweet", "red"), ("red", None, None), (None, None, None), (None, None, None)]
    fixed = spark.createDataFrame([("Ёлка — CABEMET 2O21!",), ("",), (None,)], "t string").select(T.recognised_text("t").alias("t"))
    assert [r.t for r in fixed.collect()] == ["елка cabernet 2021", "", None]
    fits = spark.createDataFrame([("color", "color"), ("producer", "title"), (None, "color"), ("color", None), ("color", "region")], "k string, f string").select(T.field_fit("k", "f").alias("x"))
    assert [r.x for r in fits.collect()] == [1.0, .72, .65, .65, .18]
