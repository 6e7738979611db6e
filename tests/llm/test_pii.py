"""Bootstrapped personal data: patterns of later rounds, long identifiers, scores against plain Python, edge cases."""

import math
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii
from tests.llm.test_operators import brute_spans, frame


def found(spark, texts, **options):
    rows = pii.digest(pii.personal_data(frame(spark, texts), **options)).collect()
    return {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("id")] for r in rows}


def spans_of(text, *parts):
    return [f"id:{text.index(p)}:{text.index(p) + len(p)}" for p in parts]


def test_second_round_pattern_and_long_identifiers(spark):
    keys = [f"k{i}-{1000 + i * 7919}" for i in range(8)]
    texts = [f"mail contact user{i}@mail.example.com soon" for i in range(8)] + [f"mail contact {k} soon" for k in keys]  # trusted cue, unseen keys
    texts += [f"his passport {k} was lost" for k in keys] + ["her passport zx-99123-q was found"]  # no base seed ever stands there
    long = "a" * 80 + "1" * 40
    texts += [f"mail contact {long} soon", f"mail contact {'b' * 3000}7 soon", "the report of 20244 pages", "we saw 31337 birds"]
    got = found(spark, texts)
    assert all(got[8 + i] == spans_of(texts[8 + i], k) for i, k in enumerate(keys))
    assert got[24] == spans_of(texts[24], "zx-99123-q")
    assert got[25] == spans_of(texts[25], long) and len(got[26]) == 1 and got[27] == got[28] == []
    assert found(spark, texts, rounds=1)[24] == []


def test_right_hand_patterns_and_seed_forms(spark):
    random.seed(3)
    key = lambda n: "".join(random.choice("0123456789abcdef") for _ in range(n)) + "0f"
    texts = [f'w{"abcdefgh"[i]} token = "{key(38)}" and so on' for i in range(8)] + ['set token = "short-77" now', "commit " + key(38) + " is no secret"]
    texts += [f"q{'abcdefgh'[i]} +49 30 55501{i}0 ring" for i in range(8)] + ["x 030-55512 ring"]
    got = found(spark, texts)
    assert got[8] == spans_of(texts[8], "short-77") and got[9] == [] and len(got[0]) == 1
    assert got[18] == spans_of(texts[18], "030-55512")


def test_scores_equal_plain_python(spark):
    random.seed(4)
    edges = {}
    for _ in range(400):
        p, i = random.randrange(25), random.randrange(60)
        edges["lr"[p % 2] + f"w{p}", f"i{i}"] = (i < 15, random.randint(1, 3))
    uses = {f"w{p}": random.randint(1, 120) for p in range(25)}
    least, seeds = 0.2, 3
    share, score = {}, {i: float(s) for (_, i), (s, _) in edges.items()}
    for p, i in edges:
        share[p] = share.get(p, 0) + edges[p, i][1]
    share = {p: min(1.0, n / uses[p[1:]]) for p, n in share.items()}
    for _ in range(3):
        trusted = {}
        for p in share:
            mine = [score[i] for q, i in edges if q == p]
            conf = sum(mine) / len(mine) * share[p]
            if conf >= least and sum(x >= least for x in mine) >= seeds:
                trusted[p] = conf
        score = {i: 1.0 if s else 1 - math.prod(1 - trusted[p] for p, j in edges if j == i and p in trusted) for (_, i), (s, _) in edges.items()}
    df = spark.createDataFrame([(p, p[1:], i, s, n) for (p, i), (s, n) in edges.items()], "pat string, word string, inst string, seed boolean, n long")
    got = pii.trusted_patterns(df, spark.createDataFrame(list(uses.items()), "word string, uses long"), 3, least, seeds)
    got = {r["pat"]: r["score"] for r in got.collect()}
    assert trusted and len(trusted) < len(share) and got.keys() == trusted.keys()
    assert all(abs(got[p] - trusted[p]) < 1e-9 for p in got)


def test_many_matches_and_edges(spark):
    many = " ".join(f"1.2.3.{i % 256}" for i in range(3 * pii.BLOCK + 7))
    texts = [many, None, "", "é" * 5000 + "\x01 a@b.co", many + " é " + many]
    rows = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_data(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert [x for x in rows[i].split(",") if x and not x.startswith("id")] == brute_spans(t)
    assert pii.personal_data(frame(spark, texts).limit(0)).count() == 0
    same = spark.createDataFrame([(None, "call a@b.co"), (None, "call a@b.co"), (1, None)], "doc_id long, text string")
    assert [r["n"] for r in pii.personal_data(same).select(F.size("base").alias("n")).orderBy("n").collect()] == [0, 1, 1]


def test_secrets_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {(i, m.start(1), m.end(1)) for i, t in text.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
    got = {(r["doc_id"], x["s"], x["e"]) for r in pii.personal_data(docs).collect() for x in r["found"]}
    assert want and want <= got and len(got - want) <= 0.05 * len(got)
