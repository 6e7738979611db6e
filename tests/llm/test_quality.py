"""The word model against a plain Kneser-Ney recursion, held-out separation by labels, and edge cases."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tessera.llm import quality as Q

START, END = "<s>", "</s>"


class Plain:
    """Interpolated modified Kneser-Ney over tuples of words."""

    def __init__(self, texts, order):
        self.order, self.count = order, {order: Counter()}
        for t in filter(str.strip, texts):
            w = [START] * max(1, order - 1) + t.split() + [END]
            lead = max(1, order - 1)
            for i in range(lead, len(w)):
                self.count[order][tuple(w[i - order + 1:i + 1])] += 1
        for o in range(order - 1, 0, -1):
            self.count[o] = Counter(g[1:] for g in self.count[o + 1])
        self.discount = {o: Q.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for o, c in self.count.items()}

    def p(self, gram):
        if not gram:
            return 1 / (len(self.count[1]) + 1)
        o = len(gram)
        c, d = self.count[o], self.discount[o]
        mine = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        low = self.p(gram[1:])
        if not mine:
            return low
        off = lambda n: d[min(n, 3) - 1] if n else 0.0
        return (c[gram] - off(c[gram])) / sum(mine) + sum(map(off, mine)) / sum(mine) * low

    def perplexity(self, text):
        w = [START] * max(1, self.order - 1) + text.split() + [END]
        lead = max(1, self.order - 1)
        logs = [math.log(self.p(tuple(w[i - self.order + 1:i + 1]))) for i in range(lead, len(w))]
        return math.exp(-sum(logs) / len(logs))


@pytest.mark.parametrize("order,head,bits", [(2, 0, 6), (3, 20, 20), (2, 1000, 12)])
def test_perplexity_equals_plain_kneser_ney(spark, order, head, bits):
    random.seed(11)
    words = "the cat dog sat on a mat ran to and fro of it".split()
    make = lambda n: " ".join(random.choice(words[:random.choice((4, 13))]) for _ in range(n))
    train = [make(random.randint(1, 30)) for _ in range(40)] + ["the", "the", "", "a\tmat \n ran"]
    ask = [make(12) for _ in range(10)] + ["zebra", "the zebra sat", "mat mat mat mat", "the"]
    model, unknown = Q.fit(spark.createDataFrame([(t,) for t in train], "text string"), order, 3)
    docs = spark.createDataFrame(list(enumerate(ask)), "rid long, text string")
    got = {r["rid"]: r["s"] for r in Q.score(docs, model, order, 3, head, bits).collect()}
    assert len(Q.common_grams(model, head)[0]) <= head
    plain = Plain(train, order)
    for i, t in enumerate(ask):
        m = len(t.split()) + 1
        assert math.exp(-(got.get(i, 0.0) + unknown * m) / m) == pytest.approx(plain.perplexity(t), rel=1e-4)
    context = ("the",) * (order - 1)
    vocabulary = [g[0] for g in plain.count[1]] + ["unseen"]
    assert sum(plain.p((*context, w)) for w in vocabulary) == pytest.approx(1.0)


def test_labels_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = Q.judge(docs, labels).toPandas().set_index("doc_id")
    ids = Q.trusted_ids(labels).selectExpr("doc_id", "pmod(xxhash64(doc_id), 5) = 0 as held").toPandas()
    held = got.loc[ids[ids["held"]]["doc_id"]]  # texts that the model has not seen
    bad = got.loc[labels.filter("quality = 0").select("doc_id").distinct().toPandas()["doc_id"]]
    assert held["keep"].mean() > 0.98 and bad["keep"].mean() < 0.25
    a, b = held["perplexity"].dropna().to_numpy(), bad["perplexity"].dropna().to_numpy()
    assert (a[:, None] < b[None, :]).mean() > 0.9


def test_quality_edges(spark):
    good = ["the cat sat on the mat and ran to the dog"] * 3 + ["a dog ran on a mat and the cat sat"] * 3
    rows = [(i, t, "en", "x", 1) for i, t in enumerate(good * 10)]
    rows += [(900, None, "en", "x", 1), (901, " \t", None, "x", 1), (None, good[0], None, "x", 1), (903, "#!% " * 40_000, "en", "x", 1), (70, "zz qq " * 30, "en", "x", 1), (70, good[0], "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity string, rid int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(0, 0, 0), (None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = Q.judge(docs, labels, least_trusted=1).collect()
    keep = [r["keep"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 900]
    assert len(got) == len(rows) and keep == [False] * 3
    assert sorted(r["keep"] for r in got if r["doc_id"] == 70) == [False, True]  # rows of one id have their own verdicts
    assert [r["keep"] for r in got if r["doc_id"] is None] == [True]
    free = Q.judge(docs, labels.limit(0)).collect()
    assert sum(r["keep"] for r in free) == len(rows) - 2
    assert Q.judge(docs.limit(0), labels).count() == 0


def test_pairs_are_on_disk_once(spark, monkeypatch):
    """Beside the counts or values of all pairs only those of one part are written."""
    random.seed(5)
    texts = [" ".join(random.choice("abcdefghijklmnopqrstuvwxyz") + random.choice("ab") for _ in range(60)) for _ in range(150)]
    live, peak, write, drop = {}, [0], Q.materialize, Q.discard
    folders = lambda t: {f.rpartition("/")[0] for f in t.inputFiles()}

    def materialize(df, name="t"):
        out = write(df, name)
        live.update(dict.fromkeys(folders(out), out.count()))
        peak[0] = max(peak[0], sum(live.values()))
        return out

    def discard(*tables):
        for f in set().union(*map(folders, tables)):
            live.pop(f, None)
        drop(*tables)

    monkeypatch.setattr(Q, "materialize", materialize)
    monkeypatch.setattr(Q, "discard", discard)
    model, _ = Q.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    pairs = {p for t in texts for p in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)}
    assert len(pairs) > 2000 and model.count() == len(pairs) + 54
    assert peak[0] < 1.4 * len(pairs)
    assert sum(live.values()) == model.count()


def test_word_keys_follow_words():
    texts = ["", None, " a\tb a \n", "abcdefgh abcdefghi abcdefgh", "\u00e9\u00a0x a", "x" * 300 + " " + "x" * 301 + " a", "\x0b", "a" * 16 + " " + "a" * 17, "b"]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    keys, n = Q.word_keys(pa.array(["pad", *texts]).slice(1))
    words = [w for s in split for w in s]
    assert n.tolist() == [len(s) for s in split] and len(keys) == len(words)
    assert len(set(zip(words, keys.tolist(), strict=True))) == len(set(words)) == len(set(keys.tolist()))
