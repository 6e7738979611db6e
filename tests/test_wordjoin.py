"""The word joins against all pairs: no pair is lost, whatever the letters, lengths and bounds."""

import random

import pytest

from tessera.operators import lexical
from tessera.operators import wordjoin as J


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(n, letters, longest, seed):
    r = random.Random(seed)
    out = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(n)}
    for w in list(out)[: n // 2]:  # and words some edits away
        w = list(w)
        for _ in range(r.randint(1, 4)):
            at = r.randrange(len(w) + 1)
            w[at:at + r.randint(0, 1)] = r.choice([[], [r.choice(letters)]])
            w = w or ["a"]
        out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("least", [0.51, 0.6, 0.74, 0.78, 0.9])
@pytest.mark.parametrize("letters,longest", [("ab", 9), ("abcdefghжя№", 24)])
def test_edit_pairs_equal_all_pairs(spark, least, letters, longest):
    a, b = words(120, letters, longest, 1), words(120, letters, longest, 2) + words(120, letters, longest, 1)[::3]
    left = spark.createDataFrame([(w,) for w in [*a, *a[:9], None, ""]], "a string")
    right = spark.createDataFrame([(w,) for w in [*b, None, ""]], "b string")
    got = {(r["a"], r["b"]): r["similarity"] for r in J.edit_pairs(left, right, "a", "b", least).collect()}
    want = {(x, y): 1 - distance(x, y) / max(len(x), len(y)) for x in a for y in set(b)}
    want = {k: s for k, s in want.items() if s >= least}
    assert got == pytest.approx(want) and len(want) > 60
    with pytest.raises(ValueError):
        J.edit_pairs(left, right, "a", "b", 0.5)


def test_first_letter_does_not_matter(spark):
    left = spark.createDataFrame([("anapa",), ("purchase",)], "a string")
    right = spark.createDataFrame([("xnapa",), ("xurchase",)], "b string")
    assert {(r["a"], r["b"]) for r in J.edit_pairs(left, right, "a", "b", 0.78).collect()} == {("anapa", "xnapa"), ("purchase", "xurchase")}


def dice(x, y):
    if x == y:
        return 1.0
    if min(len(x), len(y)) >= 4 and (x.startswith(y) or y.startswith(x)):
        return 0.82
    p, q = ([w[i:i + 2] for i in range(len(w) - 1)] for w in (x, y))
    return 2 * sum(min(p.count(g), q.count(g)) for g in set(p)) / (len(p) + len(q)) if p and q else 0.0


def test_dice_pairs_equal_all_pairs(spark):
    a, b = words(90, "abc", 8, 3), words(90, "abc", 8, 4) + ["abab", "ababab", "a", "aaaa"]
    a += ["ababa", "a", "aaa", "abcabc"]
    got = {(r["a"], r["b"]): r["similarity"] for r in J.dice_pairs(spark.createDataFrame([(w,) for w in a], "a string"), spark.createDataFrame([(w,) for w in b], "b string"), "a", "b").collect()}
    assert got == pytest.approx({(x, y): dice(x, y) for x in set(a) for y in set(b) if dice(x, y) > 0})


def test_texts_holding_parts(spark):
    texts, parts = words(60, "ab ", 12, 5), [*words(40, "ab", 5, 6), "a", "b b"]
    got = J.texts_holding(spark.createDataFrame([(w,) for w in texts], "x string"), spark.createDataFrame([(w,) for w in parts], "_k string"), "x", "_k")
    assert {tuple(r) for r in got.collect()} == {(x, p) for x in texts for p in set(parts) if p in x}


def test_nearest_words(spark):
    d = spark.createDataFrame([(w,) for w in ("merlot", "malbec", "rose", "rosa", "muscat")], "w string")
    t = spark.createDataFrame([(w,) for w in ("merlot", "nerlot", "merlots", "rosé", "xyz", None)], "t string")
    got = {r["t"]: (r["w"], round(r["similarity"], 4)) for r in J.nearest_words(t, d, "t", "w", 0.74, 0.26).collect()}
    assert got == {"merlot": ("merlot", 1.0), "nerlot": ("merlot", 0.8333), "merlots": ("merlot", 0.8571), "rosé": ("rosa", 0.75)}


def plain_tag_match(queries, tags, k=5):
    out = []
    for q, text in queries:
        tokens = list(dict.fromkeys(text.split()))
        for item in sorted({i for i, _, _ in tags}):
            best = [max((max(max(dice(t, v) for v in g.split()), 1.0 if g in text else 0.0) * min(1, max(0, w)) for i, g, w in tags if i == item), default=0) for t in tokens]
            n = sum(round(s, 9) >= 0.52 for s in best)
            score = min(0.99, sum(best) / len(tokens) * 0.62 + max(best) * 0.32 + min(0.12, max(0, n - 1) * 0.06))
            if n and round(score, 9) >= 0.38:
                out.append((q, item, n, score))
    out.sort(key=lambda r: (r[0], -round(r[3], 9), r[1]))
    return [r for r in out if sum(x[0] == r[0] and out.index(x) < out.index(r) for x in out) < k]


def test_tag_match_equals_a_plain_loop(spark):
    queries = [("1", "xnapa red dry"), ("2", "sovignon blan"), ("3", "grand reserve old"), ("4", "zzz")]
    tags = [(1, "anapa", 0.9), (1, "red dry", 0.7), (2, "sauvignon blanc", 1.4), (2, "white", 0.3), (3, "grand reserve", 0.8), (3, "old vines", 0.6), (4, "reserva", 0.9), (5, "red", -1.0), (6, "o", 0.9)]
    got = lexical.tag_match(spark.createDataFrame(queries, "q string, text string"), spark.createDataFrame(tags, "id long, tag string, w double"), "q", "text", "id", "tag", "w")
    assert [tuple(r) for r in got.orderBy("q", "matched").collect()] and sorted((r["q"], r["id"], r["matched"], round(r["score"], 9)) for r in got.collect()) == sorted((q, i, n, round(s, 9)) for q, i, n, s in plain_tag_match(queries, tags))
