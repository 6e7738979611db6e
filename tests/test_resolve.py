"""Scores of entity resolution against the same rules in plain Python."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import resolve as R

FIELDS = "i int, name string, title string, maker string, doc string"


def norm(s):
    return " ".join("".join(c if c.isalnum() else " " for c in (s or "").lower().replace("ё", "е")).split())


def plain_product(name, title, maker, doc):
    n, t, d = map(norm, (name, title, doc))
    words = lambda s: {x for x in s.split() if len(x) > 1} - set(R.STOP)
    year = lambda s: set(re.findall(r"\b(?:19|20)\d\d\b", s or ""))
    say = lambda a, b: 0.0 if not a or not b else 1.0 if a & b else -0.5
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    nt, tt, dt = words(n), words(t), words(d)
    known = len(tt & set(R.GRAPES + R.STYLE))
    generic = not tt or (len(tt) <= 2 and known == len(tt)) or (len(tt) <= 3 and known >= 2)
    mt = words(norm(maker)) - set(R.MAKER_STOP) - set(R.STYLE)
    m = 0.0 if not mt else 1.0 if mt & nt else 0.0
    y, s = say(year(name), year(doc)), say(set(n.split()) & set(R.STYLE), set(d.split()) & set(R.STYLE))
    inside = 0.0 if not n or not t else 1.0 if n == t else (0.75 if generic else 0.85) if n in t or t in n else 0.0
    score = .25 * ratio(n, t) + .15 * ratio(n, d) + .22 * (len(nt & dt) / len(nt | dt) if nt and dt else 0) + .12 * inside + .28 * m + .05 * max(y, 0) + .1 * max(s, 0) - .08 * (y < 0) - .06 * (s < 0)
    bare, caps = y <= 0 and s <= 0, []
    for cond, top, reason in ((y < 0, .69, "year_mismatch"), (s < 0, .74, "style_mismatch"), (generic and m < .5, .69, "generic_short_title_without_manufacturer"),
                              (generic and m < .5 and bare, .62, "generic_short_title_without_evidence"), (len(nt) >= 6 and len(tt) <= 2 and m < .5, .69, "long_source_short_title"),
                              (generic and m >= .5 and bare, .82, "generic_short_title_manufacturer_only")):
        if cond:
            score = min(score, top)
            caps.append(reason)
    return max(0, min(1, score)), caps


def test_product_scores_equal_plain_python(spark):
    random.seed(31)
    rows = [("Бельбек. Фиолент. Мерло. Российское вино с ЗГУ «Крым», полусладкое красное 2024", "Мерло", "Фанагория", "Мерло Фанагория Красное сухое Кубань"),
            ("Винодельня Бельбек. Пти Вердо. Российское вино с ЗГУ «Крым», сухое красное 2023", "Бельбек Пти Вердо", "Винодельня Бельбек", "Бельбек Пти Вердо Винодельня Бельбек Красное сухое Крым"),
            ("LETO Мускат Оранж 2024 сухое белое", "LETO Мускат Оранж 2021 сухое белое", "LETO", "LETO Мускат Оранж 2021 сухое белое LETO белое сухое Россия"), (None, "x", None, "x"), ("", None, "", "")]
    pool = R.STYLE + R.GRAPES + ["вино", "крым", "бельбек", "долина", "2020", "2021", "завод", "leto", "Ёлка"]
    make = lambda n: " ".join(random.choice(pool) for _ in range(random.randint(0, n)))
    for _ in range(150):
        t, m = make(3), make(2)
        rows.append((make(8) + " " + random.choice((t, "")), t, m, f"{t} {m} {make(3)}"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FIELDS)
    seen = set()
    for r in R.score_products(df, "name", "title", "maker", "doc").collect():
        score, caps = plain_product(*rows[r["i"]])
        assert abs(r["score"] - score) < 1e-4 + 1e-9 and r["caps"] == caps, rows[r["i"]]
        seen.update(caps)
    assert len(seen) == 6
    best = {r["i"]: r for r in R.score_products(df.limit(3), "name", "title", "maker", "doc").collect()}
    assert best[0]["score"] < 0.7 and best[1]["score"] >= 0.8 and "year_mismatch" in best[2]["caps"]


def test_review_scores_rank_and_gate(spark):
    words = R.ReviewWords(generic=("wine", "winery", "suhoe", "krasnoe", "beloe", "vino"), grapes=("merlo", "shardone", "kaberne", "sovinon"))
    rows = [(1, 1, "Fanagoria Cru Lermont Merlot 2020", "Fanagoria", "red dry", "cru-lermont-merlo-2020", "Крю Лермонт Мерло", "Фанагория", "Мерло", "красное"),
            (1, 2, "Fanagoria Cru Lermont Merlot 2020", "Fanagoria", "red dry", "other-line-merlo", "Другая Линия Мерло", "Фанагория", "Мерло", "красное"),
            (1, 3, "Fanagoria Cru Lermont Merlot 2020", "Fanagoria", "red dry", "cru-lermont-shardone", "Cru Lermont Chardonnay", "Fanagoria", "Chardonnay", "белое"),
            (2, 1, "Merlot", None, None, "cru-lermont-merlo-2020", "Крю Лермонт Мерло", "Фанагория", "Мерло", "красное"),
            (3, 4, "Blue Hill Reserve", "Blue Hill", None, "reserve", "Reserve", "Blue Hill", None, None), (3, 5, "Blue Hill Reserve", "Blue Hill", None, "reserve", "Reserve", "Blue Hill", None, None)]
    df = spark.createDataFrame(rows, "p int, c int, title string, brand string, kind string, slug string, official string, winery string, grapes string, category string")
    scored = R.score_reviews(df, words)
    got = {(r["p"], r["c"]): r for r in scored.collect()}
    assert got[1, 1]["score"] > got[1, 2]["score"] and "conflicting_product_identity" in got[1, 2]["caps"]
    assert {"grape_conflict", "style_conflict"} <= set(got[1, 3]["caps"]) and got[1, 3]["score"] <= 0.49
    assert "missing_discriminative_identity" in got[2, 1]["caps"] and got[2, 1]["status"] == "unmatched"
    gated = {(r["p"], r["c"]): r for r in R.match_reviews(scored, "p", "c").collect()}
    assert gated[3, 4]["rank"] == 1 and gated[3, 4]["status"] != "matched"  # the next one is as good
    d = R.discovery_status(R.match_reviews(scored, "p", "c", k=1).withColumn("n_titles", F.lit(1))).collect()
    assert {r["p"]: r["discovery"] for r in d}[2] == "reject"


def test_identity_plan(spark):
    rows = [("eq", 1, 10, True, False, True, 1.0, 3, [], False, False), ("media", 2, 11, False, False, True, 0.2, 2, [], True, True), ("two", 3, 12, True, False, True, 1.0, 3, [], False, False),
            ("two", 3, 13, True, False, True, 1.0, 3, [], False, False), ("far", 4, 14, False, False, False, 0.1, 0, [], False, False), ("year", 5, 15, True, False, True, 1.0, 3, ["year"], False, False),
            ("collides", 6, 16, True, False, True, 1.0, 3, [], False, False)]
    df = spark.createDataFrame(rows, "why string, item int, other int, eq boolean, inn boolean, mk boolean, sim double, su int, hard array<string>, media boolean, ev boolean")
    c = R.identity_candidates(df, *[F.col(x) for x in ("eq", "inn", "mk", "sim", "su", "hard", "media", "ev")])
    got = {r["why"]: r for r in c.collect()}
    assert "far" not in got and got["eq"]["automatic"] and got["media"]["contradictions"] == ["title_unconfirmed"] and not got["media"]["automatic"] and got["year"]["plausible"] and not got["year"]["automatic"]
    plan = {r["item"]: (r["class"], r["selected"]) for r in R.identity_plan(df.select("item").distinct(), c, "item", "other", spark.createDataFrame([(6,)], "item int")).collect()}
    assert plan == {1: ("re_slug", 10), 2: ("manual_review", None), 3: ("manual_review", None), 4: ("true_new", None), 5: ("manual_review", None), 6: ("manual_review", None)}


def test_ratio_and_phrases(spark):
    random.seed(32)
    pairs = [("".join(random.choice("abcé ") for _ in range(random.randint(0, 12))), "".join(random.choice("abcé ") for _ in range(12))) for _ in range(60)] + [(None, "a"), ("", "")]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", T.ratio("a", "b").alias("r")).collect()
    for r in got:
        a, b = pairs[r["i"]]
        assert r["r"] == (SequenceMatcher(None, a, b).ratio() if a and b else 0.0)
    assert T.phrase_spans("a b c a b d".split(), {"a": [("a", "b"), ("a", "b", "c"), ("a",)], "d": [("d",)]}) == [(0, 3, "a b c"), (3, 5, "a b"), (5, 6, "d")]


def test_text_candidates_equal_plain_python(spark):
    from tessera.operators import lexical as L

    titles = ["red bolt 2001", "red ring", "reed bold 1999", "hot gizmo", "bolt", "old plate 2001 large"]
    texts = ["red bolts 2001", "hot gizmos old", "x"]
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    items = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = L.text_candidates(spark.createDataFrame(list(enumerate(texts)), "q long, text string"), items, "q", "text", "id", "title", k=4).collect()
    for q, text in enumerate(texts):
        rows = []
        for i, t in enumerate(titles):
            best = sorted((max(ratio(w, x) for x in text.split()) for w in t.split()), reverse=True)
            year = int(bool({w for w in t.split() if re.fullmatch("(19|20)[0-9]{2}", w)} & set(text.split())))
            rows.append((sum(b >= .82 for b in best), sum(b >= .999 for b in best), year, round(sum(best[:3]) / len(best[:3]), 9), round(ratio(t, text), 9), -i))
        want = [-r[5] for r in sorted(rows, reverse=True)[:4]]
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["q"] == q] == want


def test_bounds_settle_pairs_without_changing_the_best(spark):
    """The bound is never under the similarity, and pruning by bounds keeps the k best of every row."""
    import random

    from tessera.functions import text as T
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnoе") for _ in range(r.randint(1, 6)))
    common = [word() for _ in range(12)]
    texts = [" ".join(r.choice([word(), r.choice(common)]) for _ in range(r.randint(1, 5))) for _ in range(60)] + ["", "aaa", "2015 red", "ab " * 90, "ab cd " * 50]
    pairs = spark.createDataFrame([(i, j, a, b, word(), f"{b} {word()} 2016") for i, a in enumerate(texts[:25]) for j, b in enumerate(texts)], "l int, r int, n string, t string, m string, d string")
    bound = pairs.select(T.ratio("n", "t").alias("x"), T.ratio_bound("n", "t").alias("b"), T.ratio_floor("n", "t").alias("f")).collect()
    assert all(x["b"] >= x["x"] - 1e-12 and x["f"] <= x["x"] + 1e-12 for x in bound) and any(x["b"] < 0.6 for x in bound)
    words = R.Words(style=("red",), generic=("ab", "red"), stop=(), maker_stop=())
    args = ("n", "t", "m", "d", words)
    for k, floor in ((1, 0.0), (5, 0.1), (5, 0.3)):
        full = R.top_matches(R.score_products(pairs, *args), "l", "r", floor, k).select("l", "r", "score", "rank")
        some = R.score_products(pairs, *args, best=("l", k, floor))
        cut = R.top_matches(some, "l", "r", floor, k).select("l", "r", "score", "rank")
        assert sorted(map(tuple, full.collect())) == sorted(map(tuple, cut.collect()))
        assert some.count() < pairs.count() * 0.7
