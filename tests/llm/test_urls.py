"""URL verdicts: brute-force models and verdicts, hosts found without their words, planted urls outside the seeds, and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import url_filter as U


def brute_log(texts, train):
    """Mean log probability of each text's bytes and end under counts of ``train``, as plain dictionaries."""
    frame = lambda t: b"\x01" * (U.ORDER - 1) + t.encode() + b"\x02"
    gram, context = Counter(), Counter()
    for t in map(frame, train):
        for i in range(U.ORDER - 1, len(t)):
            for k in range(1, U.ORDER + 1):
                gram[t[i - k + 1:i + 1]] += 1
                context[k, t[i - k + 1:i]] += 1
    out = []
    for t in map(frame, texts):
        total = 0.0
        for i in range(U.ORDER - 1, len(t)):
            p = 1 / 256
            for k in range(1, U.ORDER + 1):
                p = (gram[t[i - k + 1:i + 1]] + U.SHRINK * p) / (context[k, t[i - k + 1:i]] + U.SHRINK)
            total += math.log(p)
        out.append(total / (len(t) - U.ORDER + 1))
    return np.array(out)


def counted(train):
    text, grams, contexts = U.cells(train)
    n = np.zeros((U.ORDER, 2, U.CELLS))
    for k in range(U.ORDER):
        n[k, 0] += np.bincount(grams[k], minlength=U.CELLS)
        n[k, 1] += np.bincount(contexts[k], minlength=U.CELLS)
    return n


def test_model_equals_plain_markov():
    good, bad = ["a.example.com/en/0", "b.example.com/", "é.org/x?y=0"], ["casino-win.example.com/en/0", "x"]
    ask = ["a.example.com/en/0", "casino.example.org/", "zzz", "é"]
    got = U.likelihood_difference(ask, counted(good), counted(bad))
    assert np.allclose(got, brute_log(ask, bad) - brute_log(ask, good), atol=1e-9)


def pages(spark, urls, first=0):
    return spark.createDataFrame([(first + i, u, 1, "r") for i, u in enumerate(urls)], "page_id long, url string, host int, rule string")


def test_planted_urls_outside_the_seeds(spark):
    have = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").selectExpr("page_id", "url", "1 as host", "'r' as rule")
    marked = ["http://blog.ththth.example.org/en/casino-bonus/12", "https://tionsh.example.net/en/cheap-pills.html"]
    unmarked = [f"https://{h}.example.com/fr/3" for h in ("slots-win", "best-lottery-win", "free-slots", "pillshop", "x-cams", "casinowin")]
    fair = ["https://ththnew.example.com/fr/4", "https://www.thering.example.com/fr/4?page=2", "http://m.ththou.example.com/es/99"]
    rows = U.judge_urls(have.union(pages(spark, marked + unmarked + fair, 10**9))).collect()
    got = [v for _, v in sorted((r["page_id"], r["verdict"]) for r in rows if r["page_id"] >= 10**9)]
    assert got[:2] == ["block"] * 2 and got[8:] == ["allow"] * 3
    assert got[2:8].count("block") >= 4  # no seed word in these hosts
    # what two of the words marked is judged by the rules' verdicts without them; all else stays
    less = U.judge_urls(have, seeds=[s for s in U.SEEDS if s not in ("cheap", "pills")]).filter("rule is null and host like '%-%' and host not like '%cheap%'").collect()
    assert less and all(r["verdict"] == "block" for r in less)
    assert not any(r["verdict"] == "block" and r["rule"] is None and "-" not in r["host"] and r["page_id"] < 10**9 for r in rows)


@pytest.mark.parametrize("left", [("adult",), ("bet", "bets"), ("ads", "track"), ("casino",), ("cheap", "pills"), ("farm", "spam")])
def test_a_host_is_found_without_its_words(spark, left):
    """Without the words of one host most of its urls are still blocked, and none of the hosts that no word marks."""
    rows = U.judge_urls(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), seeds=[s for s in U.SEEDS if s not in left]).filter("rule is null").collect()
    own = [r["verdict"] for r in rows if any(w in r["host"] for w in left)]
    assert own.count("block") > 0.5 * len(own) > 0
    assert not [r for r in rows if r["verdict"] == "block" and "-" not in r["host"]]


def test_verdicts_equal_a_plain_version(spark):
    rng = np.random.default_rng(5)
    fair = ["".join(rng.choice(["ta", "ri", "no", "the"], 3)) for _ in range(14)]
    urls = [f"http://{h}.shop.com/{p}/{i}" for h in fair for i, p in enumerate(("fr", "de", "en"))] + [f"http://{h}.shop.com/{p}" for h in ("xq-win", "xq-bets", "qx-win7") for p in ("fr/1", "bets/2", "en/3")]
    urls += [None, "nothing", "http://", f"http://{fair[0]}.shop.com/xq-win/", "http://lone/"]
    seeds = ("bets",)
    got = {r["page_id"]: (r["verdict"], r["llr"]) for r in U.judge_urls(pages(spark, urls), seeds=seeds, rules=[("block", "com", "/en/")]).collect()}
    hosts = [u.split("://")[1].split("/")[0] if u and "://" in u else "" for u in urls]
    fold = {r["h"]: r["f"] for r in spark.createDataFrame([(h,) for h in set(hosts)], "h string").selectExpr("h", f"pmod(xxhash64(h), {U.FOLDS}) f").collect()}
    short = lambda t: re.sub("[0-9]+", "0", t)
    data = []
    for u, h in zip(urls, hosts):
        rest = u.split("://")[1][len(h):] if u and "://" in u else ""
        ruled = "block" if h.endswith(".com") and rest.startswith("/en/") else None
        site, rest = short(re.sub(r"\.[^.]*$", "", h)), short(rest)
        bad = {t: bool(set(re.split("[^a-z0-9]+", t)) & set(seeds)) for t in (site, rest)}
        data.append((fold[h], [t for t in (site, rest) if t], any(bad.values()), ruled, {t for t in bad if bad[t] or ruled == "block"}))
    def score(i, own):
        f, texts, *_ = data[i]
        labelled = lambda t: own and bool(set(re.split("[^a-z0-9]+", t)) & set(seeds))
        table = lambda c, keep: counted([t for _, t in sorted({(g, t) for g, ts, _, _, r in data if g != f or keep for t in ts if (t in r) == c})])
        return max((float(U.likelihood_difference([t], table(False, False), table(True, labelled(t)))[0]) for t in texts), default=None) if data[i][3] is None else None

    fitted, llr = ([score(i, own) for i in range(len(data))] for own in (False, True))
    free = {(f, tuple(texts), seeded): x for (f, texts, seeded, ruled, _), x in zip(data, fitted) if x is not None}
    low = lambda v: sorted(v)[(len(v) - 1) // 2] if v else None
    a, b = (low([x for k, x in free.items() if k[2] == c]) for c in (False, True))
    cut = max(a + 5 * 1.4826 * low([abs(x - a) for k, x in free.items() if not k[2]]), (a + b) / 2, 0)
    for i, (x, d) in enumerate(zip(llr, data)):
        assert got[i][0] == (d[3] or ("block" if x is not None and x > cut else "allow"))
        assert (got[i][1] is None) == (x is None) and (x is None or np.isclose(got[i][1], x, atol=1e-4))
    assert {v for v, _ in got.values()} == {"block", "allow"}


def test_edges(spark):
    urls = [None, "", "x", "http://", "http:///p", "http://a.example.com/en/1", "http://a.example.com/en/1", "HTTP://A.EXAMPLE.COM/en/7" + "z" * 60000, "http://é.net/x"]
    got = [r for r in U.judge_urls(pages(spark, urls)).orderBy("page_id").collect()]
    assert [r["host"] for r in got] == ["", "", "", "", "", "a.example.com", "a.example.com", "a.example.com", "é.net"]
    assert [r["rule"] for r in got] == [None] * 5 + ["com/en/", "com/en/", "example.com/en/7", None]
    assert [r["verdict"] for r in got[:4]] == ["allow"] * 4 and got[5] == got[6].__class__(page_id=5, **{k: v for k, v in got[6].asDict().items() if k != "page_id"})
    assert got[3]["llr"] is None and got[7]["llr"] is None and got[8]["llr"] is not None
    assert U.judge_urls(pages(spark, urls).limit(0)).count() == 0
    assert {r["verdict"] for r in U.judge_urls(pages(spark, ["http://a.b/c", "http://b.b/c"])).collect()} == {"allow"}
