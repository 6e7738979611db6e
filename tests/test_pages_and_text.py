"""Page parsing, flat payloads and the text normaliser on written cases."""

import html as H
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import relational as R
from tessera.sources import pages as P

PRODUCT = """<html><head><title>Shop</title><link rel="alternate canonical" href="https://s.example/p/17"></head><body>
<div itemscope itemtype="http://schema.org/Product"><a itemprop="brand" itemscope><span itemprop="name">Maison &amp; Fils</span></a>
<h1 itemprop="name">Cuvée <b>2019</b><script>x()</script></h1><div itemprop="aggregateRating"><span itemprop="ratingValue">4,7 of 5</span></div>
<ul><li itemprop="review" id="review_91"><a itemprop="url" href="https://s.example/r/1"><span itemprop="name">Good</span></a><span itemprop="ratingValue">5</span>
<li itemprop="review"><a itemprop="url" href="saved/file.html">x</a><a itemprop=url href="https://s.example/reviews/n400_22.html">y</a></ul></div></body>"""

REVIEW = """<link rel=canonical href=https://s.example/reviews/n55><div itemscope itemtype="https://schema.org/Review/"><h1 itemprop=name>A 2016 red</h1>
<div itemprop="reviewBody">Bought in 2018, no. 120019. <div itemscope><p>Of another in 1999</p></div><p>Fine<br>wine<script>2001</script></p>
<a href="https://c.example/small/a_1-100x80.JPG"><img src="file:///a.jpg" data-original="https://c.example/big/a_1.jpg"></a><img src="https://c.example/b.png"><img src="https://c.example/b.png"></div>
<blockquote><img src="https://c.example/quoted.png"></blockquote></div><img src="https://c.example/outside.png">"""


def test_product_page():
    got = P.product(PRODUCT)
    assert (got["title"], got["brand"], got["rating"], got["url"]) == ("Cuvée 2019", "Maison & Fils", 4.7, "https://s.example/p/17")
    assert got["teasers"] == [{"id": "91", "url": "https://s.example/r/1", "title": "Good", "rating": 5.0}, {"id": None, "url": None, "title": None, "rating": None}]


def test_review_page():
    got = P.review(REVIEW, ["/big/"])
    assert (got["review_id"], got["title"], got["body"], got["years"]) == ("55", "A 2016 red", "Bought in 2018, no. 120019. Fine wine", ["2016", "2018"])
    assert [(i["key"], i["preferred"], len(i["variants"])) for i in got["images"]] == [("a_1.jpg", "https://c.example/big/a_1.jpg", 2), ("b.png", "https://c.example/b.png", 1)]


def test_pages_of_no_kind_and_broken_ones(spark):
    rows = [(1, PRODUCT), (2, None), (3, ""), (4, "<div><p>no such thing"), (5, REVIEW), (6, PRODUCT[:400]), (7, "<div itemscope itemtype=Product>" * 3000 + "</p>")]
    df = spark.createDataFrame(rows, "id long, html string")
    got = {r["id"]: r for r in P.parse_pages(df, "id", "html", "product").collect()}
    assert len(got) == 7 and got[1]["rating"] == 4.7 and len(got[1]["teasers"]) == 2
    assert all(got[i]["title"] is None and got[i]["teasers"] == [] for i in (2, 3, 4, 5)) and got[6]["brand"] == "Maison & Fils"
    got = {r["id"]: r for r in P.parse_pages(df, "id", "html", "review").collect()}
    assert got[5]["review_id"] == "55" and len(got[5]["images"]) == 2 and got[1]["body"] is None and got[2]["images"] == []
    assert P.parse_pages(df.limit(0), "id", "html", "review").count() == 0


def test_flat_payloads(spark):
    rows = ['{"slug":"a","title":"A","publicRating":"4.5","image":{"url":"//x/y.png"}}', '{"slug":" ","title":"A"}', '{"title":"A"}', "nonsense", None, '{"slug":"b","title":"B","image":null,"region":"R"}', "[1]"]
    good, bad = R.flatten_list_item(spark.createDataFrame([(r,) for r in rows], "p string"), "p", "https://m.example")
    assert [(r["slug"], r["public_rating"], r["image_url"], r["region_name"]) for r in good.orderBy("slug").collect()] == [("a", 4.5, "https://m.example/x/y.png", None), ("b", None, None, "R")]
    assert bad.count() == 5


def test_normalized_equals_the_standard_library(spark):
    texts = ["<p>Шато &amp; Ко.</p> Straße", "ﬁne №5 ½ Ёлка", "A_b&nbsp;Ćé", "", None, "ＦＵＬＬ １２"]
    got = [r["n"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalized("t").alias("n")).orderBy("i").collect()]
    for t, g in zip(texts, got):
        x = unicodedata.normalize("NFKC", H.unescape(re.sub("<[^>]+>", " ", t or ""))).casefold().replace("ё", "е")
        assert g == " ".join(re.findall(r"[^\W_]+", "".join(T.LATIN.get(c, c) for c in x)))
    assert got[0] == "shato ko strasse" and got[3] == got[4] == ""
    years = spark.createDataFrame([("in 2019, 2001 and 2019; 120019 x1999y 19991",), (None,), ("none",)], "t string").select(T.year_set("t").alias("y")).collect()
    assert [r["y"] for r in years] == [["1999", "2001", "2019"], [], []]
