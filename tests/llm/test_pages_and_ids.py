"""Page texts against a plain parser, marks in class names, and ids against the vocabulary's own library."""

import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import html_text, packing

BODY = "".join(f"<p>Paragraph {i}, of some length, with commas, that is long enough to count as text.</p>" for i in range(4))
TEXT = " ".join(f"Paragraph {i}, of some length, with commas, that is long enough to count as text." for i in range(4))


def test_names_that_mark_nothing():
    for name in ("layout has-sidebar", "content no-sidebar", "post social-science", "article related-topic", "search-result-page", "no-ads", "entry-header"):
        assert html_text.main_text(f'<body><div class="{name}">{BODY}</div></body>') == TEXT, name
        assert html_text.main_text(f'<body><div class="{name}"><article>{BODY}</article></div></body>') == TEXT, name
    # a marked element around the article stays, and so does one that holds most of the text
    assert html_text.main_text(f'<body><div class="sidebar"><main>{BODY}</main></div></body>') == TEXT
    assert html_text.main_text(f'<body><div class="related">{BODY}</div></body>') == TEXT


def test_names_that_mark():
    short = "<p>Something else, shorter, that is not the article at all.</p>"
    for name in ("ad", "ads", "ad-box", "ad-300x250", "sidebar", "right-sidebar", "cookie-notice", "related-posts", "newsletter-signup", "page-header",
                 "menu", "breadcrumbs", "social-share-buttons", "sponsored", "comments", "comment-list", "advertBanner"):
        assert html_text.main_text(f'<body><div class="{name}">{short}</div><article>{BODY}</article></body>') == TEXT, name
        assert html_text.main_text(f'<body><article>{BODY}<div class="wide {name}">{short}</div></article></body>') == TEXT, name
    many = f'<div id="comments">{"".join(f"<p>Comment {i}, which is quite long, and longer, than the article.</p>" for i in range(30))}</div>'
    assert html_text.main_text(f"<body><article>{BODY}</article>{many}</body>") == TEXT
    assert html_text.main_text(f"<body><article>{BODY}{many}</article></body>") == TEXT
    assert html_text.main_text(f"<body><header><h1>Site</h1></header><article><header><h1 class='post-header'>Title</h1><p>By me, now.</p></header>{BODY}</article></body>") == "Title " + TEXT


def test_marked_elements_longer_than_the_article():
    notice = "".join(f"<p>Notice {i}, that goes on, and on, and says that there are cookies on this site.</p>" for i in range(40))
    for name in ("cookie-notice", "newsletter", "related-posts", "promo"):
        for inner in ("<article><p>short story</p></article>", "<main><p>short story</p></main>", '<div class="content"><p>short story</p></div>', "<div>short story</div>"):
            assert html_text.main_text(f'<body><div class="{name}">{notice}</div>{inner}</body>') == "short story", (name, inner)
            assert html_text.main_text(f'<body>{inner}<section id="{name}">{notice}</section></body>') == "short story", (name, inner)


def test_short_articles_side_by_side():
    a, b = "<p>The first one, of two sentences. It is short.</p>", "<p>The second one, with more, many more, commas, in it, so that it scores.</p>"
    both = "The first one, of two sentences. It is short. The second one, with more, many more, commas, in it, so that it scores."
    assert html_text.main_text(f"<body><main><article>{a}</article><article>{b}</article></main></body>") == both
    assert html_text.main_text(f"<body><div><article>{a}</article><article>{b}</article></div><footer>end</footer></body>") == both
    assert html_text.main_text("<body><main><article><p>One.</p></article><article><p>Two.</p></article></main></body>") == "One. Two."


def plain_scores(containers):
    """(points * (1 - link share)) of flat containers of paragraphs, by the rule as stated: containers are lists of (text, linked characters)."""
    out = []
    for ps in containers:
        points = sum(1 + t.count(",") + min(len(t) // 100, 3) for t, _ in ps if len(t) >= 25)
        out.append(points * (1 - sum(k for _, k in ps) / max(1, sum(len(t) for t, _ in ps))))
    return out


def test_choice_equals_a_plain_scorer():
    """Pages without any article element: the chosen containers are those that the stated rule scores best."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        containers = []
        for _ in range(int(rng.integers(2, 6))):
            ps = []
            for _ in range(int(rng.integers(1, 6))):
                words = [f"w{x}" + "," * int(rng.random() < 0.1) for x in rng.integers(0, 999, int(rng.integers(2, 60)))]
                linked = int(rng.integers(0, len(words) + 1)) if rng.random() < 0.4 else 0
                ps.append((" ".join(words), len(" ".join(words[:linked])), linked))
            containers.append(ps)
        score = plain_scores([[(t, k) for t, k, _ in ps] for ps in containers])
        mark = lambda t, n: (f"<a href=x>{' '.join(t.split()[:n])}</a> {' '.join(t.split()[n:])}" if 0 < n else t)
        page = "<body><div id=all>" + "".join("<div>" + "".join(f"<p>{mark(t, n)}</p>" for t, _, n in ps) + "</div>" for ps in containers) + "</div></body>"
        order = sorted(score, reverse=True)
        if order[0] <= 0 or len(order) > 1 and order[0] < 1.05 * sum(score) / 2 + 1e-9:
            continue  # the box around them, which gets half of their points, may win
        if any(abs(x - 0.2 * order[0]) < 0.05 * order[0] for x in score):
            continue
        want = " ".join(t for ps, x in zip(containers, score) if x >= 0.2 * order[0] for t, _, _ in ps)
        assert html_text.main_text(page) == want


class Article(HTMLParser):
    """The text of the article element, block elements apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if self.depth and tag not in ("b", "i", "a", "em", "span"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if self.depth and tag not in ("b", "i", "a", "em", "span"):
            self.out.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.out.append(data)


def test_pages_equal_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        p = Article()
        p.feed(r["html"] or "")
        want = " ".join("".join(p.out).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_page_edges(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x"), (1, "u", f"<article>{BODY}</article>", "x"), (None, None, None, None), (2, "u", "<div>" * 3000 + "x" * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in html_text.extract(df).collect()))
    assert got == [(0, 0), (1, len(TEXT)), (1, len(TEXT)), (2, 200_000)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_ids_are_the_library_s(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "plain é 𝒳 text\n\n  x", "", None, "y" * 9000 + "<|endoftext|>" + " z" * 3000, "a <|endoftext|> b"]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, start int, length int")
    got = packing.pack(df).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*(own.encode(t, add_special_tokens=False).ids if t else []), packing.END_ID], "<u4")
        mine = got[got["doc_id"] == i].sort_values("start")
        assert mine["doc_tokens"].iloc[0] == len(ids)
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert packing.pack(df.limit(0)).count() == 0
