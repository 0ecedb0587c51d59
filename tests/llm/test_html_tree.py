import math
import os
import random
from collections import Counter
from html.parser import HTMLParser

import pytest

from meterql.llm import html_tree as tree

PAGES = "page_id long, url string, html string"


def test_article_without_what_surrounds_it():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{a:"</p>"}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a>b">one</a><li>two</ul></nav><!-- <p>no</p> --><div class="ad-box">buy</div><div id="cookieNotice">ok?</div>
    <article><header><h1>A&nbsp;title</h1></header><p>First <b>bold</b>&#33;<br>line<p>second   &lt;b&gt;
    end<script>var t="</p>";</script></p><aside>side</aside><form><input value="x"><button>go</button></form>
    <ul><li>i<li>j</ul><table><tr><td>1<td>2</tr></table><section class="comments"><p>nice!</p></section></article>
    <div class="sidebar"><p>more</p></div><footer>&copy; x</footer></body>"""
    assert tree.main_text(page) == "A title\nFirst bold! line\nsecond <b> end\ni\nj\n1 2"


def test_odd_markup():
    assert tree.main_text(None) == tree.main_text("") == tree.main_text("<p></p><br>") == ""
    assert tree.main_text("plain & simple") == "plain & simple"
    assert tree.main_text("<article>cut <b>off") == "cut off"
    assert tree.main_text("<p>a</div></p></span>b<!-- open") == "a\nb"
    assert tree.main_text("<p>x<script>never closed <p>") == "x"
    assert tree.main_text("<div>1 < 2 and 3 > 2</div>") == "1 < 2 and 3 > 2"
    assert tree.main_text("<p>" + "long " * 100_000 + "</p>") == ("long " * 100_000).strip()
    assert tree.main_text("<div>" * 3000 + "deep") == "deep"
    assert tree.main_text("<p>a</p><svg/><p>b</p>") == tree.main_text('<p>a</p><iframe src="x" /><p>b</p>') == "a\nb"
    assert tree.main_text("<p>a</p><svg><text>c</text></svg><p>b</p><iframe src=x>") == "a\nb"
    assert tree.main_text("<div><p>a</p><noscript>on</noscript><template><p>t</p></template><p>b</p></div>") == "a\nb"


def made(n):
    rows = []
    for i in range(n):
        body = f"<div class='x'>Subscribe to our letter today</div><div class='c{i}'><p>story {i} goes on</p><p>and ends {i * i}</p></div><div class='z'>All rights</div>"
        rows.append((i, f"https://Site.example.com:80/p/{i}?q=1", f"<html><body>{body}</body></html>"))
    return rows


def test_what_all_pages_of_a_host_show_goes(spark):
    rows = made(20) + [(100, "http://alone.example.org/", made(1)[0][2]), (101, None, "<p>t</p>"), (102, "odd", None)]
    frame = spark.createDataFrame(rows, PAGES)
    for most in (tree.BROADCAST_PATHS, 0):
        got = {r.page_id: r for r in tree.extract(frame, broadcast_paths=most).collect()}
        assert all(got[i].text == f"story {i} goes on\nand ends {i * i}" for i in range(20))
        assert got[100].text == "Subscribe to our letter today\nstory 0 goes on\nand ends 0\nAll rights"
        assert (got[101].text, got[102].text, got[102].n_chars) == ("t", "", 0) and got[101].url is None
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_of_one_page_are_no_furniture(spark):
    rows = [(i, "http://h.example.com/", "<body><div>the same page everywhere</div></body>") for i in range(30)]
    got = tree.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.text for r in got} == {"the same page everywhere"} and len(got) == 30


def site(i, rng):
    """A page whose menu, advert and footer say something else each time, without a word that names them."""
    words = lambda n: " ".join(rng.choice(["sun", "rain", "tide", "wind", "fog", "ice"]) + str(rng.randrange(99)) for _ in range(n))
    paragraphs = [words(rng.randrange(4, 30)) for _ in range(rng.randrange(1, 9))]
    article = "".join(f"<p>{p}</p>" + ("<ul><li>x</ul>" if j % 3 == rng.randrange(3) else "") for j, p in enumerate(paragraphs))
    html = (f"<body><div class=one><ul>{''.join(f'<li>{words(1)}' for _ in range(6))}</ul></div><div class=two>{words(8)}</div><article><h1>{words(4)}</h1>{article}"
            f"<div class=plug><b>Get our letter</b> every day</div></article><div class=three>{words(5)}</div></body>")
    return html, paragraphs


def test_the_tree_alone_decides_where_no_list_does(spark):
    rng = random.Random(4)
    made_pages = [site(i, rng) for i in range(60)]
    frame = spark.createDataFrame([(i, "http://h.example.com/", h) for i, (h, _) in enumerate(made_pages)], PAGES)
    got = {r.page_id: r for r in tree.extract(frame, lists=False).collect()}
    for i, (_, paragraphs) in enumerate(made_pages):
        lines = got[i].text.split("\n")
        assert [x for x in lines if x != "x"][1:] == paragraphs and got[i].n_removed >= 3
    # With the lists the article is found by its mark; what all articles repeat still goes by entropy.
    with_lists = tree.extract(frame).collect()
    assert all("letter" not in r.text and r.n_removed >= 1 for r in with_lists)
    assert all("letter" in tree.main_text(h) for h, _ in made_pages)


def test_evidence_outweighs_the_prior_page_by_page():
    steps = [tree.importance((n, 0.0, 0.0), False, 1.0) for n in (2, 4, 8, 100)]
    assert tree.importance(None, False, 1.0) == 1.0 and steps == sorted(steps, reverse=True) and steps[0] > tree.IMPORTANCE > steps[2]
    assert tree.importance((50, 0.1, 0.9), True, 1.0) < tree.IMPORTANCE < tree.importance((50, 0.1, 0.9), False, 1.0)


def test_copies_of_an_article_count_once_whatever_surrounds_them(spark):
    rows = [(i, "http://h.example.com/", f"<body><nav>{i}</nav><article><h1>T</h1><p>one text</p></article></body>") for i in range(40)]
    assert {r.text for r in tree.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"T\none text"}


def test_importance_is_the_entropy(spark):
    rows = [(i, "http://h.example.com/", f"<body><p>{'same' if i < 6 else i}</p>{'<i>x</i>' * (1 + (i == 0))}<b>{i}</b></body>") for i in range(8)]
    found = sorted((round(r.shape, 9), round(r.content, 9)) for r in tree.style_tree(spark.createDataFrame(rows, PAGES)).collect())
    h = lambda *n: round(-sum(x / 8 * math.log(x / 8) for x in n) / math.log(8), 9)
    # p; i (two on one page, which is their parent's shape); b; body
    assert found == sorted([(0.0, h(6, 1, 1)), (0.0, h(7, 1)), (0.0, 1.0), (h(7, 1), 1.0)])


def test_clashing_names_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "u", "<p>x</p>", "y", "z")], PAGES + ", text string, host string")
    assert [tuple(r) for r in tree.extract(frame).collect()] == [(1, "u", "x", 1, 0, 0)]
    assert tree.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_ids_beside_nulls_stay_exact(spark):
    big = (1 << 53) + 1
    frame = spark.createDataFrame([(big, "u", "<p>x</p>"), (None, "u", "<p>y</p>")], PAGES)
    assert sorted((r.page_id or 0, r.text) for r in tree.extract(frame).collect()) == [(0, "y"), (big, "x")]


class Article(HTMLParser):
    """What stands inside article, cut at every block's beginning and end."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts.append(" " if tag == "br" else "\n" if tag in ("p", "h1", "article", "li", "ul", "div") else "")

    def handle_endtag(self, tag):
        self.parts.append("\n" if tag in ("p", "h1", "article", "li", "ul", "div") else "")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(" ".join(data.split(" ")).replace("\n", " "))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_marked_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    marked = {}
    for r in pages.collect():
        reader = Article()
        reader.feed(r.html)
        marked[r.page_id] = "\n".join(" ".join(x.split()) for x in "".join(reader.parts).split("\n") if x.strip())
    got = {r.page_id: r.text for r in tree.extract(pages).collect()}
    assert sum(got[k] == v for k, v in marked.items()) >= 0.95 * len(marked)
    # Without any list: on the hosts of eight pages or more the entropies find the article.
    alone = tree.extract(pages, lists=False).withColumn("host", tree._host("url")).collect()
    sizes = Counter(r.host for r in alone)
    large = [r for r in alone if sizes[r.host] >= 8]
    assert len(large) > 50 and sum(r.text == marked[r.page_id] for r in large) >= 0.95 * len(large) and all(r.n_removed > 0 for r in large)
