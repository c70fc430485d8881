"""Main texts: the parser on odd pages, the tree's entropies by brute force, and what the tree alone can tell."""

import math
from collections import Counter

import pytest

from quarry.llm import html

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, **options):
    got = html.extract(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert len(got) == len(rows) and all(g.n_chars == len(g.text) for g in got)
    return {g.page_id: g.text for g in got}


def test_extract(spark):
    page = lambda i, body: (i, "http://h.example/x", f"<html><head><title>t</title></head><body><div class='bar'>Same words everywhere</div><article><h1>Head {i}</h1>{body}</article><footer>foot</footer></body></html>")
    rows = [page(i, f"<p>Text&nbsp;{i} &amp; more<b> bold</b></p><script>no()</script>") for i in range(20)]
    rows += [(50, None, None), (51, "no-host", ""), (52, "http://h.example/", "<p>One<p>Two  \n three<div class='comments'>reply</div><nav>menu</nav>"), (53, "http://o.net/", "plain < text"), rows[0]]
    by = texts(spark, rows)
    assert by[3] == "Head 3\nText 3 & more bold" and by[50] == by[51] == "" and by[52] == "One\nTwo three" and by[53] == "plain < text"
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>One</p><svg/><p>Two</p>", "One\nTwo"), ("<p>One</p><iframe src=x /><p>Two</p>", "One\nTwo"), ("<p>One</p><button>B<p>Two</p>", "One\nB\nTwo"), ("<p>One</p><script>x<p>Two</p>", "One\nx\nTwo"),
        ("<p>One <button>B</button>two</p>", "One two"), ("<script>if (a < b) '</p>'</script><p>x", "x"), ("<svg><svg>a</svg>b</svg><p>c", "c"), ("<p>a <math><mi>x</mi></math> b</p>", "a x b"),
        ("<article><div class='post-header'><h1>Title</h1></div><p>x</p></article>", "Title\nx"), ("<article><div class='search-results'><p>x</p></div></article>", "x"),
        ("<div class='content has-sidebar'><p>Long text of it</p><div class='sidebar'>side</div></div>", "Long text of it"), ("<p>Before</p><article><p>In</p></article><p>After</p>", "Before\nIn\nAfter"),
        ("<div class='header'>Site</div><article><p>In</p></article><div class='ad'>buy</div><aside>a</aside>", "In"), ("<article><p>In</p><div class=comments><p>Reply</p></div></article>", "In"),
        ("<head><title>t</title><p>Text", "Text"), ("<ul><li>a<li>b</ul></section>c", "a\nb\nc"), ("<main><p>a</div></section><p>b</main>", "a\nb"), ("<form><p>x</p></form><header>h</header>y", "y"),
        ("<!-- <p>no --> a<br>b &lt;c&gt; &#233;", "a b <c> é"), ("<div class='menu'>only a menu</div>", "only a menu"), ("<script>x</script>", ""), ("<p", ""),
    ],
)
def test_odd_pages(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep", "<div>" * 100_000 + "deep" + "</p>" * 100_000, "deep" + "<svg>" * 100_000, "<main>" + "<b><div>" * 50_000 + "deep" + "</section>" * 50_000])
def test_depth_is_no_bound(page):
    assert html.main_text(page) == "deep"
    assert html.branches(html.parse(page))[1]


def test_only_the_tree_tells_noise_from_content(spark):
    def page(i, m):
        box = f"<div class='k1'><p>We write every day since 1999.</p></div><div class='k2'><p>Of note here: {i * 7919 % 97} and {i}.</p></div>"
        return f"<body><div class='k3'>Call us now</div><article><h1>T{i}</h1>{box}<p>{'word ' * (i % 5)}{i}</p></article><div class='k4'>Item {i}</div></body>"

    rows = [(i, "http://big.example/", page(i, 40)) for i in range(40)] + [(100, "http://one.example/", page(1, 1))]
    by = texts(spark, rows)
    assert by[7] == "T7\nOf note here: 46 and 7.\nword word 7\nItem 7"
    assert by[100].startswith("Call us now\nT1\nWe write every day since 1999.")
    assert texts(spark, rows, low=0.0)[7] == "Call us now\nT7\nWe write every day since 1999.\nOf note here: 46 and 7.\nword word 7\nItem 7"


def test_an_article_on_every_page_of_a_site_stays(spark):
    rows = [(i, "http://a.example/", f"<body><nav>{i}</nav><article><p>The same article, {'again ' * 30}</p></article></body>") for i in range(60)]
    assert set(texts(spark, rows).values()) == {f"The same article, {('again ' * 30).strip()}"}


def test_importances_brute_force(spark):
    rows = [("a" if i % 3 else "b", i, p, (i * p) % q, i % r) for i in range(30) for p, q, r in ((1, 1, 1), (2, 4, 1), (3, 100, 2), (4, 3, 7))] + [("c", 1, 9, 5, 5)]
    got = {(r.h, r.path): r.e for r in html.importances(spark.createDataFrame(rows, "h string, page long, path long, own long, look long"), 3.0).collect()}

    def entropy(values):
        m = len(values)
        return 1.0 if m == 1 else -sum(c / m * math.log(c / m, m) for c in Counter(values).values())

    for h, p in {(r[0], r[2]) for r in rows}:
        mine = [r for r in rows if (r[0], r[2]) == (h, p)]
        e = max(entropy([r[3] for r in mine]), entropy([r[4] for r in mine]))
        assert got.pop((h, p)) == pytest.approx((len(mine) * e + 3) / (len(mine) + 3), abs=1e-9)
    assert not got
