import random
import time
from collections import Counter

import pytest

from tidemark.llm import html_text


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequences():
    draw = random.Random(1)
    for _ in range(500):
        a, b = ([draw.randrange(4) for _ in range(draw.randrange(10))] for _ in range(2))
        x, y = html_text.common(a, b)
        assert [a[i] for i in x] == [b[j] for j in y] and len(x) == longest(a, b)
        assert x == sorted(set(x)) and y == sorted(set(y))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<br>b  c</p>\n<p>d&nbsp;&eacute;&#233;", "a b c d éé"), ("<article><h1>T</h1><p>x<b>y</b>z</article>after", "T xyz"), ("<div id=content><p>in</div><p>out", "in"),
        ("<nav>m</nav><header><h1>s</h1></header><main>t<aside>u</aside><p class='ad-box'>v</p><form>w</form></main><footer>f</footer>", "t"), ("<body class=has-sidebar><p>ok</p><div style='display: none'>no</div><div class=cookie-notice>no", "ok"),
        ("<article>a<script>if (a < b) '</p>'</script><style>p{}</style><!-- c -->b<section id=comments><article>no</article></section><p>c</article>", "ab c"), ("<ul><li>a<li>b</ul><p>c<p>d", "a b c d"), ("<div class='single-post ad-free'><p>Body text</p></div>", "Body text"), ("<div class='post social-science'><p>a</p></div>", "a"), ("<p>long text of the page</p><div class='sponsor-x9'>ad</div>", "long text of the page"),
        ("<div class='page-header'>only this</div>", "only this"), ("<div class=widget><article>teaser</article></div><article>real</article>", "real"), ("<p>cut off <b>here &am", "cut off here &am"), ("<p>x <a href='", "x"),
    ],
)
def test_main_text(html, text):
    assert html_text.Page(html).main_text() == text


@pytest.mark.parametrize("bits", [1, 40, 1 << 23])
def test_long_alignments_in_little_memory(monkeypatch, bits):
    monkeypatch.setattr(html_text, "ROW_BITS", bits)
    draw = random.Random(2)
    for _ in range(100):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(30))] for _ in range(2))
        x, y = html_text.common(a, b)
        assert [a[i] for i in x] == [b[j] for j in y] and len(x) == longest(a, b) and x == sorted(set(x)) and y == sorted(set(y))


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "</span>" * 20_000, "<b>" * 20_000 + "<h1>x</h1>" * 20_000, "<p><b>" * 20_000, "<li>" * 40_000 + "x", "<table>" * 9_000 + "<td>" * 9_000, "<" * 50_000, "<a " * 30_000, "&" * 100_000])
def test_broken_markup_takes_linear_time(html):
    began = time.process_time()
    html_text.Page(html)
    html_text.Page(html)
    assert time.process_time() - began < 5


MARKED = {  # pages of a site, as (path, html), and what a reader marked as the main text of each
    "blog without article": [
        (f"/2024/{k}", f"<body><div id=top><span>My diary</span><span>About me</span></div><div><h2>{t}</h2><div>{x}</div><div>{y}</div></div><div>Posted by Ann</div><div>All rights reserved by Ann</div></body>", f"{t} {x} {y}")
        for k, (t, x, y) in enumerate([("On frogs", "Frogs sat by the pond all morning long and sang.", "At noon the herons came and the singing stopped."), ("On rain", "Rain fell on the roof for three days without end.", "We read old letters and burned the last dry wood."), ("On bread", "The dough rose slowly because the kitchen was cold.", "By evening there were four loaves and a full house."), ("On maps", "Every map leaves out the path you need the most.", "So we walked by the sun and were home by seven.")])
    ],
    "named wrapper": [
        (f"/p/{k}", f"<div class='layout ad-free'><div class=menu>Home News Sport</div><div class='story-wrap'><h1>{t}</h1><p>{x}</p></div><div class='related-links'>You may also like</div></div>", f"{t} {x}")
        for k, (t, x) in enumerate([("Bridge opens", "The new bridge opened on Monday after nine years of work and many delays."), ("Mayor resigns", "The mayor resigned over the budget and left the hall by the back door."), ("Team wins", "The home team won the final with a late goal in front of a full stadium.")])
    ],
    "article with a box": [
        (f"/a/{k}", f"<nav>A B C</nav><article><h1>{t}</h1><p>{x}</p><p>Quote: to be or not to be.</p><div>Join the club today</div><p>{y}</p></article><footer>f {k}</footer>", f"{t} {x} Quote: to be or not to be. {y}")
        for k, (t, x, y) in enumerate([("One", "First words of the first text.", "Its last words."), ("Two", "Second text starts like this.", "And it stops so."), ("Three", "Third one has other words.", "The end of three."), ("Four", "Fourth and last.", "Nothing follows here.")])
    ],
    "forum": [
        (f"/t/{k}", f"<div class=breadcrumb>Forum &gt; Garden</div><main><h1>{t}</h1><div class=post>{x}</div><div id=comments><div>{c}</div><div>{c} too</div></div></main><aside>Users online: {k}</aside>", f"{t} {x}")
        for k, (t, x, c) in enumerate([("Tomatoes rot", "My tomatoes rot at the stem before they are ripe, what can I do?", "Less water"), ("Moss in lawn", "Moss has taken over the north side of the lawn since spring.", "Try lime"), ("Cats dig", "Cats of the neighbours dig up the seeds every night.", "Get a dog")])
    ],
    "tables and lists": [
        (f"/wiki/{k}", f"<div id=siteSub>From the free book</div><div><h1>{t}</h1><p>{x}</p><ul><li>{a}</li><li>{b}</li></ul><table><tr><td>{a}</td><td>{k}00 km</td></tr></table></div><div>Privacy About Contact</div>", f"{t} {x} {a} {b} {a} {k}00 km")
        for k, (t, x, a, b) in enumerate([("Danube", "The Danube flows through ten countries.", "Ulm", "Vienna"), ("Rhine", "The Rhine rises in the Alps and ends in the sea.", "Basel", "Cologne"), ("Elbe", "The Elbe passes Dresden and Hamburg.", "Dresden", "Hamburg")])
    ],
    "dates in the footer": [
        (f"/de/{k}", f"<div class=kopf>Zeitung am Ort</div><h1>{t}</h1><div class=text>{x}</div><footer>Stand {k}.1.2024</footer><div class='cookie-banner'>Wir nutzen Kekse</div>", f"{t} {x}")
        for k, (t, x) in enumerate([("Schule zu", "Die Schule bleibt wegen Schnee bis Freitag geschlossen, teilte die Stadt mit."), ("Bad offen", "Das Freibad hat nach langer Pause wieder jeden Tag bis acht Uhr offen."), ("Markt voll", "Der Markt war am Samstag so voll wie seit Jahren nicht mehr.")])
    ],
}


def test_hand_marked_pages(spark):
    rows, want = [], {}
    for site, pages in MARKED.items():
        for path, html, text in pages:
            want[len(rows)] = (site, text)
            rows.append((len(rows), f"http://{site.replace(' ', '-')}.org{path}", html))
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    hit, got, asked = Counter(), Counter(), Counter()
    for r in found:
        site, text = want[r.page_id]
        a, b = Counter(r.text.split()), Counter(text.split())
        for key in (site, "all"):
            hit[key] += (a & b).total()
            got[key] += a.total()
            asked[key] += b.total()
    scores = {k: (round(hit[k] / got[k], 2), round(hit[k] / asked[k], 2)) for k in asked}
    assert all(min(x) >= 0.9 for x in scores.values()), scores
    assert sum(r.n_deleted for r in found) >= 20  # lines that structure alone would keep


def test_template_lines_go(spark):
    page = "<html><body><div>Site motto</div><div><p>story {0} told</p><p>Common plea</p></div><div>Bottom line</div></body></html>"
    art = "<body><div>Site motto</div><article><p>Shared quote</p><p>only {0}</p></article></body>"
    rows = [(k, f"http://h{k % 2}.org/a/{k:03d}?q={k}", page.format(k)) for k in range(20)] + [(100 + k, f"http://art.org/{k}", art.format(k)) for k in range(6)] + [(200, None, None), (201, "::bad", ""), (202, "http://alone.org/x", page.format("solo")), (None, "http://h0.org/a/1", None), (203, "http://h0.org/a/1", page.format("twin")), (203, "http://h0.org/a/1", page.format("twin"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'y' AS key", "'z' AS host")
    got = {r.page_id: r.text for r in html_text.extract(pages.repartition(5)).collect()}
    assert all(got[k] == f"story {k} told" for k in range(20))
    assert all(got[100 + k] == f"Shared quote only {k}" for k in range(6))
    assert got[200] == got[201] == got[None] == "" and got[202] == "Site motto story solo told Common plea Bottom line"
    assert html_text.extract(pages).count() == len(rows) and html_text.extract(pages.limit(0)).count() == 0


def test_neighbours_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(html_text, "partitions", lambda df, factor=1.0: 7)
    page = "<body><div>Motto</div><p>page {0}</p></body>"
    pages = spark.createDataFrame([(k, f"http://one.org/{k:04d}", page.format(k)) for k in range(50)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(pages).collect()} == {f"page {k}" for k in range(50)}


@pytest.mark.parametrize("parts", [1, 7])
def test_copies_without_article_keep_their_text(spark, monkeypatch, parts):
    monkeypatch.setattr(html_text, "partitions", lambda df, factor=1.0: parts)
    body = "<body><div>Motto</div><p>story {0}</p><p>end of {0}</p></body>"
    copies = [(k, f"http://two.org/{k}", body.format("one")) for k in range(2)] + [(10 + k, f"http://main.org/{k}", f"<main>{body.format('main')}</main>") for k in range(9)]
    runs = [(100 + k, f"http://runs.org/{k:03d}", body.format(k // 8)) for k in range(40)]
    pages = spark.createDataFrame(copies + runs, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert all(got[k] == "Motto story one end of one" for k in range(2))
    assert all(got[10 + k] == "Motto story main end of main" for k in range(9))
    assert all(got[100 + k] == f"story {k // 8} end of {k // 8}" for k in range(40))
