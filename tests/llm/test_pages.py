"""Page differencing: lines of broken HTML, alignment, pairing and deletion against brute force."""

import random
import re
import time

import pyarrow.parquet as pq
import pytest

from quern.llm import pages

SHELL = "<html><head><title>t</title></head><body><div>Site name</div><div>Home and more</div>{}<div>All rights reserved</div></body></html>"


def texts(page):
    return [t for t, k in pages.lines(page) if k]


def test_lines_of_broken_html():
    assert texts('<p class=intro" id="one">hello</p>') == ["hello"] and texts('<img alt="it"s" src=x/>text') == ["text"]
    assert texts("a<!-- x > -->b<!-->c<!-- never ends") == ["abc"] and texts("a</>b<//x>c<!d>e<?f>g") == ["abceg"]
    assert texts('<p title="a>b">q</p><p title=\'">\'>r') == ["q", "r"] and texts("x < y &amp; z &lt;p&gt; <3") == ["x < y & z <p> <3"]
    assert texts("<script>if (a<b) {}</script><style>p{}</style><title>t</title>k<script>never closed") == ["k"]
    assert texts("<textarea><p>no</textarea><svg><text>no</text></svg><p hidden>no</p><p style='display: none'>no</p>yes") == ["yes"]
    assert texts("<p>one<p>two<br>three <b>x</b>y<aside>no<p>no</aside><nav>no</nav>&eacute;") == ["one", "two three xy", "é"]
    assert texts("<div class='ad'>no</div><div id=sidebar-2>no</div><p class='share-buttons'>no</p><ul class='comment-list'><li>no</ul>") == []
    assert texts("<div class='main share-price'>5</div><div class='search results'>a</div><div class='related work'>b</div><div class='header'>no</div>") == ["5", "a", "b"]
    assert pages.lines(None) == [] == pages.lines("")


@pytest.mark.parametrize("page", ["<a " + "x" * 100_000 + '" href="u">z</a>', "<div>" * 50_000 + "</b>" * 50_000, "<b class=ad>" * 30_000 + "<div>" + "<i class=ad>" * 30_000 + "</b>" * 30_000, "<" * 100_000, '<a b="' * 20_000, "<p>0" * 50_000, "<!--" * 50_000])
def test_time_is_linear(page):
    began = time.perf_counter()
    pages.lines(page)
    assert time.perf_counter() - began < 20


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("cells", [200_000_000, 6])
def test_alignment(cells, monkeypatch):
    monkeypatch.setattr(pages, "CELLS", cells)
    rnd = random.Random(6)
    for _ in range(1000):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randrange(14))] for _ in range(2))
        got = pages.shared(a, b)
        assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_long_pages_align_in_time():
    rnd = random.Random(7)
    a, b = ([rnd.randrange(3) for _ in range(20_000)] for _ in range(2))
    began = time.perf_counter()
    assert len(pages.shared(a, b)) > 10_000 and time.perf_counter() - began < 20


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS row", "2 AS host", "3 AS whole", "4 AS gone").repartition(5)


def test_pages(spark):
    rows = [(i, f"http://h.example/a/{i}", SHELL.format(f"<p>Story {i} begins</p><p>and goes &amp; on {'word ' * 20}{i}</p>")) for i in range(200)]
    marked = "<body><nav><a>m</a></nav><div class='ad'>buy</div><article><h1>T  t</h1><p>One<br>two <b>x</b>y<script>if (a<b) {}</script><p>Same line<aside>no</aside></article><footer>f</footer>"
    rows += [(500, "http://k.example/1", marked), (501, "http://k.example/2", marked.replace("two", "three")), (502, None, "<p>no url"), (503, "x", ""), (504, "http://k.example/3", None), (504, "http://k.example/3", None)]
    rows += [(600 + i, f"http://c.example/{i}?u={i}", "<p>one article<p>under two addresses") for i in range(2)]
    df = frame(spark, rows)
    found = pages.extract(df).collect()
    got = {r["page_id"]: r for r in found}
    assert len(found) == len(rows)
    for i in range(200):
        assert got[i]["text"] == f"Story {i} begins\nand goes & on {'word ' * 20}{i}" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[500]["text"] == "T t\nOne two xy\nSame line" and got[501]["text"] == "T t\nOne three xy\nSame line"
    assert got[502]["text"] == "no url" and got[503]["text"] == got[504]["text"] == ""
    assert got[600]["text"] == got[601]["text"] == "one article\nunder two addresses"
    assert pages.extract(df.limit(0)).count() == 0


def test_short_stories_in_a_large_frame(spark):
    """What is shared goes whatever its share of the page; a page that is nothing but frame is empty."""
    large = "<div>" + "</div><div>".join(f"Part {k} of the frame of this site" for k in range(20)) + "</div>"
    rows = [(i, f"http://h.example/a/{i}", f"<body>{large}<p>Story {i}</p>{large}") for i in range(9)] + [(9, "http://h.example/a/45", f"<body>{large}{large}")]
    got = {r["page_id"]: r for r in pages.extract(frame(spark, rows)).collect()}
    assert all(got[i]["text"] == f"Story {i}" and got[i]["n_shared"] == 40 for i in range(9)) and got[9]["text"] == ""


def test_neutral_names(spark):
    """The pages of the table with a frame for each host, all names of elements and classes made neutral: differencing alone gives the article."""
    table = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    rows, want = [], {}
    for r in table:
        host = re.match(r"\w+://([^/?#]+)", r["url"])[1]
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        body = re.sub(r"</?(?!/?(?:b|br)\b)[a-z0-9]+[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", article)
        shell = "".join(f"<div>{host} {k}</div>" for k in range(6))
        rows.append((r["page_id"], r["url"], f"<body>{shell}{body}<div>© {host}</div>"))
        want[r["page_id"]] = [t for t, _ in pages.lines(article)]
    hosts = {i: re.match(r"\w+://([^/?#]+)", u)[1] for i, u, _ in rows}
    got = {r["page_id"]: r["text"].split("\n") for r in pages.extract(frame(spark, rows)).collect()}
    several = [i for i in want if list(hosts.values()).count(hosts[i]) > 1]
    assert len(several) > 10
    kept = sum(x in got[i] for i in several for x in want[i]) / sum(len(want[i]) for i in several)
    frames = sum(x.startswith(hosts[i]) or x.startswith("©") for i in several for x in got[i])
    assert kept > 0.9 and frames == 0


def brute(rows):
    """{page_id: places that go}, from pages given as (page_id, host, path, lines)."""
    out = {}
    for host in {r[1] for r in rows}:
        distinct = {}
        for i, _, path, found in sorted((r for r in rows if r[1] == host), key=lambda r: (r[2].encode(), r[0])):
            distinct.setdefault(tuple(found), []).append((path, i))
        ordered = sorted(distinct, key=lambda f: (distinct[f][0][0].encode(), distinct[f][0][1]))
        for k, own in enumerate(ordered):
            sides = []
            for other in [*ordered[max(0, k - 1) : k], *ordered[k + 1 : k + 2]]:
                pairs = pages.shared([t for t, _ in own], [t for t, _ in other])
                a, b = {x for x, _ in pairs}, {y for _, y in pairs}
                n = 0
                for x, y in zip(distinct[own][0][0].split("/"), distinct[other][0][0].split("/")):
                    if x != y:
                        break
                    n += 1
                sides.append((n, a, any(p and i not in a for i, (_, p) in enumerate(own)), any(p and i not in b for i, (_, p) in enumerate(other))))
            gone = set()
            for n, a, mine, theirs in sides:
                if n == max(s[0] for s in sides) and mine and theirs:
                    gone |= a
            if len(sides) == 2 and sides[0][3] and sides[1][3]:
                gone |= sides[0][1] & sides[1][1]
            for _, i in distinct[own]:
                out[i] = gone
    return out


def test_pairing_against_brute_force(spark):
    rnd = random.Random(8)
    words = [f"line {k}" for k in range(12)]
    rows = []
    for i in range(300):
        body = "".join(f"<p>{rnd.choice(words)}</p>" if rnd.random() < 0.7 else f"<nav>{rnd.choice(words)}</nav>" for _ in range(rnd.randrange(7)))
        rows.append((i, f"http://{rnd.choice('ab')}.example/{rnd.choice('xy')}/{rnd.randrange(90)}", body))
    parsed = [(i, u[7], re.sub(r"^\w+://[^/]+", "", u), pages.lines(h)) for i, u, h in rows]
    want = brute(parsed)
    found = {i: f for i, _, _, f in parsed}
    got = {r["page_id"]: r for r in pages.extract(frame(spark, rows)).collect()}
    assert all(got[i]["text"] == pages.text_of(found[i], want[i]) and got[i]["n_shared"] == len(want[i]) for i in want)
    assert sum(map(bool, want.values())) > 100


def test_lines_are_deleted_on_the_table(spark):
    assert pages.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).where("n_shared > 0").count() > 20
