import os
import random
import re

from quillon.llm import html
from quillon.llm.registry import op4_html

SCHEMA = "page_id long, url string, html string, text string"


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(pages)], SCHEMA).repartition(2)
    return {r.page_id: r.text for r in html.extract(df).collect()}


def test_structure():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>x="</p><p>no"</script></head><body class="header">
    <nav><ul><li>Home</li></ul></nav><div id="cookie-notice">We use cookies <p>really</p></div><!-- <p>no</p> -->
    <main><article><header><h1>A &amp; B</h1></header><p>One <b>bold<br>two&nbsp;three<p title="a>b">Four&#33; five</b></p><ul><li>six<li>seven</ul>
    <div class="ad-box ad">buy</div><table><tr><td>8</td><td>9</td></tr></table><section class="comments"><p>first!</p></section></article></main>
    <aside>side</aside><form><label>Mail</label></form><footer>&copy; x</footer></body></html>"""
    assert [t for t, z in html.blocks(page) if z == html.ARTICLE] == ["A & B", "One bold two three", "Four! five", "six", "seven", "8", "9"]


def test_broken_pages():
    assert html.blocks("") == [] and html.blocks("a < b & c") == [("a < b & c", html.FREE)]
    assert [t for t, _ in html.blocks("<article><p>one<p>two &am")] == ["one", "two &am"]
    assert [t for t, _ in html.blocks("<p>x<script>never closed <p>y")] == ["x"]
    assert [t for t, _ in html.blocks('<p>x</p><a href="unclosed>y</a> z')] in (["x"], ["x", "z"], ["x", "y z"])


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        at = html.aligned(a, b)
        assert at == sorted(set(at)) and len(at) == lcs(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in at)


def test_differencing(spark):
    """Pages without marks lose what the nearest URL of their host shares, on either side of partition edges."""
    def page(k):
        return "".join(f"<div>{x}</div>" for x in ["Welcome to the site", "Top stories", f"Own text {k} first.", f"Own text {k} second.", "All rights reserved"])

    pages = [(f"http://h{k % 3}.example.com/s/{k:03}", page(k)) for k in range(60)]
    pages += [("http://alone.example.com/", page(99)), (None, None), ("", ""), ("http://h0.example.com/s/000", page(0))]
    got = texts(spark, pages)
    for k in range(1, 60):
        assert got[k] == f"Own text {k} first.\n\nOwn text {k} second.", got[k]
    assert got[60].startswith("Welcome") and got[61] == got[62] == ""
    assert got[0] == got[63]


def test_articles_lose_shared_ends(spark):
    """In an article, what its neighbour shares goes at head and tail; quotes in between and copies stay."""
    def page(*lines):
        return f"<article>{''.join(f'<p>{x}</p>' for x in lines)}</article>"

    quote = "A sentence that both of them quote."
    pages = [
        ("http://a.example.com/x/1", page("Share this story", "One begins.", quote, "One ends.", "Read more stories")),
        ("http://a.example.com/x/2.html?ref=3", page("Share this story", "Two begins.", quote, "Two ends.", "Read more stories")),
        ("http://a.example.com/x/2/#top", page("Share this story", "Two begins.", quote, "Two ends.", "Read more stories")),
        ("http://b.example.com/y/1", page("A copy", quote)),
        ("http://b.example.com/y/2", page("A copy", quote)),
    ]
    got = texts(spark, pages)
    assert got[0] == f"One begins.\n\n{quote}\n\nOne ends." and got[1] == got[2] == f"Two begins.\n\n{quote}\n\nTwo ends."
    assert got[3] == got[4] == f"A copy\n\n{quote}"


def plain(pages):
    """{page_id: text}: each page against the nearest other path of its host, aligned by dynamic programming."""
    def place(url):
        found = re.match(r"(?:([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*))?([^?#]*)", url or "")
        return (found[2] or "").lower(), re.sub(r"(\.html?)?/*$", "", found[3])

    cut = {i: html.blocks(h or "") for i, _, h in pages}
    groups = {}
    for i, u, h in pages:
        groups.setdefault(place(u), []).append(i)
    out = {}
    for i, u, _ in pages:
        host, path = place(u)
        paths = sorted(p for h, p in groups if h == host)
        at = paths.index(path)
        near = sorted(paths[max(0, at - 1) : at] + paths[at + 1 : at + 2], key=lambda p: -len(os.path.commonprefix([p, path])))
        own, lost = cut[i], set()
        if near:
            assert len({tuple(cut[j]) for j in groups[host, near[0]]}) == 1
            a, b = [t for t, _ in own], [t for t, _ in cut[groups[host, near[0]][0]]]
            while len(a) and len(b):  # backwards through the table, as far as lines are on some longest subsequence
                if a[-1] == b[-1]:
                    lost.add(len(a) - 1)
                    a, b = a[:-1], b[:-1]
                elif lcs(a[:-1], b) >= lcs(a, b[:-1]):
                    a = a[:-1]
                else:
                    b = b[:-1]
        zone = html.ARTICLE if any(z == html.ARTICLE for _, z in own) else html.FREE
        mine = [k for k, (_, z) in enumerate(own) if z == zone and k not in lost]
        kept = [t for k, (t, z) in enumerate(own) if z == zone and (not mine or k in mine or zone == html.ARTICLE and mine[0] < k < mine[-1])]
        out[i] = "\n\n".join(kept)
    return out


def test_against_a_plain_version(spark):
    rng = random.Random(7)
    frame, pages = [f"frame {k}" for k in range(6)], []
    for k in range(120):
        own = [f"line {k} {j}" for j in range(rng.randrange(5))]
        lines = frame[: rng.randrange(4)] + own + frame[rng.randrange(3, 6) :]
        body = "".join(f"<p>{x}</p>" for x in lines)
        pages.append((f"http://h{rng.randrange(4)}.example.com/{'ab'[k % 2]}/{k}{rng.choice(['', '/', '.html', '?q=1'])}", f"<article>{body}</article>" if rng.random() < 0.5 else body))
    rows = [(i, u, h) for i, (u, h) in enumerate([*pages, (None, "<p>no url</p>"), ("no-scheme/x", None), pages[0]])]
    assert texts(spark, [(u, h) for _, u, h in rows]) == plain(rows)


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = op4_html(spark, sf_dir).collect()
    assert len(rows) == pages.count()
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        assert r.n_chars == len(r.text) and "©" not in r.text and not re.search(r"\s\s(?<!\n\n)", r.text)
        assert r.text.count("\n\n") + 1 >= raw[r.page_id].count("<h1>")


def test_empty(spark):
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0
