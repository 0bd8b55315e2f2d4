"""Main texts of made pages of several sites, whose articles are known, and the entropies of a small tree."""

import math
import random

import pytest

from ledgerloom.llm import dom, sitetree

SCHEMA = "page_id long, url string, html string, host string, low int, text string"


def sentence(rng, n=12):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def paragraphs(rng):
    return [sentence(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 5))]


def named(rng, body):
    """Markup that says what it is."""
    return (f'<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head><body class="no-sidebar">'
            f'<header><a href="/">Site</a></header><nav><ul><li><a href="/a">{sentence(rng, 1)}</a><li><a href="/b">B</a></ul></nav>'
            f'<div class="cookie-notice">We use cookies</div><div class="ad">{sentence(rng)}</div>'
            f'<article><h1>{body[0]}</h1>' + "".join(f"<p>{p}" for p in body[1:]) + f'<form>Name <input><button>Go</button></form>'
            f'<section id="comments"><article class="comment"><p>{sentence(rng)}</p></article></section></article>'
            f'<aside>{sentence(rng)}</aside><footer>&copy; {sentence(rng)}</footer></body></html>')


def bare(rng, body):
    """Markup without names: only the tree of the site tells."""
    return ("<html><body><div><div>My site of things</div><div><a href=/x>One</a> | <a href=/y>Two</a></div></div>"
            f"<div><h2>{body[0]}</h2>" + "".join(f"<p>{p}</p>" for p in body[1:]) + "<div>Share this text with all your friends</div></div>"
            "<div><p>All rights are ours.</p><p>Write to us, if you like.</p></div></body></html>")


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    out, want = [], {}
    for i in range(120):
        body = [sentence(rng, 4), *paragraphs(rng)]
        host, make = (("www.named.example", named), ("bare.example:8080", bare))[i % 2]
        out.append((i, f"https://u@{host}/p/{i}?x#y", make(rng, body)))
        want[i] = "\n\n".join(body)
    for i in range(200, 205):  # every page of the host has the same article
        body = ["Same heading", "Same words on all pages of this host."]
        out.append((i, f"http://same.example/{i}", f"<body><article><h1>{body[0]}</h1><div class=x><p>{body[1]}</div></article><footer>{sentence(rng)}</footer>"))
        want[i] = "\n\n".join(body)
    for i in range(210, 214):  # and has no names at all
        out.append((i, f"http://bare-copies.example/{i}", "<body><div>Only text here.</div>"))
        want[i] = "Only text here."
    odd = [(300, "http://lone.example", named(rng, ["A lone page", "with a text"]), "A lone page\n\nwith a text"), (301, None, "<p>No url", "No url"), (302, "not a url", "x  <b>y</b>z\n", "x yz"),
           (303, "http://e.example", None, ""), (304, "http://e.example", "", ""), (305, "http://e.example", "<html><nav>Menu</nav></html>", ""),
           (306, "http://e.example", "<ul><li><a href=1>A</a><li><a href=2>B</a></ul><p>Text &lt;3 a&nbsp;b &#233;&eacute; &amp c<br>d<table><tr><td>1<td>2</table>", "Text <3 a b éé & c d\n\n1 2"),
           (None, "http://n.example", "<p>null id</p>", "null id"), (307, "http://l.example", "<p>" + "word " * 300_000 + "<p>end", ("word " * 300_000).strip() + "\n\nend"),
           (308, "http://e.example", "<p>unended <!-- comment <p>x", "unended"), (309, "http://e.example", "<p>a < b and c > d <script>x", "a < b and c > d"),
           (310, "http://e.example", "<div>" * 3000 + "deep", "deep"), (311, "http://e.example", "<main><p>in</p></main><p>out</p>", "in"), (312, "http://e.example", '<p hidden>no<p style="display: none">no<p>yes', "yes")]
    for i, url, html, text in odd:
        out.append((i, url, html))
        want[i] = text
    out.append(out[0])
    return out, want


def test_main_texts(spark, pages):
    rows, want = pages
    frame = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(6)
    got = sitetree.extract(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.page_id], r.page_id
        assert r.n_chars == len(r.text)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sitetree.extract(empty).count() == 0 and sitetree.importances(empty).count() == 0


def test_entropies(spark):
    """Four pages: a heading that is the same on all, a text of its own on three of them, lists of two kinds."""
    html = [f"<div id=a>Same</div><div id=b>{t}</div><div id=c>{c}</div>" for t, c in (("x", "<p>1</p>"), ("y", "<p>1</p>"), ("z", "<ul><li>2</ul>"), ("z", "<ul><li>3</ul>"))]
    frame = spark.createDataFrame([(i, "http://h.example/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.node: r for r in sitetree.importances(frame).collect()}

    def node(*way):
        at = sitetree._digest("root")
        for look in way:
            at = sitetree._digest(at, look, 0)
        return got[at]

    a, b, c = (node(f"div.{x}") for x in "abc")
    assert a.pages == b.pages == c.pages == 4 and a.content == 0
    assert b.content == pytest.approx(1 - 2 * math.log(2, 4) / 4)
    assert c.presentation == pytest.approx(0.5) and a.presentation == 0
    p, li = node("div.c", "p."), node("div.c", "ul.", "li.")
    assert p.content == 0 and li.content == 1 and c.content == pytest.approx(0.5)
    assert c.importance == pytest.approx((1 - 0.81) * 0.5 + 0.81 * 0.5) and a.importance == pytest.approx(0)


def test_reader_of_html():
    def shown(e):
        return e if isinstance(e, str) else f"{e.tag}({','.join(shown(k) for k in e.kids)})"

    def tree(html):
        return ",".join(shown(k) for k in dom.parse(html).kids)

    assert tree("<p>a<p>b") == "p(a),p(b)"
    assert tree("<ul><li>a<ul><li>b</ul><li>c</ul>d") == "ul(li(a,ul(li(b))),li(c)),d"
    assert tree("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>d</table>") == "table(tr(td(a),td(b)),tr(td(table(tr(td(c))),d)))"
    assert tree("<b>a</p>b</b>c</div>d") == "b(a,b),c,d"
    assert tree("<script>if (a<b) '</p>'</SCRIPT >x") == "script(if (a<b) '</p>'),x"
    assert tree('<a title="x>y" b=\'"\' c>t</a>') == "a(t)"
    assert dom.parse('<a title="x>y" B=\'"\' c d=e&amp;f>t</a>').kids[0].attributes == {"title": "x>y", "b": '"', "c": "", "d": "e&f"}
    assert tree("<p>a<div>b</p>c</div>") == "p(a),div(b,c)"
