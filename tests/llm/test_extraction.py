"""Main text of pages: every page of the sample against a plain version for its markup, and other layouts."""

import html
import re
import time

import pytest

from factorlab.llm import extraction

P = [
    "The council met on Tuesday to discuss the new bridge, and after three hours of debate it agreed to fund the work.",
    "Engineers said the old bridge had carried traffic for ninety years; its piers were cracked, its deck was thin.",
    "Work is to begin in spring and will last two years, during which a ferry will cross the river every ten minutes.",
]
TEXT = " ".join(P)
BODY = "".join(f"<p>{p}</p>" for p in P)
REPLIES = "".join(f'<article class="comment"><p>Well said, but who will pay for all of this in the end? {i} My taxes have gone up for years.</p></article>' for i in range(8))


def links(n, text="Link"):
    return "<ul>" + "".join(f'<li><a href="/{i}">{text} {i}</a></li>' for i in range(n)) + "</ul>"


PAGES = {
    "plain blocks": (f'<div id="wrap"><div class="x1">{links(8)}</div><div class="x2"><h2>The bridge</h2><div>{BODY}</div></div><div class="x3">{links(12)}</div><div class="x4">&copy; 2024 The Paper</div></div>', "The bridge " + TEXT),
    "reader comments": (f'<nav>{links(5)}</nav><article><h1>The bridge</h1>{BODY}</article><section id="comments"><h3>8 comments</h3>{REPLIES}</section><footer>foot</footer>', "The bridge " + TEXT),
    "comments inside": (f'<article><h1>The bridge</h1>{BODY}<div class="comments-area">{REPLIES}</div></article>', "The bridge " + TEXT),
    "notices and forms": (f'<div id="cookie-banner"><p>We use cookies to make this site better for you and for all of our readers everywhere.</p><button>OK</button></div><main><h1>The bridge</h1>{BODY}<aside><p>About the author</p></aside><form><label>Mail</label><input name=a></form></main>', "The bridge " + TEXT),
    "sections": (f'<header><h1>Site</h1><p>Its motto</p></header><div class="content has-sidebar"><h1>The bridge</h1><div><h2>One</h2><p>{P[0]}</p><p>{P[1]}</p><p>Short.</p></div><div><h2>Two</h2><p>{P[2]}</p><ul><li>first point</li><li>second point</li></ul></div></div><div class="sidebar"><p>Rain all day</p></div>', f"The bridge One {P[0]} {P[1]} Short. Two {P[2]} first point second point"),
    "references": ("<article><h1>A &amp; B</h1><p>caf&eacute;&nbsp;&#8212; &#x201c;ok&#x201d; a&lt;b &amp</p><p>x<b>y</b>z<br>new  \n line</p></article>", "A & B café — “ok” a<b & xyz new line"),
    "adverts inside": (f'<article><p>{P[0]}</p><div class="ad-slot">Buy now!</div><p>{P[1]}</p><div class="newsletter">Our mail</div><p>ok.</p></article><div class="related"><h3>More</h3>{links(4, "A long title of another story")}</div>', f"{P[0]} {P[1]} ok."),
    "hidden markup": (f'<!-- <p>no</p> --><article><p>{P[0]}<!-- a --></p><script>if (a<b) document.write("<p>x</p>")</script><style>p{{}}</style><p>{P[1]}</article><!-- never closed <p>z</p>', f"{P[0]} {P[1]}"),
    "table": (f"<table><tr><td>{links(9)}</td><td><h1>The bridge</h1>{BODY}</td></tr></table>", "The bridge " + TEXT),
    "open quote": (f'<article><p title="broken>{P[0]}</p><p>{P[1]}</p></article>', f"{P[0]} {P[1]}"),
    "crossed and unclosed": (f"<article><p><b>{P[0]}<br><p>{P[1]}</p><i><div>{P[2]}</i></div></article>", TEXT),
    "ends in a tag": (f"<article><p>{P[0]}</p><p>{P[1]}</p><p cla", f"{P[0]} {P[1]}"),
    "names in one word": (f'<div class="topnav">{links(3)}</div><div id="secondary"><p>{P[2]}</p></div><div class="text">{"".join(f"<p>{p}</p>" for p in P[:2])}</div><div id="sitefooter"><p>{P[2]}</p></div>', f"{P[0]} {P[1]}"),
    "article header": (f'<header><p>Site</p></header><article><header><h1>The bridge</h1></header>{BODY}<footer>Filed under news</footer></article>', "The bridge " + TEXT),
    "no markup": ("just text &amp; more", "just text & more"),
    "only menus": (f"<nav>{links(3)}</nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, want = PAGES[name]
    assert extraction.main_text(f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>" if name not in ("ends in a tag", "no markup", "hidden markup") else page) == want


def test_density():
    assert extraction.density(0, 0, 3, 0, 10, 0) == 0
    assert extraction.density(300, 0, 3, 0, 900, 90) > extraction.density(300, 200, 3, 2, 900, 90) > 0


@pytest.mark.parametrize("part", ["<", "<a ", '<a x="', "<div>", "<b>", "<b><p>x", "<ul><li>x", "</ul>", "&", "<tr><td>"])
def test_long_broken_pages_take_linear_time(part):
    began = time.time()
    assert extraction.main_text("<body><p>hello world</p>" + part * 50_000).startswith("hello world")
    assert time.time() - began < 10


def test_whole_sample(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extraction.extracted(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1])
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_edges(spark):
    schema = "page_id long, url string, html string, t string, text int"
    rows = [(1, "u", None, "x", 0), (2, None, "", "x", 0), (None, "u", "<p>a</p>", "x", 0), (3, "u", PAGES["table"][0], "x", 0), (3, "u", PAGES["table"][0], "x", 0), (4, "u", "<p>" + "word " * 200_000, "x", 0)]
    got = sorted(map(tuple, extraction.extracted(spark.createDataFrame(rows, schema)).collect()), key=str)
    long = "word " * 199_999 + "word"
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "u", "a", 1), (3, "u", PAGES["table"][1], len(PAGES["table"][1])), (3, "u", PAGES["table"][1], len(PAGES["table"][1])), (4, "u", long, len(long))]
    assert got == sorted(want, key=str)
    assert extraction.extracted(spark.createDataFrame([], schema)).collect() == []
