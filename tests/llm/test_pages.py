"""Extraction against a plain reading of the test pages, repetition against all substrings, odd pages."""

import html
import re

import pyarrow.parquet as pq

from panelwright.llm import pages as pg
from panelwright.llm.queries import QUERIES


def plain(source):
    """The article of a test page by regular expressions."""
    body = re.search(r"(?s)<article>(.*?)</article>", source).group(1)
    body = re.sub(r"</?(?:p|h1|br|li|ul)>", "\x00", body)
    body = html.unescape(re.sub(r"<[^>]*>", "", body))
    return " ".join(" ".join(b.split()) for b in body.split("\x00") if b.split())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/pages.parquet").to_pydict()
    got = {r.page_id: r for r in QUERIES["op10_pages"](spark, sf).collect()}
    assert len(got) == len(t["page_id"])
    for i, url, source in zip(t["page_id"], t["url"], t["html"]):
        assert got[i].text == plain(source) and got[i].url == url and got[i].n_chars == len(got[i].text)


def text(source):
    return pg._joined(pg.blocks(source))


def test_chrome_of_many_kinds():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
    <header><h1>Site</h1></header><div class="top-nav">Menu</div><div id="cookie-notice">Cookies &amp; more</div>
    <div class="wrapper"><aside>Side</aside><main><article id="post-1"><header><h1>Head&shy;line</h1></header>
    <p>One <b>bo</b>ld &lt;tag&gt;<br>two<p>three &amp; four<script>var a = "</p>";</script>
    <div class='ad'>Buy</div><form>Mail <input></form><ul><li>five<li>six</ul><!-- no <p>no</p> --></article></main>
    <section class="comments"><article class="comment"><p>First!</p></article></section></div>
    <div role=contentinfo>Legal</div><footer>Foot</footer></body></html>"""
    assert text(page) == "Head\xadline One bold <tag> two three & four five six"


def test_broken_markup():
    assert text("<article><p class='ad'>ad<p>text</article>") == "text"
    assert text("<article>a < b and <b>c</article>") == "a < b and c"
    assert text("<article>a<script>never closed") == "a"
    assert text("<article><p>a</span></div>b</p>") == "ab" or text("<article><p>a</span></div>b</p>") == "a b"
    assert text('<article><a href="x>y">l</a>ink &am &amp') == "link &am &"
    assert text(None) == text("") == text("<!-- only") == text("<") .replace("<", "") == ""


def test_repetition_judges_pages_without_article(spark):
    chrome = "<div>Read all our daily news here now</div>"
    rows = [(i, f"http://h.example/{i}", f"{chrome}<p>Story number {i} tells of thing{i} and place{i} only</p><div>All rights are reserved by us today</div>") for i in range(5)]
    rows += [(9, "http://other.example/", f"{chrome}<p>alone</p>"), (10, "http://h.example/10", rows[0][2])]
    got = {r.page_id: r.text for r in pg.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "3 tells of thing3 and place3" and got[10] == got[0] == "0 tells of thing0 and place0"
    assert got[9] == "Read all our daily news here now alone"


def test_odd_rows(spark):
    art = "<article>" + "w " * 200_000 + "</article>"
    rows = [(1, None, None, "a"), (None, "u", "", "b"), (2, "u", "<article>x</article>", "c"), (2, "u", "<article>x</article>", "c"), (3, None, "<p>free text</p>", "d"), (4, "u", art, "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pg.extract(df)
    assert out.columns == ["page_id", "url", "text"]
    got = sorted(((r.page_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, ""), (None, ""), (2, "x"), (2, "x"), (3, "free text"), (4, ("w " * 200_000).strip())], key=str)
    assert pg.extract(df.limit(0)).count() == 0


def test_article_in_name_only_leaves_the_page_to_repetition(spark):
    chrome = "<div>Read all our daily news here now</div>"
    odd = ["<!-- <article> -->", '<script>var a = "<main>"</script>', '<div class="comments"><article>First words of a reader</article></div>', "<article></article>", "<p title='role=main'></p>"]
    rows = [(i, f"http://h.example/{i}", f"{chrome}{x}<p>thing{i} and place{i}</p>") for i, x in enumerate(odd)]
    rows += [(9, "http://h.example/9", f'{chrome}<div role=" main "><p>spaced role</p></div>')]
    got = {r.page_id: r.text for r in pg.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"thing{i} and place{i}" for i in range(len(odd))} | {9: "spaced role"}
