import re
import time
from html.parser import HTMLParser

import pytest

from emberscope.llm.html_text import render, visible_text

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div>b<div>c", "a\nb\nc"),
    ("a <b> b</b>\n  c<br>d", "a b c\nd"),
    ("<ul><li>x<li>y<ol><li>1<li>2</ol><li>z</ul>after", "- x\n- y\n  1. 1\n  2. 2\n- z\n\nafter"),
    ("<ol start=4><li>d<li>e</ol>", "4. d\n5. e"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><caption>T</caption><tr><th colspan=2>wide head<tr><td>x<td>y</table>", "T\nwide head\nx  y"),
    ("<table><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td>l1<br>l2<td>m</table>z", "l1  m\nl2\n\nz"),
    ("<head><title>t</title></head><body>v<script>if (a</b) {}</script><style>p{}</style><!-- c --><p hidden>h</p><i style='DISPLAY : none'>n</i>", "v"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("&lt;b&gt; &amp; &copy; x&nbsp;y 1 < 2 <3", "<b> & © x\xa0y 1 < 2 <3"),
    ("<h1>H<h2>I</h2>x</p>y", "H\n\nI\n\nx\n\ny"),
    ("<a href='a>b' title=\"<i>\">l</a><br/>m</unknown></div>", "l\nm"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<p>un<b>closed <i>tags", "unclosed tags"),
    ("<p attr='never closed>x", "x"),
    ("x<!-- open", "x"),
    ("<", "<"),
    ("<script>never", ""),
    ("a<textarea>\n b &amp; <i>\n  c</textarea>d", "a b & <i>\n  cd"),
    ("<select><option>one<option selected>two<option>three</select> rest", "two rest"),
    ("<select><optgroup label=g><option>one</optgroup><option>two</select>.", "one ."),
    ("<select multiple><option>one<option>two</select>", "one\ntwo"),
    ("<select size=3><optgroup label=g><option>one</select>", "g\none"),
    ("<svg viewBox=x><title>no</title><rect/><text x=1>bar <tspan>7</tspan></text>no<g><text>axis</text></g><desc>no</desc></svg>after", "bar 7\naxis\nafter"),
    ("<object data=x><p>fallback</object>", "fallback"),
    ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>z", "yes\nz"),
    ("<video>no</video><canvas>no</canvas><iframe>no</iframe><datalist><option>no</datalist>v", "v"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_layout(page, want):
    assert render(page) == want


@pytest.mark.parametrize("deep", ["<div>", "<p><div>", "<ul><li>", "<ol><li>", "<blockquote>", "<table><tr><td>", "<b>", "<svg><g>", "<dl><dd>", "<select><option>"])
def test_time_follows_the_size_of_a_deep_page(deep):
    start = time.process_time()
    assert "x" in render(deep * 100_000 + "<text>x")
    assert time.process_time() - start < 30


def test_tables_nested_deep_lose_no_text():
    page = "".join(f"<table><tr><td>a{i}<td>b{i}<tr><td>" for i in range(50))
    assert sorted(render(page).split()) == sorted(f"{c}{i}" for i in range(50) for c in "ab")


def test_deep_and_long_pages():
    assert render("<div>" * 20_000 + "x") == "x"
    assert render("<table><tr><td>" * 300 + "x") == "x"
    assert len(render("<p>word " * 50_000).split()) == 50_000
    assert render("<a " * 20_000 + "x=\"") == ""


class Plain(HTMLParser):
    """Words of all text outside hidden elements."""

    def __init__(self):
        super().__init__()
        self.off, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title"):
            self.off.append(tag)

    def handle_endtag(self, tag):
        if tag in self.off:
            del self.off[self.off.index(tag) :]

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_every_visible_word_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in visible_text(pages).collect()}
    assert set(got) == set(source)
    flat = lambda text: re.sub(r"\s+", "", text)
    for i, page in source.items():
        plain = Plain()
        plain.feed(page)
        plain.close()
        mine = re.sub(r"(?m)^\s*(- |\d+\. )", "", got[i])
        assert flat(mine) == flat("".join(plain.out))


def test_awkward_table(spark):
    rows = [(1, None, "u", "t"), (1, "<p>x", None, "t"), (None, "y", "u", None), (2, "", "u", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = sorted((r["page_id"] or 0, r["text"]) for r in visible_text(pages).collect())
    assert got == [(0, "y"), (1, ""), (1, "x"), (2, "")]
    assert visible_text(pages.limit(0)).count() == 0
