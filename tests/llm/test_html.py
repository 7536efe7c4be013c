from __future__ import annotations

import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dunning.llm import html_layout, registry

show = html_layout.visible_text

CASES = [
    (None, None),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<div>one</div><div>two</div>three", "one\ntwo\nthree"),
    ("a<br>b<br><br>c", "a\nb\nc"),
    ("  many \n\t spaces  <b> here </b> ", "many spaces here"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol><li>a<li>b</ol>", "1. a\n2. b"),
    ("<ol start=9><li>a<li>b<p>more</ol>", "9. a\n10. b\n\n    more"),
    ("<table><tr><td>a<td>long<tr><td>wide cell<td>b</table>", "a          long\nwide cell  b"),
    ("<table><td>x<table><tr><td>in<td>ner</table>y<td>z</table>", "x        z\n\nin  ner\n\ny"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab     c\n1   2  3"),
    ("<table><caption>t</caption><thead><tr><th>h<tbody><tr><td>d</table>", "t\nh\nd"),
    ("<pre>\n a\n   b\n</pre>c", " a\n   b\n\nc"),
    ("<script>if (a<b) x('</p>')</script>a<style>p{}</style><!-- c --><title>t</title>b", "ab"),
    ("<div hidden>x<p>y</div><span style='color:red; display: none'>z</span><i style='visibility:hidden'>v</i>shown", "shown"),
    ("<details><summary>s</summary>b</details><details open><summary>s2</summary>b2</details>", "s\ns2\nb2"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n    d\nu"),
    ("a < b, 3<4 <> &lt;p&gt;", "a < b, 3<4 <> <p>"),
    ("<a title=\"x > y\">in</a>", "in"),
    ("</p></i></div>x<td>y", "xy"),
    ("<b>open <i>never closed<p>next", "open never closed\n\nnext"),
    ("x<!-- never closed <p>y", "x"),
    ("x<p class='never closed", "x"),
    ("<!DOCTYPE html><?php x ?>a", "a"),
    ("<hr>a<hr>b", "a\n\nb"),
    ("<input type=hidden value=h><input type=submit value=Go>", "Go"),
    ("<h1>T</h1><blockquote>q<p>r</blockquote>e", "T\n\n> q\n\n> r\n\ne"),
    ("&nbsp;x&#233;&eacute;&#xE9;", "xééé"),
    ("<pre><p>\nword", "word"),
    ("<pre>\n\n\na\n\n</pre>", "a"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_cases(html, text):
    assert show(html) == text


class Reader(HTMLParser):
    """Words outside scripts, styles and titles, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.skip, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.parts.append(" " if tag not in ("b", "a", "i") else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.parts.append(" " if tag not in ("b", "a", "i") else "")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_pages_lose_no_word(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in registry.op10_html_layout(spark, "/root/testdata/sf0.01").collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        reader = Reader()
        reader.feed(r.html)
        bullets = re.sub(r"(?m)^- ", "", got[r.page_id].text)
        assert bullets.split() == "".join(reader.parts).split()
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


TAGS = ["p", "b", "div", "ul", "ol", "li", "table", "tr", "td", "th", "tbody", "caption", "pre", "br", "dl", "dt", "dd", "details", "summary", "blockquote", "span hidden", "script", "textarea", "select", "option", "h1"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([f"<{t}>" for t in TAGS] + [f"</{t.split()[0]}>" for t in TAGS]), st.sampled_from(["word", " ", "&amp;", "<", "<!--", "-->", "\n"])), max_size=30))
def test_any_markup_is_read(parts):
    out = show("".join(parts))
    assert isinstance(out, str) and out == out.strip("\n")


def test_deep_and_hostile_pages_end_soon():
    for html in ("<" * 30000, "<a " * 30000, "<b>" * 30000 + "x" + "</i>" * 30000, "<table><tr><td>" * 2000 + "x", "<ul><li>" * 2000 + "x", "<div>" * 50000 + "y", "<!--" * 20000, "<p a='" * 20000, "<table>" + "<tr><td>" * 3000 + "w" * 100000):
        assert len(show(html)) < 10 * len(html)


def test_edges(spark, stored):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, "b"), (2, "u", None), (3, "u", ""), (4, "u", "<p>word " * 40000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = registry.op10_html_layout(spark, stored(pages=pages)).collect()
    assert sorted(((r.page_id or 0), r.text or "", r.n_chars) for r in got if r.page_id != 4) == [(0, "b", 1), (1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0)]
    assert registry.op10_html_layout(spark, stored(pages=pages.limit(0))).count() == 0


@pytest.mark.parametrize(
    "html,text",
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b", "a x=2 b"),
        ("<svg><title>t</title><defs/><desc>d</desc><path d='M0'/><text x=1>label</text><text>two</text></svg>after", "label\ntwo\nafter"),
        ("in <select><option>one<option selected>two<option>three</select> out", "in two out"),
        ("<select><option>one<option>two</select>", "one"),
        ("<select multiple><option>one<option>two</select>", "one\ntwo"),
        ("<input value=typed> <input type=password value=p><input type=checkbox value=c>", "typed"),
    ],
)
def test_drawings_formulas_and_inputs_show_their_text(html, text):
    assert show(html) == text


LONG = " ".join(["word"] * 70)


@pytest.mark.parametrize(
    "html,text",
    [
        # spans keep the columns of the rows below
        ("<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>1<td>2</table>", "ab  c\n    d\n1   2"),
        ("<table><tr><th>h<td rowspan=3>x<th>k<tr><td>1<td>2<tr><td>3<td>4<tr><td>5<td>6<td>7</table>", "h  x  k\n1     2\n3     4\n5  6  7"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>", "a  b  c\nd     e\nf  g"),
        ("<table><tr><td rowspan=2 colspan=2>q<td>r<tr><td>s<tr><td>t<td>u<td>v</table>", "q     r\n      s\nt  u  v"),
        ("<table><tr><td>a<tr><td>b<td rowspan=2>c<td>d<tr><td>e<tr><td>f<td>g</table>", "a\nb  c  d\ne\nf  g"),
        # wide cells stay in line
        (f"<table><tr><td>{'x' * 60}<td>1<tr><td>y<td>2</table>", "x" * 60 + "  1\ny" + " " * 61 + "2"),
        (f"<table><tr><td>{LONG}<td>1<td>end<tr><td>y<td>2</table>", f"{' '.join(['word'] * 32)}  1  end\n{' '.join(['word'] * 32)}\n{' '.join(['word'] * 6)}\ny{' ' * 160}2"),
        (f"<table><tr><td>y<td>{LONG}</table>", f"y  {LONG}"),
        # numbers of items
        ("<ol reversed><li>a<li>b<ul><li>in</ul><li>c</ol>", "3. a\n2. b\n   - in\n1. c"),
        ("<ol start=3 reversed><li value=9>a<li>b</ol>", "9. a\n8. b"),
        ("<ol><li>a<li value=7>b<li>c<li value=x>d<li value=-2>e</ol>", "1. a\n7. b\n8. c\n9. d\n-2. e"),
        ("<ol reversed><!-- <li> --><script>'<li>'</script><li>a<li>b</ol>", "2. a\n1. b"),
        # what is visible inside something hidden
        ("<div style='visibility:hidden'>a<p style='visibility: visible'>b<i>c</i></p>d</div>e", "bc\n\ne"),
        ("<div style='display:none'>a<p style='visibility:visible'>b</p></div>e", "e"),
        ("<table><tr><td>a<td style='visibility:hidden'>b<td>c<tr><td>1<td>2<td>3</table>", "a     c\n1  2  3"),
        ("x <input style='visibility:hidden' value=v> y", "x y"),
    ],
)
def test_layout_of_spans_wide_cells_numbers_and_visible_children(html, text):
    assert show(html) == text


def test_many_spans_and_reversed_lists_end_soon():
    for html in ("<ol reversed>" * 20000, "<ol reversed><li>x" * 500, "<table>" + "<tr><td rowspan=65534 colspan=100>x" * 300, f"<table>{'<tr><td>' + 'w' * 3000 + '<td>x' * 2}</table>"):
        assert len(show(html)) < 200 * len(html)
