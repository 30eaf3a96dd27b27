import re
import time

import pytest

from cadenza.llm.html_text import extracted, page_text

CASES = [
    (None, ""),
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<title>t</title><body><p>one<p>two <b>bold</b>!<div>three</div>", "one\n\ntwo bold!\n\nthree"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>", "Name       N\nlong name  1\nx          22"),
    ("<table><caption>C</caption><td>a<td colspan=2>b<td>c</table>", "C\na  b    c"),
    ("a<script>var t='</p>';</script>b<style>p{}</style><!-- no -->c<noscript>d</noscript>", "abc"),
    ("<p hidden>no<p style='display: none'>no</p><p style='color:red'>yes<span style='visibility:hidden'>no</span>", "yes"),
    ("<pre>  x\n    y\n</pre>z", "  x\n    y\n\nz"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("1 &lt; 2 &amp; caf&eacute; &#x41;&nbsp;x", "1 < 2 & café A\xa0x"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
    ("<div>a</span></p>b</div><p>c</i>d", "ab\n\ncd"),
    ("<select><option>no</select>yes<input value=no>", "yes"),
    ("<a href=x>l1</a><a>l2</a> <em>e</em>", "l1l2 e"),
]


def test_layout():
    for html, want in CASES:
        assert page_text(html) == want, html


def test_deep_and_long():
    assert page_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert page_text("<ul><li>" * 300 + "deep").strip().endswith("deep")
    assert page_text("<p>word " * 20000).count("word") == 20000


def test_no_visible_word_is_lost(spark):
    rows = [(i, f"<article><h1>h{i}</h1>" + "".join(f"<p>w{i}x{k} <i>v{k}</i>" for k in range(i % 7)) + f"<table><tr><td>c{i}</table><script>s</script></article>", "x") for i in range(50)] + [(7, None, "x"), (None, "<p>n", "x")]
    got = extracted(spark.createDataFrame(rows, "page_id bigint, html string, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.text:
            want = [f"h{r.page_id}", *(w for k in range(r.page_id % 7) for w in (f"w{r.page_id}x{k}", f"v{k}")), f"c{r.page_id}"]
            assert re.findall(r"\S+", r.text) == want and r.n_chars == len(r.text)
    assert extracted(spark.createDataFrame([], "page_id bigint, html string")).collect() == []


def test_strays_open_heads_and_deep_hidden_elements():
    for html, want in [
        ("<table><tr><form><td>a<td>b</form></tr><tr><td>c</table>", "a b c"),
        ("<table><tbody>x<tr>y<b>z</b><td>c</td></tr><tr hidden>no<td>no</table>", "xyz c"),
        ("<table><colgroup><col><tr><td>a<td>b</table>", "a b"),
        ("<head><title>T</title><span><div>page</div></span>", "page"),
        ("<head><meta charset=x>text <b>bold</b>", "text bold"),
        ("<head><title>T</title><script>s</script>\n</head><body>page", "page"),
        ("<div>" * 200 + "<span hidden>no<b>no</b>no<span>no</span>no</span>yes<script>no</script>", "yes"),
    ]:
        assert page_text(html).split() == want.split(), html


def test_spans_of_rows_and_columns():
    for html, want in [
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td>a<td rowspan=3>tall<td>b<tr><td>c<td>d<tr><td colspan=1>e<td>f</table>", "a  tall  b\nc        d\ne        f"),
        ("<table><tbody><tr><td rowspan=0>g<td>1<tr><td>2<tbody><tr><td>h<td>3</table>", "g  1\n   2\nh  3"),
        ("<table><tr><td colspan=2>a long heading<tr><td>x<td>y</table>", "a long heading\nx  y"),
        ("<table><tr><td colspan=3>w<td>z<tr><td>x</table>", "w      z\nx"),
        ("<table><tr><td>one<br>two<td>three</table>", "one  three\ntwo"),
    ]:
        assert page_text(html) == want, html


def test_numbers_of_items():
    assert page_text("<ol start=-1><li>a<li>b<li value=12345>c<li>d</ol>") == "-1. a\n0. b\n12345. c\n12346. d"
    assert page_text("<ol reversed><li>a<li>b</ol>") == "2. a\n1. b"


def test_styles():
    for html, want in [
        ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes<b style='visibility:inherit'>!</b></p>no</div>", "yes!"),
        ("<div style='display:none'>no<p style='display:block;visibility:visible'>no</p></div>yes", "yes"),
        ("<style>.ad, #x {display:none} p.q{display:none}</style><p class='a ad'>no</p><p id=x>no</p><p class=q>no</p><div class=q>yes</div>", "yes"),
        ("<style>.a{display:none} .b{display:block}</style><p class='a b'>yes<p class=a>no", "yes"),
        ("<style>p{display:none !important}</style><p style='display:block'>no</p>yes", "yes"),
        ("<style>/* p{display:none} */ @media print {p{display:none}} b{}</style><div><p>yes</div>", "yes"),
        ("<style>div p {display:none}</style><div><b><p>no</b></div><p>yes", "yes"),
        ("<style>.a .b{display:none}</style><div class=a>x<i><b class=b>SECRET</b></i></div><b class=b>y</b>", "x\ny"),
        ("<style>.a > .b{display:none}</style><p class=a>x<b class=b>no</b><i><b class=b>y</b></i>", "xy"),
        ("<style>body #n .b i{display:none}</style><body><p id=n><span class=b>x<i>no</i></span><i>y</i>", "xy"),
        ("<style>.a .b{visibility:hidden} .b{visibility:visible} .c + .b, .b:hover{display:none}</style><p class=a><b class=b>no</b>", ""),
        ("<style>#n{visibility:hidden} .m{visibility:visible}</style><div id=n>no<i class=m>yes</i></div>", "yes"),
        ("<style>p{display:none", ""),
        ("<p style='display:none' style='display:block'>no</p>yes", "yes"),
    ]:
        assert page_text(html) == want, html


def test_deep_nesting_keeps_visibility():
    deep = "<div>" * 3000
    assert page_text(deep + "<span hidden>no</span>yes") == "yes"
    assert page_text("<div hidden>" + deep + "no" + "</div>" * 3001 + "yes") == "yes"
    assert page_text("<ul><li>" * 2000 + "x").split() == ["-"] * 2000 + ["x"]
    assert page_text("<table><tr><td>" * 1000 + "x") == "x"
    assert page_text("<b>" * 50_000 + "x" + "<p>y" * 1000).count("y") == 1000


PAGES = {
    "lists": lambda n: "<ul><li>a" * (n // 9),
    "numbered lists": lambda n: "<ol><li>a<p>b" * (n // 13),
    "row spans": lambda n: "<table><tr>" + "<td rowspan=2 colspan=1000>x" * (n // 28) + "<tr><td>y</table>",
    "rows of spans": lambda n: "<table>" + "<tr><td rowspan=3>x<td colspan=900>y" * (n // 36) + "</table>",
    "rules": lambda n: "<style>" + "p{display:none}" * (n // 30) + "</style>" + "<p>x</p>" * (n // 16),
    "rules of classes": lambda n: "<style>" + "".join(f".a .b{k},.a.c{k}{{display:none}}" for k in range(n // 60)) + "</style>" + "<p class='a b7'>x" * (n // 34),
    "rules in depth": lambda n: "<style>" + "".join(f"div .b{k % 9} i{{display:none}}" for k in range(n // 100)) + "</style>" + "<div><b class=b5>" * (n // 34) + "x",
    "stray ends": lambda n: "<b><table><td>" + "<span>" * (n // 12) + "</b>" * (n // 8) + "x",
    "nested tables": lambda n: "<table><tr><td>" * (n // 15) + "x",
    "nested columns": lambda n: "<table><tr><td>a<td>" * (n // 20) + "x",
    "rows below a wide row": lambda n: "<table><tr>" + "<td>c" * (n // 10) + "<tr><td>d" * (n // 18),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_time_and_text_grow_with_the_page(name):
    def seconds(n):
        began = time.process_time()
        text = page_text(PAGES[name](n))
        return time.process_time() - began, len(text)

    (a, small), (b, large) = seconds(120_000), seconds(480_000)
    assert large <= 4.2 * small + 1000 and large <= 24 * 480_000
    assert b <= 8 * a + 0.5


def test_a_long_cell_leaves_the_others_aligned():
    text = page_text("<table>" + "<tr><td>name<td>1<tr><td>x<td>22" + "<tr><td>" + "long " * 100 + "<td>3</table>")
    assert text.split("\n")[:2] == ["name  1", "x     22"] and text.endswith("  3")


def test_indentation_has_a_bound():
    lines = page_text("<ul><li>a" * 100).split("\n")
    assert [len(x) - len(x.lstrip()) for x in lines if x] == [min(2 * k, 40) for k in range(100)]


def test_items():
    for html, want in [
        ("<ul><li><p>a</p><p>b</p><li><p>c</p></ul>d", "- a\n\n  b\n- c\n\nd"),
        ("<ul><li><li>a<li></ul>", "- a"),
        ("x<ul>y<li>a</ul>", "x\n\ny\n- a"),
        ("<ol><li><ul><li>a<li>b</ul><li>c</ol>", "1. - a\n   - b\n2. c"),
        ("<table><tr><td><p>a</p><p>b</p><tr><td><ul><li>c</ul></table>", "a\n\nb\n- c"),
    ]:
        assert page_text(html) == want, html


def test_tables_take_linear_memory():
    long = "<table><tr><td>" + "x" * 500_000 + "<td>y" + "<tr><td>a<td>b" * 30_000 + "</table>"
    text = page_text(long)
    assert len(text) < 2 * len(long) and text.count("a  b") == 30_000
    wide = "<table><tr>" + "<td>c" * 2000 + "<tr><td colspan=1000><td>d" * 20_000 + "</table>"
    text = page_text(wide)
    assert len(text) < 9 * len(wide) and text.count("d") == 20_000
