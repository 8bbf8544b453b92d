import time

import pytest

from termloom.llm.html_text import extract_text, render

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<head><title>t</title><style>x</style></head><body>seen<script>if (a < b) '</p>'</script>", "seen"),
    ("<title>t</title>seen", "seen"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>after", "- a\n- b\n  3. x\n  4. y\n\nafter"),
    ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>", "k        | value\nlong key | 1"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
    ("<table><tr>stray<td>a</table>", "stray\n\na"),
    ("<table><td>x<table><td>y<td>z</table></table>", "x\ny | z"),
    ("<style>.ad, #n {display: none} @media print {p {display: none}}</style><p class='x ad'>1<p id=n>2<p>3", "3"),
    ("<p style='visibility:hidden'>a <b style='visibility: visible'>b</b></p>", "b"),
    ("<p hidden>a</p><details><summary>s</summary>c</details><details open><summary>s</summary>d</details>", "s\n\ns\nd".replace("\n\n", "\n")),
    ("<pre>\n a\n   b\n</pre>", " a\n   b"),
    ("<select><option>a<option selected>b</select><input type=submit value=go><input type=hidden value=no>", "bgo"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ("<style>.a{display:none} .a.b{display:block}</style><p class='a b'>shown<p class=a>not", "shown"),
    ("<style>.a.b{display:block} .a{display:none}</style><p class='b a'>shown<p class=a>not", "shown"),
    ("<style>div.x p{display:none}</style><p>1<div class=x><section><p>2</section></div><div><p>3</div>", "1\n\n3"),
    ("<style>div > b, #n i {display:none}</style><div><b>1</b><i>2<b>3</b></i></div><div id=n><u><i>4</i>5</u></div>", "23\n5"),
    ("<style>@media screen {.a{display:none}} @media print {.b{display:none}}</style><p class=a>1<p class=b>2", "2"),
    ("<style>@media (max-width: 9px) {p{display:none}} @font-face {p: {display:none}} p::before{content:'}'}</style><p>1", "1"),
    ("<style>p{display:none!important} @import 'x'; i{}</style><p style='display:block'>1</p><p style='display:block!important'>2", "2"),
    ("<style>/* p{display:none} */ a:hover{display:none} b[x]{display:none} i+b{display:none}</style><p>1 <a>2</a> <i>3</i><b x>4</b>", "1 2 34"),
    ("<select multiple><option>a<option>b</select><select size=3><optgroup><option>c<option>d</select>", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>x |<tr><td>b<td>|<tr><td>c<td></table>", "a | x |\nb | |\nc"),
    ("<a b='>\">1</a><a \"'>2", "2"),
    ("1 < 2 <!-- c --> <![CDATA[x]]>3<a href='>'>4</a>", "1 < 2 34"),
    ("<b>open <i>nested</b> text", "open nested text"),
    ("<p><", "<"),
    ("<svg><title>t</title><path/><text>shown</text></svg>", "shown"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_render(page, text):
    assert render(page) == text


def test_deep_and_broken_pages():
    assert render("<div>" * 100_000 + "deep") == "deep"
    assert render("</div>" * 1000 + "<td>x") == "x"
    long_row = "<table>" + "<tr><td>a<td>b" * 5000 + "<tr><td>" + "long " * 20_000 + "</table>"
    assert len(render(long_row)) < 1_000_000


@pytest.mark.parametrize("part", [
    "<a ", "<a", '<a "', "<a '", '<a ">"', "<a \"'>", "</a", "</a \"", "<!", "<a b=\"'>\"", "<b '>'\"", "<td", "<li", "&lt", "<p a='",
    "<style>@</style>", "<table><tr><td>",
])
def test_time_grows_with_length(part):
    """A million characters of what never ends."""
    began = time.process_time()
    render(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 60


@pytest.mark.parametrize("css", ["@", "/*", "{", "}", "@media{", "a{", '"', "'\\", "a,", "a b ", "a>", "p{display:none}", ".x p{display:none}"])
def test_time_of_styles(css):
    began = time.process_time()
    render("<style>" + css * (300_000 // len(css)) + "</style><p>" + "<div class=x>" * 100 + "seen")
    assert time.process_time() - began < 60


def test_selectors_of_deep_pages():
    page = "<style>.x p{display:none} div div b{display:none}</style><div class=x>" + "<div>" * 50_000 + "<p>no</p><b>no</b><i>yes"
    began = time.process_time()
    assert render(page) == "yes" and time.process_time() - began < 30


def test_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (2, None), (None, "<p>b"), (3, "")], "page_id long, html string")
    pages = pages.selectExpr("*", "'x' AS id", "'y' AS text", "1 AS n_chars")
    found = extract_text(pages)
    assert found.columns == ["page_id", "text", "n_chars"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", 1), (2, "", 0), (2, "", 0), (None, "b", 1), (3, "", 0)], key=str)
    assert extract_text(pages.where("false")).collect() == []
