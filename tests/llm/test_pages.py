"""Archives, their index, and page layout."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from limnos.llm import warc
from limnos.llm.layout import text_of
from limnos.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.tables import write_pages

SF = "/root/testdata/sf0.001"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
ODD = [
    (9, "http://Www.Example.com:80/a?b=1#c", "<p>same</p>"), (3, "https://user@www.example.com/a?b=1", "<p>same</p>"),
    (5, None, None), (2, None, ""), (7, "", "<p>same</p>"), (None, "http://x.org", "<p>same</p>"), (None, "http://x.org", "only null"),
    (11, "http://x.org", "é\r\n\r\nWARC/1.0\r\n" * 50), (12, "http://x.org/two\nlines", "t" * 300_000), (3, "http://y.org", "<p>same</p>"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write_pages(spark, str(tmp_path_factory.mktemp("pages")), ODD)


def archive_rows(spark, folder):
    return Counter(tuple(r) for r in QUERIES["op1_warc_index"](spark, folder).select(*COLUMNS).collect())


def test_archives(spark, odd):
    assert archive_rows(spark, odd) == brute.archived(ODD)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_archives_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert archive_rows(spark, SF) == brute.archived(rows)


def test_no_pages(spark, tmp_path):
    folder = write_pages(spark, str(tmp_path), [])
    assert QUERIES["op1_warc_index"](spark, folder).collect() == []
    assert QUERIES["op8_html_extraction"](spark, folder).collect() == []


def test_small_payloads_are_never_revisits(spark, odd):
    pages = spark.read.parquet(f"{odd}/pages.parquet")
    roles = {(r.page_id, r.record_type) for r in warc.with_roles(pages, least=12).collect()}
    assert {kind for _, kind in roles} == {"response"}


def test_lookup_finds_all_captures_of_a_key(spark):
    """One key fills several blocks and several files."""
    captures = spark.range(300).selectExpr(
        "case when id % 3 = 0 then 'org,x)/' else concat('org,y)/', id % 7) end as key", "id as page_id",
        "'response' as record_type", "'f' as file", "id as offset", "1L as length",
    )
    index = warc.write_index(captures, block=5)
    found = warc.lookup(index, spark.createDataFrame([("http://x.org",), ("http://y.org/4",), ("http://none.org",)], "url string"))
    want = {i for i in range(300) if i % 3 == 0 or i % 7 == 4}
    assert sorted(r.page_id for r in found.collect()) == sorted(want)


def test_payloads_come_back(spark, odd):
    base, captures = warc.write_archives(spark.read.parquet(f"{odd}/pages.parquet"))
    read = warc.read_records(spark, base, captures, payload=True).filter("record_type = 'response'")
    got = Counter((r.page_id, bytes(r.payload).decode()) for r in read.collect())
    responses = {(page, digest) for page, _, digest, kind, _ in brute.archived(ODD) if kind == "response"}
    assert {page for page, _ in got} == {page for page, _ in responses}
    assert got[(12, "t" * 300_000)] == 1 and got[(11, ODD[7][2])] == 1


def test_url_keys(spark):
    urls = ["http://Www.Example.com:80/A?b#c", "https://u@example.com", "example.com/x", "", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,www:80)/A?b", "com,example)/", "com,example)/x", ")/", "-"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
        ("<title>t</title>x<script>var t='</p>'</script>y", "xy"),
        ("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>z", "- x\n- y\n  3. 1\n  4. 2\n\nz"),
        ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>longer<td>2</table>", "name   | n\na      | 10\nlonger | 2"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>d<td>e</table>", "a | b\n  | c\nd |   | e"),
        ("<table><tr><td>a<table><tr><td>1<td>2</table><td>b</table>", "a     | b\n1 | 2 |"),
        ("<div hidden>no</div><p style='color:red; display : none'>no<b>no</b></p>yes<input value=no>", "yes"),
        ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
        ("a<br>b &amp; &lt;c&gt; &copy;<!-- no > no -->d", "a\nb & <c> ©d"),
        ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n  v\nl\n  w"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("</p>x</div></b>y", "xy"),
        ("1 < 2 and <a href='x>y'>z</a> \"q\"", '1 < 2 and z "q"'),
        ("<div>" * 20_000 + "deep", "deep"),
        ("<details><summary>s</summary>no</details>", "s"),
        ("<p>a</p><hr><p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    ],
)
def test_layout(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>.", "so x=2."),
        ("<svg><title/><defs><text>no</text></defs><path d='M0'/><g>no<text x=1>one</text><text>two</text></g><desc>no</desc></svg>end", "one two end"),
        ("<svg><style>no</style><defs/><text display=none>no</text><foreignObject><p>a<br/>b</p></foreignObject></svg>", "a\nb"),
        ("<object data=x><p>instead</p></object>y", "instead\n\ny"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes<i style='visibility:hidden'>no</i></b><p>no</p></div>z", "yes\nz"),
        ("a<span style='visibility:hidden'><div>no</div></span>b", "ab"),
        ("<ul><li style='visibility:hidden'>no<span style='visibility:visible'>x</span><li>y</ul>", "x\n- y"),
        ("<p style='visibility:hidden'>" * 3000 + "no<q style='visibility:visible'>in</q>", '"in"'),
        ("<table><tr style='visibility:collapse'><td style='visibility:visible'>no<tr><td>a</table>", "a"),
    ],
)
def test_text_of_embedded_and_visible_again(page, text):
    assert text_of(page) == text


def test_rendered_rows(spark, odd):
    got = Counter((r.page_id, r.text) for r in QUERIES["op8_html_extraction"](spark, odd).collect())
    assert got == Counter((page, text_of(html or "")) for page, _, html in ODD)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<input type=submit value='Send now'>b<input type=Image alt=go><input type=text value=no><input type=hidden value=no>", "a Send now b go"),
        ("<table><tr><td>|<tr><td> <tr><td>x</table>", "|\nx"),
        ("<table><tr><td colspan=150>a<td>b<tr><td>c</table>", "a" + " | " * 150 + "b\nc"),
        ("<table><tr><td colspan=150>a<tr><td>c</table>", "a\nc"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<table><tr><td rowspan=-2 colspan=0>a<td>b<tr><td>c</table>", "a | b\nc"),
        ("<ol start=123456789012><li>x<li value=-5>y<li value=2000000>z<li value=abc>w</ol>", "123456789012. x\n-5. y\n2000000. z\n2000001. w"),
        ("<ol start=99999999999999999999><li>x</ol>", "1. x"),
    ],
)
def test_spans_numbers_and_buttons(page, text):
    assert text_of(page) == text


def test_wide_cells_do_not_widen_all_others():
    """A thousand rows beside one long cell: the text stays near the size of the page."""
    page = "<table>" + "<tr><td>ab<td>cd" * 1000 + f"<tr><td>{'long ' * 4000}<td>x" + "</table>"
    text = text_of(page)
    assert len(text) < 2 * len(page) and text.startswith("ab | cd\n") and text.endswith("| x")


def plain_page(pick, depth=0):
    """A random page of well-formed markup, and its lines as a list of (gap before, line)."""
    word = lambda: "".join(pick.choice("abcxyz") for _ in range(pick.randint(1, 5)))
    html, blocks = [], []
    for _ in range(pick.randint(1, 4)):
        kind = pick.choice(["p", "div", "h2", "ul", "ol", "table", "hidden", "pre", "br"] if depth < 2 else ["p", "div", "br"])
        text = " ".join(word() for _ in range(pick.randint(1, 4)))
        spaced = text.replace(" ", pick.choice([" ", "\n  ", " <b> ", " <!-- <p>no --> "])).replace("<b>", "<b></b>")
        if kind in ("p", "h2"):
            html.append(f"<{kind}>{spaced}</{kind}>")
            blocks.append((True, [text]))
        elif kind == "div":
            html.append(f"<div> {spaced}\n</div>")
            blocks.append((False, [text]))
        elif kind == "br":
            html.append(f"<div>{spaced}<br>{word()}z</div>")
            blocks.append((False, [text, html[-1].rsplit(">", 2)[1].split("<")[0]]))
        elif kind == "hidden":
            html.append(pick.choice([f"<div hidden>{text}</div>", f"<script>{text}</script>", f"<div style='display:none'><p>{text}</div>"]))
        elif kind == "pre":
            html.append(f"<pre>{text}\n  {text}</pre>")
            blocks.append((True, [text, f"  {text}"]))
        elif kind in ("ul", "ol"):
            items = [word() for _ in range(pick.randint(1, 4))]
            html.append(f"<{kind}>" + "".join(f"<li>{item}" + pick.choice(["", "</li>"]) for item in items) + f"</{kind}>")
            blocks.append((True, [f"{k}. {item}" if kind == "ol" else f"- {item}" for k, item in enumerate(items, 1)]))
        else:
            rows = [[word() for _ in range(pick.randint(1, 3))] for _ in range(pick.randint(1, 3))]
            html.append("<table>" + "".join("<tr>" + "".join(f"<td>{cell}" for cell in row) for row in rows) + "</table>")
            widths = [max(len(row[i]) for row in rows if i < len(row)) for i in range(max(map(len, rows)))]
            blocks.append((True, [" | ".join(cell.ljust(widths[i]) for i, cell in enumerate(row)).rstrip() for row in rows]))
    return "\n".join(html), blocks


def test_pages_against_their_plan():
    """Random pages, laid out from the plan that they were written from."""
    pick = random.Random(6)
    for _ in range(400):
        html, blocks = plain_page(pick)
        lines, gap = [], False
        for spaced, own in blocks:
            if lines and (gap or spaced):
                lines.append("")
            lines += own
            gap = spaced
        assert text_of(html) == "\n".join(lines), html
