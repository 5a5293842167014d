"""Plain markup without trees, fields of nodes that are asked for, and large documents."""

import re

import pytest
from pyspark.sql import functions as F

from tagweave.operators.flatten import Columns
from tagweave.operators.plain import read
from tagweave.operators.tree import parse
from tagweave.plans import local, relational
from tagweave.plans.queries import QUERIES
from tagweave.schema import OPTIONAL
from tagweave.sources.html import node_table, parse_html

SMALL = "/root/testdata/sf0.001"
PLAIN = [
    '<section><ol><li data-line="1" class="O o O"><b>N</b> odd</li><li>even  R</li></ol></section>',
    "<p>top</p><ul><li id='p1'>x</li></ul>".replace("'", '"'),
    '<table><tr><td class="name">a &amp; b</td><td data-size="3">3</td></tr><tr></tr></table>tail',
    "<table><thead><tr><th>h</th></tr></thead><tbody><tr><td><ol><li>i</li></ol></td></tr></tbody></table>",
    '<form><input name=n value="v"><textarea name=s> t </textarea></form><input>',
    'a<br>b <span x="" y="&lt" x="2">\xa0 c</span><pre> d  e</pre>&copy=1&copy;',
]
SOUP = ["<p>a<p>b", "<b><b>x</b></b>", "<ul><li>1<li>2</ul>", "<table>x</table>", "<div><p>a<div>b</div></p></div>", "<li>a</li>", "<a><a>b</a></a>", "a<3", "<!-- c --><p>x</p>", "<B>x</B>", "<br/>", "<h1><h2>x</h2></h1>", "\n<p>x</p>", "<form><form></form></form>", "<p>x\x00</p>", "x</p>", "</p class=a>", "<option>a</option>"]


@pytest.mark.parametrize("fields", [frozenset(), frozenset(OPTIONAL)])
def test_plain_documents_are_those_of_the_builder(fields):
    trees, texts = Columns(fields), Columns(fields)
    for html in PLAIN:
        trees.add(parse(html))
        assert texts.add_text(html)
    assert texts.array().equals(trees.array())


@pytest.mark.parametrize("html", SOUP)
def test_what_is_in_doubt_is_left_to_the_builder(html):
    assert read(html) is None


def test_only_the_fields_asked_for(spark):
    df = parse_html(spark.createDataFrame([(1, PLAIN[0]), (2, "<ol><li>x<li>y")], "k int, html string"), selectors=["ol > li:nth-child(1)"], nodes=("text",))
    assert set(df.schema["dom"].dataType.elementType.names) == {"pre", "parent", "kind", "norm", "el_idx", "text"}
    rows = df.select("k", F.explode(local.select(F.col("dom"), "ol > li:nth-child(1)")).alias("n")).select("k", "n.text").collect()
    assert sorted(map(tuple, rows)) == [(1, "N odd"), (2, "x")]


@pytest.mark.parametrize("name", ["part_table_cells", "siblings", "parents", "sibling_ends", "sibling_nodes", "raw_text"])
def test_no_row_carries_its_document(spark, name):
    """A copy of the document a match is quadratic."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    passed = re.findall(r"Project \[([^\n]*)\]\n[^\n]*MapInArrow|Generate [^\n]*", plan)
    assert passed and not re.search(r"Generate explode", plan)


@pytest.mark.parametrize("css", [".a ~ li", "li ~ .a ~ b", "ul:has(.a ~ li) > b", "li:not(.a ~ *)", ".a ~ li > b ~ b, b ~ .a"])
def test_later_siblings_in_one_pass(spark, css):
    html = ["<ul><li>1</li><b>x</b><li class=a>2<b>p</b><i></i><b>q</b></li><li>3<b>r</b><b>s</b></li><b class=a>y</b><b>z</b></ul><li class=a></li><li>4</li>", "<p>none</p>", None]
    df = parse_html(spark.createDataFrame(list(enumerate(html)), "k int, html string"))
    found = df.select("k", F.explode(local.select(F.col("dom"), css)).alias("n")).select("k", "n.pre")
    want = relational.select(node_table(df, "k"), css, "k").select("k", "pre")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    if "has" not in css:
        assert "slice(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_wide_document(spark):
    """No earlier sibling matches, so each item would look through all of those before it."""
    n = 20_000
    df = parse_html(spark.createDataFrame([("<ul>" + "<li>x</li>" * n + '<li class="a">y</li><li>z</li></ul>',)], "html string"), selectors=[".a ~ li"], nodes=())
    assert df.select(F.size(local.select(F.col("dom"), ".a ~ li"))).first()[0] == 1


def test_windows_move_no_texts(spark):
    df = node_table(parse_html(spark.createDataFrame([(1, "<ul><li>a<b>x</b></li><li>c</li></ul>")], "k int, html string")), "k")
    found = relational.select(df, "li:has(b)", "k")
    assert [r.pre for r in found.collect()] == [5]
    exchanged = found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[-1]
    assert "element,document" in exchanged.replace(" ", "") or "document,element" in exchanged.replace(" ", "")
