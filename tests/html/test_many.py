"""Short documents of plain markup, read many at once."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.operators.flatten import Columns
from tagweave.operators.many import read_many
from tagweave.operators.plain import read
from tagweave.plans.queries import QUERIES
from tagweave.schema import OPTIONAL
from tagweave.sources.html import parse_html

TAGS = ["ol", "ul", "li", "p", "div", "b", "i", "a", "span", "h1", "h2", "section"]
TEXTS = ["", "", "x", " a  b ", "\xa0", "\n", " ", "é\xa0 ", "&amp; c", "a > b", "&copy=1&lt"]
ATTRIBUTES = ["", "", ' class="O o O"', ' id=n1 data-x="1 &amp; 2"', ' x="" y="&lt" x="2"', ' title="a>b"']


def made(rng, depth=0):
    out = rng.choice(TEXTS)
    for _ in range(rng.randrange(4 if depth < 4 else 1)):
        tag = rng.choice(TAGS)
        if rng.random() < 0.2:
            out += rng.choice(["<br>", "<img src=x>", "<wbr>"])
        elif tag in ("ol", "ul"):
            out += f"<{tag}{rng.choice(ATTRIBUTES)}>" + "".join(f"<li>{made(rng, depth + 2)}</li>" for _ in range(rng.randrange(3))) + f"</{tag}>"
        else:
            out += f"<{tag}{rng.choice(ATTRIBUTES)}>{made(rng, depth + 1)}</{tag}>"
        out += rng.choice(TEXTS)
    return out


def documents():
    rng = random.Random(3)
    some = [made(rng) for _ in range(3000)]
    return [*some, "", "no tags", " <b>x</b>", "<b>x</b", "<b", "x>", "<p>a<p>b", "</p>", "<b>x</i>", "<!-- c --><p>x</p>", "<p>x\x00</p>", "<div>" * 50 + "</div>" * 50, None, "<b>y</b>", "<pre> a  b</pre>", "<table><tr><td>x</td></tr></table>", "<form><input></form>", "<p>" + "long " * 9000 + "</p>"]


@pytest.mark.parametrize("fields", [frozenset(), frozenset(OPTIONAL)])
def test_many_give_what_each_gives(fields):
    texts = documents()
    dom, which = read_many(pa.array(["", *texts, ""], pa.string()).slice(1, len(texts)), fields)
    which = list(which)
    plain = Columns(fields)
    for text, taken in zip(texts, which):
        if taken:
            assert plain.add_text(text), text
    left = [t for t, taken in zip(texts, which) if not taken and t is not None and read(t) is not None]
    assert all("<pre" in t or "<table" in t or "<form" in t or len(t) > 9000 or 'title="a>b"' in t for t in left)
    assert sum(which) > 500
    want = plain.array()
    dom.validate(full=True)
    for name in want.type.value_type:
        got, due = dom.values.field(name.name), want.values.field(name.name)
        assert got.to_pylist() == due.to_pylist(), name
    assert dom.offsets.to_pylist() == want.offsets.to_pylist() and dom.type == want.type


def test_rows_keep_their_order(spark):
    texts = documents()
    df = spark.createDataFrame(list(enumerate(texts)), "k int, html string").coalesce(1)
    rows = parse_html(df.withColumn("b", F.concat(F.lit("http://h/"), "k")), base_col="b", drop_html=False).select("k", "html", "base_uri", "quirks", F.get("dom", F.lit(0))["text"].alias("text")).collect()
    assert [r.html for r in rows] == texts
    for r in rows:
        assert r.base_uri == (None if r.html is None else f"http://h/{r.k}")
        columns = Columns(("text",), ("text",))
        if r.html is not None and columns.add_text(r.html):
            assert r.text == columns.array()[0][0]["text"].as_py() and r.quirks == "no"


def test_a_batch_takes_a_fraction_of_the_time():
    """One by one, documents so small take 60 microseconds each and more."""
    texts = [f'<section><ol><li data-line="{i % 7}" class="O"><b>N</b> odd</li><li data-line="2" class="F">even R</li></ol></section>' for i in range(20000)]
    given = pa.array(texts, pa.string())
    names, took = ("kind", "norm", "text", "has_text", "attr_map"), []
    for at_once in (True, False):
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            if at_once:
                assert read_many(given, names, names)[1].all()
            else:
                rows = Columns(names, names)
                assert all(map(rows.add_text, texts))
                rows.array()
            best = min(best, time.process_time() - began)
        took.append(best)
    assert took[0] < took[1] / 2, took


def plan(spark, name):
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["orders_each_text", "orders_has", "orders_not_has", "orders_own_text", "orders_text", "joined_text", "sibling_nodes", "types_nth_of_type"])
def test_rows_are_dealt_before_their_markup_is_made(spark, name):
    """Arrays of markup in the exchange were twice as long as rows."""
    below = plan(spark, name).split("Exchange hashpartitioning(l_orderkey")[-1]
    assert "concat" not in below and "Aggregate" not in below and "FileScan" in below


def test_each_document_is_searched_once(spark):
    assert plan(spark, "orders_each_text").count("has_text") == 1
