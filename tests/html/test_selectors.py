import pytest
from pyspark.sql import functions as F

from tagweave.operators.matching import select as select_in_tree
from tagweave.operators.tree import parse_html as parse_tree
from tagweave.plans import local, relational
from tagweave.plans.selector import SelectorError, necessary, nth, parse
from tagweave.sources.html import node_table, parse_html, prefilter

PAGE = """<!DOCTYPE html><html lang=en><head><title>Shop</title><script>var basket=[7]</script></head><body>
<ol id=queue class="wide">""" + "".join(f"<li>{x}" for x in "abcdefgh") + """</ol>
<dl id=terms><dt>A</dt><dd>one</dd><dt>B</dt><dd>two</dd><dd>three</dd><figure>F</figure></dl>
<aside><hr></aside><h6 class=note><!-- nothing --></h6><h6 class=gap> </h6>
<blockquote id=said>He said: <cite>Tea</cite> twice</blockquote>
<nav class="Top bar"><a href="/shop?id=42" data-kind=tea>Green <b>Leaf</b></a><a HREF='https://Tea.example/pots' title=" Pots ">Pots</a><span>plain</span></nav>
<main><h1>Today</h1><p lang=fr>thé<i>noir</i></p>loose<p>milk</p></main><s:price>12</s:price></body></html>"""

SELECTORS = """li; OL; *; #queue; #QUEUE; .top; .TOP.bar; a:first-child; span:last-child; li:nth-child(3n+1); li:nth-child(even); li:nth-child(5)
li:nth-child(-n+3); li:nth-child(-3n+8); #queue li:nth-last-child(2); #terms dd:nth-of-type(2); #terms *:nth-last-of-type(2); :first-of-type; :last-of-type
:only-child; :only-of-type; :empty; :root; html:first-child; a[href]; a[^data-]; a[href^=https]; a[href$=S]; a[href*='op?']; a[title=pots]; a[title!=x]
a[href~=[0-9]]; [data-kind="tea"]; li:lt(2); li:gt(5); li:eq(4); body > nav > a; body i; h1 + p; h1 ~ p; nav:has(b); :has(hr); h6:not(.note):not([lang]); :contains(green leaf)
p:containsOwn(thé); script:containsData(basket); p:matches(^th.noir$); p:matchesOwn(^milk$); ol li, #said cite, b; #said, dl > dt; > html; s|price; *|price; a:not(:has(b)); main > :not(p)
nav:has(> a); body > ol:has(li:nth-child(3)) ~ main p; html body main p i; body > main > p > i; main p:not(html i); dl dt ~ dd + dd""".replace("\n", ";").split(";")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, PAGE), (2, "<p>x</p>"), (3, "")]
    return parse_html(spark.createDataFrame(rows, "doc long, html string")).cache()


@pytest.fixture(scope="module")
def trees():
    return {1: parse_tree(PAGE).root, 2: parse_tree("<p>x</p>").root, 3: parse_tree("").root}


def pres(root, nodes):
    number = {id(n): i for i, n in enumerate(root.walk())}
    return [number[id(n)] for n in nodes]


@pytest.mark.parametrize("css", [s.strip() for s in SELECTORS])
def test_all_plans_agree(pages, trees, css):
    want = {(d, i) for d, root in trees.items() for i in pres(root, select_in_tree(root, parse(css)))}
    one = pages.select("doc", F.explode(F.transform(local.select(F.col("dom"), css), lambda n: n["pre"])).alias("pre"))
    assert {tuple(r) for r in one.collect()} == want
    many = relational.select(node_table(pages, "doc"), css, "doc").select("doc", "pre")
    assert sorted(tuple(r) for r in many.collect()) == sorted(want)


def test_expected_matches(pages):
    def texts(css):
        got = pages.where("doc = 1").select(local.select(F.col("dom"), css).alias("els")).first()["els"]
        return [e["text"] for e in got]

    assert texts("#queue :nth-child(3n+1)") == ["a", "d", "g"]
    assert texts("#queue :nth-child(-3n+8)") == ["b", "e", "h"]
    assert texts("#queue :nth-child(-n+3)") == ["c", "d", "e", "f", "g", "h"]  # a sign without digits has coefficient 1
    assert texts("#terms :nth-of-type(2)") == ["B", "two"]
    assert texts("a[title=pots]") == ["Pots"] and texts("#QUEUE") == []
    assert texts("h6.gap:empty") == [] and texts("h6.note:empty") == [""]
    assert texts("html:first-child") == []


def test_scope(pages):
    got = pages.where("doc = 1").select(F.transform(local.select(F.col("dom"), "> a", F.filter("dom", lambda n: n["norm"] == "nav")[0]["pre"]), lambda n: n["text"]).alias("t")).first()["t"]
    assert got == ["Green Leaf", "Pots"]


def test_relational_plans_parse_once(spark):
    df = parse_html(spark.createDataFrame([(1, PAGE)], "doc long, html string"))
    for css in ("div ul li a:not(b i)", "body > main > p > i", "body:has(main:has(p:has(i)))"):
        found = relational.select(node_table(df, "doc"), css, "doc")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan, css


def test_settings_in_every_mode(spark):
    rows = spark.createDataFrame([(1, "<DIV CamelCase=1>x</DIV>", 7)], "_base long, html string, _html int")
    for mode in ("auto", "html", "fragment", "fragment:body", "xml"):
        names = lambda **o: [(n["name"], [a["k"] for a in n["attrs"]]) for n in parse_html(rows, mode=mode, fields=(), **o).first()["dom"] if n["kind"] == "element" and n["norm"] == "div"]  # noqa: B023, E731
        assert names(keep_tag_case=True, keep_attr_case=True) == [("DIV", ["CamelCase"])], mode
        assert names(keep_tag_case=False, keep_attr_case=False) == [("div", ["camelcase"])], mode
        assert names() == ([("DIV", ["CamelCase"])] if mode == "xml" else [("div", ["camelcase"])]), mode
    got = parse_html(rows.withColumnRenamed("_base", "a.b")).first()
    assert (got["a.b"], got["_html"]) == (1, 7)


@pytest.mark.parametrize("css", ["", "p:is(a)", ":lt(x)", "[", "p >", ":nth-child(x)", "p:has()", "..x", ":matchesWholeText(a)"])
def test_errors_come_when_the_plan_is_built(css):
    with pytest.raises(SelectorError):
        parse(css)


def test_parse_details():
    assert nth("odd") == (2, 1) and nth("-n+2") == (1, 2) and nth("-2n+5") == (-2, 5) and nth("3") == (0, 3)
    assert parse("a, b > c")[0] == "or"
    assert set(necessary(parse("body nav a[href=x]"))) == {"<a", "href", "<nav"}
    assert necessary(parse("a, b")) == [] and necessary(parse("tbody td")) == ["<td"]


def test_filters_reach_the_rows_before_the_parser(spark):
    df = spark.createDataFrame([(1, "<a href=x>"), (2, "<p>")], "doc long, html string")
    kept = df.where(prefilter(F.col("html"), "a[href]"))
    parsed = parse_html(kept, selectors=["a[href]"]).where(F.size(local.select(F.col("dom"), "a[href]")) > 0)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert [r.doc for r in parsed.select("doc").collect()] == [1]
