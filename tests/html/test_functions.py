import pytest
from pyspark.sql import functions as F

from tagweave import functions as H
from tagweave.functions.urls import resolve
from tagweave.operators import edits as E
from tagweave.operators.sanitize import BASIC, NONE, RELAXED, SIMPLE_TEXT, clean, is_valid, safe_style
from tagweave.operators.serialize import Output, escape
from tagweave.operators.tags import ALL_ENTITIES, BASE_ENTITIES, XHTML_ENTITIES
from tagweave.operators.tokens import decode
from tagweave.operators.tree import parse_html

FLAT = Output(pretty=False)


def test_entity_tables():
    assert (len(XHTML_ENTITIES), len(BASE_ENTITIES), len(ALL_ENTITIES)) == (4, 106, 2125)


MENU = "Crêpe ‹10 €› & “tea”: 1 < 2 > 0, ½ Å £5 漢"


def test_escape_by_mode_and_charset():
    assert escape(MENU) == "Crêpe ‹10 €› &amp; “tea”: 1 &lt; 2 &gt; 0, ½ Å £5 漢"
    assert escape(MENU, Output(charset="ascii")) == "Cr&ecirc;pe &#x2039;10 &#x20ac;&#x203a; &amp; &#x201c;tea&#x201d;: 1 &lt; 2 &gt; 0, &frac12; &Aring; &pound;5 &#x6f22;"
    assert escape(MENU, Output(charset="ascii", escape_mode="xhtml")) == "Cr&#xea;pe &#x2039;10 &#x20ac;&#x203a; &amp; &#x201c;tea&#x201d;: 1 &lt; 2 &gt; 0, &#xbd; &#xc5; &#xa3;5 &#x6f22;"
    wide = escape(MENU, Output(charset="ascii", escape_mode="extended"))
    assert "&euro;" in wide and "&lsaquo;" in wide and wide.endswith("&#x6f22;")
    for mode in ("base", "extended", "xhtml"):
        assert decode(escape(MENU, Output(charset="ascii", escape_mode=mode))) == MENU


@pytest.mark.parametrize(
    ("text", "strict", "want"),
    [
        ("&pound;5 &pound 5 &pound5 &QUOT;", False, "£5 £ 5 &pound5 \""),
        ("&euro; &euro", False, "€ &euro"),
        ("&#8364;&#x20AC;&#x20ac", False, "€€€"),
        ("A&B &; &# &#x; &no-such;", False, "A&B &; &# &#x; &no-such;"),
        ("&#99999999;", False, "\ufffd"),
        ("?a=1&lt=2&gt;", True, "?a=1&lt=2>"),
    ],
)
def test_decode(text, strict, want):
    assert decode(text, strict) == want


@pytest.mark.parametrize(
    ("base", "relative", "want"),
    [("http://a.b/c/d", "e", "http://a.b/c/e"), ("http://a.b/c/d", "/e?x", "http://a.b/e?x"), ("http://a.b/c?y=1", "?x=2", "http://a.b/c?x=2"), ("http://a.b/", "//h/i", "http://h/i"), ("", "x", ""), ("", "http://q/", "http://q/"), ("http://a.b/c", "mailto:x@y", "mailto:x@y"), ("http://a.b/c", "#f", "http://a.b/c#f")],
)
def test_resolve(base, relative, want):
    assert resolve(base, relative) == want


@pytest.mark.parametrize(
    ("policy", "html", "want"),
    [
        (SIMPLE_TEXT, "<section><h2 id=t>News: <i class=x onclick=f()>rain</i></h2><img src=r.png> again</section>", "News: <i>rain</i> again"),
        (BASIC, "<ul><li><a href='vbscript:x'>bad</a><li><A HREF='FTP://files.example/1' target=_top>ftp</a></ul><form><q>said</q></form>", '<ul><li><a rel="nofollow">bad</a></li><li><a href="FTP://files.example/1" rel="nofollow">ftp</a></li></ul><q>said</q>'),
        (RELAXED, "<h3>Prices</h3><table><tr><th>Tea<td>2</table><style>td{}</style><!-- hidden -->", "<h3>Prices</h3><table><tbody><tr><th>Tea</th><td>2</td></tr></tbody></table>"),
        (NONE, "<td>5 &gt; 4&nbsp;!</td>", "5 &gt; 4 !"),
        (RELAXED, "<div><blink>still <b>here</b></blink></div>", "<div>still <b>here</b></div>"),
        (BASIC.add_protocols("a", "href", "#"), '<a href="#top">up</a><a href="#to p">no</a>', '<a href="#top" rel="nofollow">up</a><a rel="nofollow">no</a>'),
        (NONE.add_css("em", "font-size"), "<em style='font-size: 2em; position: fixed; font-size: expression(9)' id=e>big</em>", '<em style="font-size: 2em">big</em>'),
    ],
)
def test_clean(policy, html, want):
    assert clean(html, policy, out=FLAT) == want
    if not policy.enforced:
        assert is_valid(clean(html, policy), policy)


def test_policies_are_values():
    more = BASIC.add_tags("figure").remove_attributes("a", "href").remove_enforced("a", "rel")
    assert "figure" in more.tags and "figure" not in BASIC.tags and BASIC.enforced and not more.enforced
    assert is_valid("<ul><li>one <em>two</em></ul>", BASIC) and not is_valid("<ul><li>one <em id=q>two</em></ul>", BASIC) and not is_valid("<iframe></iframe>", BASIC)
    link = "<a href='../up?x=1'>up</a>"
    assert clean(link, BASIC, "https://site.example/a/b/c", FLAT) == '<a href="https://site.example/a/up?x=1" rel="nofollow">up</a>'
    assert clean(link, BASIC.preserve_relative_links(), "https://site.example/a/b/c", FLAT) == '<a href="../up?x=1" rel="nofollow">up</a>'
    assert safe_style("margin : 0 ; /* note */ background: url(b.png)", frozenset({"margin", "background"})) == "margin: 0"


CARD = '<article id="card"><h4>Tea</h4><ul id="kinds"><li>green</li><li>black <small>strong</small></li></ul></article>'


@pytest.mark.parametrize(
    ("edits", "want"),
    [
        ([("append", "#kinds", "<li>white"), ("prepend", "#kinds", "<li>any")], '<article id="card"><h4>Tea</h4><ul id="kinds"><li>any</li><li>green</li><li>black <small>strong</small></li><li>white</li></ul></article>'),
        ([("remove", "li:has(small)"), ("empty", "h4")], '<article id="card"><h4></h4><ul id="kinds"><li>green</li></ul></article>'),
        ([("wrap", "h4", "<header><hgroup></hgroup></header>"), ("remove", "ul")], '<article id="card"><header><hgroup><h4>Tea</h4></hgroup></header></article>'),
        ([("unwrap", "small"), ("unwrap", "#kinds"), ("remove", "h4")], '<article id="card"><li>green</li><li>black strong</li></article>'),
        ([("text", "li", "1 < 2"), ("remove", "h4")], '<article id="card"><ul id="kinds"><li>1 &lt; 2</li><li>1 &lt; 2</li></ul></article>'),
        ([("before", "h4", "<hr>"), ("after", "#kinds", "end"), ("remove", "li")], '<article id="card"><hr /><h4>Tea</h4><ul id="kinds"></ul>end</article>'),
        ([("tag_name", "small", "strong"), ("remove", "h4, li:first-child"), ("add_class", "strong", "hot"), ("toggle_class", "li", "last")], '<article id="card"><ul id="kinds"><li class="last">black <strong class="hot">strong</strong></li></ul></article>'),
        ([("insert_children", "#kinds", 1, "<li>mid</li>"), ("remove", "h4, small")], '<article id="card"><ul id="kinds"><li>green</li><li>mid</li><li>black </li></ul></article>'),
        ([("replace_with", "#kinds", "<p>sold out</p>")], '<article id="card"><h4>Tea</h4><p>sold out</p></article>'),
        ([("html", "h4", "<b>T<i>ea")], '<article id="card"><h4><b>T<i>ea</i></b></h4><ul id="kinds"><li>green</li><li>black <small>strong</small></li></ul></article>'),
        ([("val", "h4", "7"), ("attr", "ul", "lang", "en"), ("remove", "li")], '<article id="card"><h4 value="7">Tea</h4><ul id="kinds" lang="en"></ul></article>'),
    ],
)
def test_edits(edits, want):
    assert E.edited(CARD, edits, out=FLAT, inner=True) == want


@pytest.mark.parametrize("edits", [[("wrap", "li", "<b></b>"), ("unwrap", "small")], [("before", "li", "<i>x</i>"), ("after", "h4", "y")], [("replace_with", "h4", "<p>z</p>"), ("title", "", "T & t"), ("charset", "", "utf-8")]])
def test_edits_from_nodes_to_nodes(spark, edits):
    """Edits of parsed rows give what edits of texts give, with no text between; a row's own base URI resolves its links."""
    from tagweave.sources import change_documents, parse_html as parse_rows

    rows = [(1, f"<title>t</title>{CARD}", "http://a.example/x/", 5), (2, "<p><a href=q>l</a><script>1</script>", "http://b.example/y/", 6), (3, None, None, 7)]
    df = spark.createDataFrame(rows, "id long, html string, url string, _html int")
    parsed = parse_rows(df, base_col="url", drop_html=False)
    changed = change_documents(parsed, edits=edits)
    got = {r.id: (r.h, r._html) for r in changed.select("id", "_html", H.serialize(F.col("dom"), out=FLAT).alias("h")).collect()}
    assert got == {i: (E.edited(h, edits, u, "auto", FLAT) if h else None, x) for i, h, u, x in rows}
    assert changed.where("dom is null").count() == 1 and changed.select(F.size(local_select("li"))).columns
    clean_rows = change_documents(parsed, policy=BASIC)
    links = {r.id: r.h for r in clean_rows.select("id", H.serialize(F.col("dom"), out=FLAT).alias("h")).collect()}
    assert '<a href="http://b.example/y/q" rel="nofollow">' in links[2] and "script" not in links[2]
    own = {r.id: r.c for r in df.select("id", H.clean_html(F.col("html"), "basic", F.col("url"), FLAT).alias("c")).collect()}
    assert own[2] == '<p><a href="http://b.example/y/q" rel="nofollow">l</a></p>' and own[3] is None


def local_select(css):
    from tagweave.plans import local

    return local.select(F.col("dom"), css)


def test_same_html_entities_and_charsets(spark):
    from tagweave.sources import parse_html as parse_rows

    df = parse_rows(spark.createDataFrame([(1, "<p id=a class=b>x"), (2, "<p id='a' class='b'>x</p>"), (3, "<p class=b id=a>x")], "id long, html string"))
    a, b = df.select("id", "dom").alias("a"), df.select(F.col("id").alias("other"), F.col("dom").alias("too"))
    pairs = {(r.id, r.other): r.same for r in a.join(b, F.col("id") < F.col("other")).select("id", "other", H.same_html(F.col("dom"), F.col("too")).alias("same")).collect()}
    assert pairs == {(1, 2): True, (1, 3): False, (2, 3): False}
    hashes = [r.h for r in df.select(H.html_hash(F.col("dom")).alias("h")).orderBy("id").collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    names = spark.createDataFrame([("euro",), ("pound",), ("nGg",), ("nosuch",), (None,)], "n string")
    got = [tuple(r) for r in names.select(H.entity_text(F.col("n")), H.is_entity(F.col("n"), "base"), H.entity_codepoints(F.col("n"))).collect()]
    assert got == [("€", False, [0x20AC]), ("£", True, [0xA3]), ("⋙̸", False, [0x22D9, 0x338]), (None, False, None), (None, False, None)]
    chars = spark.createDataFrame([("£",), ("€",), ("x",)], "c string")
    assert [tuple(r) for r in chars.select(H.entity_name(F.col("c")), H.entity_name(F.col("c"), "extended"), H.can_encode(F.col("c"), "iso-8859-1")).collect()] == [("pound", "pound", True), (None, "euro", False), (None, None, True)]
    sets = spark.createDataFrame([("utf8",), ("latin1",), ("no-such",)], "c string")
    assert [r[0] for r in sets.select(H.mime_name(F.col("c"))).collect()] == ["UTF-8", "ISO-8859-1", None]


def test_document_edits():
    got = E.edited("<p>x", [("title", "", "T & t"), ("charset", "", "utf-8")], out=FLAT)
    assert got == '<html><head><title>T &amp; t</title><meta charset="UTF-8" /></head><body><p>x</p></body></html>'
    assert E.edited('<?xml version="1.0"?><a/>', [("charset", "", "iso-8859-1")]).startswith('<?xml version="1.0" encoding="ISO-8859-1"?>')
    for bad in ([("nope", "p")], [("remove", "p[")]):
        with pytest.raises(ValueError):
            E.check(bad)


def test_css_paths_find_their_nodes():
    from tagweave.operators.matching import select
    from tagweave.plans.selector import parse

    root = parse_html("<div class='a b'><p>1<p class=c>2<p class=c>3<ul><li>x<li>y</ul></div><div id=q><i></i></div>").root
    for n in root.walk():
        if n.kind == "element":
            assert select(root, parse(E.css_path(n))) == [n]


def test_column_functions(spark):
    df = spark.createDataFrame([(1, " a\xa0 b\n", "<p>x"), (2, None, None)], "id long, s string, html string")
    row = df.where("id = 1").select(H.normalise_whitespace(F.col("s")).alias("n"), H.is_blank(F.col("s")).alias("b"), H.clean_html(F.col("html"), "none").alias("c"), H.escape_for(F.lit("é")).alias("e"), H.resolve_url(F.lit("http://a/b"), F.lit("c")).alias("u"), H.css_selectors(F.col("html")).alias("p")).first()
    assert tuple(row) == (" a b ", False, "x", "&eacute;", "http://a/c", ["html", "html > head", "html > body", "html > body > p"])
    assert df.where("id = 2").select(H.clean_html(F.col("html"))).first()[0] is None


def test_sql_functions(spark):
    H.register(spark)
    assert spark.sql("SELECT html_clean_basic('<p onclick=x>a<script>b</script>') AS c, html_title('<title> A  b') AS t").first() == ("<p>a</p>", "A b")
    got = spark.sql("SELECT norm, attr_map['href'] AS href FROM html_nodes('<a href=x>y</a>') WHERE kind = 'element' ORDER BY pre").collect()
    assert [tuple(r) for r in got] == [("html", None), ("head", None), ("body", None), ("a", "x")]


def test_streaming(spark, tmp_path):
    from tagweave.sources import html_files, html_streams
    from tagweave.streaming import matches, windowed_counts

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.html").write_text("<a href=1>x</a><a>y</a>")
    (src / "2.html").write_text("<p>no links")
    assert html_files(spark, str(src)).count() == 2
    found = matches(html_streams(spark, str(src)), "a[href]", "path")
    q = found.select("path", F.col("n")["attr_map"]["href"].alias("href")).writeStream.format("memory").queryName("links").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.href for r in spark.table("links").collect()] == ["1"]
    (tmp_path / "js").mkdir()
    timed = spark.readStream.schema("ts timestamp, html string").json(str(tmp_path / "js"))
    (tmp_path / "js" / "a.json").write_text('{"ts":"2024-01-01T00:00:10Z","html":"<b>1</b><b>2</b>"}\n{"ts":"2024-01-01T00:02:00Z","html":"<b>3</b>"}\n')
    q = windowed_counts(timed, "b", "ts", "1 minute", "10 seconds").writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.matches for r in spark.table("counts").collect()) == [1, 2]
