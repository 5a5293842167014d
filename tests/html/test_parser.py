import random

import pytest

from tagweave.operators.flatten import Columns, from_structs
from tagweave.operators.serialize import Output, document_html, inner_html, outer_html
from tagweave.operators.textual import own_text, text_of
from tagweave.operators.tree import parse, parse_body_fragment, parse_fragment, parse_html, parse_xml
from tagweave.schema import OPTIONAL

FLAT = Output(pretty=False)


def body(html):
    root = parse_html(html).root.kids[-1]
    return inner_html(next(k for k in root.kids if k.norm in ("body", "frameset")), FLAT)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One<p>Two", "<p>One</p><p>Two</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p><b>x<br><p>y", "<p><b>x<br /></b></p><p><b>y</b></p>"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("<p><i>1<b>2</i>3</b>", "<p><i>1<b>2</b></i><b>3</b></p>"),
        ("<ul><li>1<li>2<ul><li>3</ul></ul>", "<ul><li>1</li><li>2<ul><li>3</li></ul></li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<table><td>1<tr><td>2</table>", "<table><tbody><tr><td>1</td></tr><tr><td>2</td></tr></tbody></table>"),
        ("<table><caption>c<col><tr><th>h", "<table><caption>c</caption><colgroup><col /></colgroup><tbody><tr><th>h</th></tr></tbody></table>"),
        ("<table><b>x</b><td>1", "<b>x</b><table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<table><tr><td><table><tr><td>in</table></table>", "<table><tbody><tr><td><table><tbody><tr><td>in</td></tr></tbody></table></td></tr></tbody></table>"),
        ("<select><option>1<option>2<div>x</select>y", "<select><option>1</option><option>2x</option></select>y"),
        ("<select><input>z", "<select></select><input />z"),
        ("a</p>b", "a<p></p>b"),
        ("x</br>y", "x<br />y"),
        ("<h1>a<h2>b", "<h1>a</h1><h2>b</h2>"),
        ("<div/>a<foo/>b", "<div></div>a<foo />b"),
        ("<textarea><p>t</textarea>", "<textarea><p>t</p></textarea>"),
        ("<p><script>a<b && '</p>'</script>x", "<p><script>a<b && '</p>'</script>x</p>"),
        ("<p a=1 A=2 b c=''>", '<p a="2" b c=""></p>'),
        ('<a href="?a=1&amp;b=2&copy=3&lt">x', '<a href="?a=1&amp;b=2&amp;copy=3&lt">x</a>'.replace("&lt", "<")),
        ("&copy;&copy &amp;&nope; &#65;&#x42 &#xD800;", "©© &amp;&amp;nope; AB �"),
        ("a<3 </ x>b<!-->c<!--d--!>e<?pi?>", "a&lt;3 <!-- x-->b<!---->c<!--d-->e<!--?pi?-->"),
        ("<![CDATA[x<y]]>z", "x&lt;yz"),
        ("<form id=1><form id=2>x</form>y</form>z", '<form id="1">x</form>yz'),
        ("<pre>\n x</pre>", "<pre>\n x</pre>"),
        ("<ruby>a<rt>b<rt>c</ruby>", "<ruby>a<rt>b</rt><rt>c</rt></ruby>"),
    ],
)
def test_bodies(html, want):
    assert body(html) == want


def test_documents():
    doc = parse_html("<!DOCTYPE html><title>a & b</title><html lang=x><p>t<html lang=y dir=z>")
    assert document_html(doc, FLAT) == '<!doctype html><html lang="x" dir="z"><head><title>a &amp; b</title></head><body><p>t</p></body></html>'
    assert parse_html("<!DOCTYPE>").quirks == "quirks"
    assert document_html(parse_html("<frameset><frame src=a></frameset>"), FLAT) == '<html><head></head><frameset><frame src="a" /></frameset></html>'
    assert parse_html("<base href='/x/'><base href='/y/'>", "http://h/a/b").base_uri == "http://h/x/"
    assert document_html(parse_html("<title>One<p>two"), FLAT) == "<html><head><title>One</title></head><body><p>two</p></body></html>"


def test_xml_keeps_case_and_implies_nothing():
    doc = parse('<?xml version="1.0"?><!DOCTYPE Note SYSTEM "n.dtd"><Note Id="1"><To>a</to>b</To><x/></Note>')
    assert doc.syntax == "xml"
    assert document_html(doc, Output(pretty=False, syntax="xml")) == '<?xml version="1.0"?><!DOCTYPE Note SYSTEM "n.dtd"><Note Id="1"><To>ab</To><x /></Note>'
    assert len(parse_xml("<a/><b/>").root.kids) == 2


def test_fragments():
    assert [n.norm for n in parse_fragment("<td>x", "tr")] == ["td"]
    assert [n.kind for n in parse_fragment("<td>x", "body")] == ["text"]
    assert outer_html(parse_body_fragment("<p>x").root, FLAT) == "<html><head></head><body><p>x</p></body></html>"


def test_text():
    root = parse_html("<p>One <b>two</b><br>three<div>four&nbsp; five</div>six<pre> a  b </pre>").root
    assert text_of(root) == "One two three four fivesix  a  b"
    p = next(n for n in root.walk() if n.norm == "p")
    assert own_text(p) == "One three" and text_of(p) == "One two three"


def test_pretty_printing():
    html = "<div><p>a <b>b</b></p><ul><li>x</li></ul></div>"
    assert body_pretty(html) == "<div>\n <p>a <b>b</b></p>\n <ul>\n  <li>x</li>\n </ul>\n</div>"


def body_pretty(html):
    return inner_html(parse_html(html).root.kids[0].kids[1])


def test_any_prefix_parses_and_comes_back():
    page = '<!DOCTYPE html><html><head><title>a&amp</title><script>"</p>"</script></head><body a=\'1\'><table><b>x<tr><td>&copy<p><i>b</table><!-- c --><select><option></body>'
    rng = random.Random(1)
    for n in range(len(page)):
        parse_html(page[:n])
        once = document_html(parse_html(page[:n] + rng.choice("<>&\"'=/ x")), FLAT)
        assert document_html(parse_html(once), FLAT) is not None
    deep = "<div>" * 5000 + "x"
    assert document_html(parse_html(deep), FLAT).count("</div>") == 5000
    assert len(list(parse_html(deep).root.walk())) == 5005


def test_structs_and_back():
    doc = parse_html("<!doctype html><ul class='A b'><li id=x>1<li>2</ul><form><input name=q></form><!--c-->")
    c = Columns(frozenset(OPTIONAL))
    c.add(doc)
    rows = c.array()[0].as_py()
    by_norm = {r["norm"]: r for r in rows}
    assert by_norm["ul"]["classes_lc"] == ["a", "b"] and by_norm["ul"]["last"] == by_norm["ul"]["pre"] + 4
    lis = [r for r in rows if r["norm"] == "li"]
    assert [(r["el_idx"], r["el_idx_last"], r["type_idx"], r["n_siblings"]) for r in lis] == [(0, 1, 1, 2), (1, 0, 2, 2)]
    assert lis[1]["prev"] == lis[0]["pre"] and lis[0]["prev"] is None
    assert by_norm["input"]["form_owner"] == by_norm["form"]["pre"]
    assert lis[0]["anc"][:2] == [by_norm["ul"]["pre"], by_norm["body"]["pre"]]
    posts = [r["post"] for r in rows]
    assert sorted(posts) == list(range(len(rows))) and posts[0] == len(rows) - 1
    assert document_html(from_structs(rows)) == document_html(doc)


def test_texts_of_one_walk_are_those_of_each_node():
    from tagweave.operators.textual import all_texts, has_text

    rng = random.Random(7)
    parts = ["<p>", "</p>", "<b>", "</b>", " a ", "b", "\n", "&nbsp;", "<br>", "<div> ", "</div>", "<pre>  x </pre>", "<textarea> y</textarea>", "<ul><li>", "<!-- c -->", "<script>s</script>"]
    for _ in range(300):
        root = parse_html("".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))).root
        found = all_texts(root)
        for n in root.walk():
            if n.kind in ("element", "document"):
                assert found[id(n)] == (text_of(n), has_text(n))
