"""Column functions over nodes, attributes, text, URLs and entities.

What is only a projection stays in the JVM; parsing, serialising, sanitising,
editing and URL resolution are Arrow UDFs over whole columns.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators.flatten import from_structs
from ..operators.sanitize import POLICIES, Policy, clean, is_valid
from ..operators.serialize import Output, document_html, inner_html, outer_html
from ..operators.serialize import escape as escape_text
from ..operators.tags import ALL_ENTITIES, BASE_ENTITIES, names_by_character
from ..operators.tokens import decode
from ..plans.local import condition, select
from ..plans.selector import parse as parse_selector
from ..sources.html import structure
from .urls import resolve

ENTITIES = {"base": BASE_ENTITIES, "extended": ALL_ENTITIES}
WHITE = "[\\t\\n\\r\\f \\u00a0]+"

# -- text ------------------------------------------------------------------


def normalise_whitespace(s: Column) -> Column:
    return F.regexp_replace(s, WHITE, " ")


def is_blank(s: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(s, "[\\t\\n\\r\\f]", " ")) == "", F.lit(True))


def is_numeric(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9]+$"), F.lit(False))


def padding(width: int) -> Column:
    return F.repeat(F.lit(" "), F.lit(width))


def join(items: Column, separator: str) -> Column:
    return F.array_join(items, separator)


# -- entities ----------------------------------------------------------------


def escape(s: Column, in_attribute: bool = False) -> Column:
    """Base names, UTF-8: no UDF."""
    out = F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("\xa0"), F.lit("&nbsp;"))
    if in_attribute:
        return F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def text_udf(f: Callable[[str], object], returns: str = "string") -> Callable[[Column], Column]:
    """An Arrow UDF of a function of one text; nulls stay."""

    @F.pandas_udf(returns)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return apply


def escape_for(s: Column, mode: str = "base", charset: str = "ascii") -> Column:
    out = Output(escape_mode=mode, charset=charset)
    return text_udf(lambda x: escape_text(x, out))(s)


def unescape(s: Column, strict: bool = False) -> Column:
    """Character references decoded; strict: as in attributes. Texts without & are left to the JVM."""
    return F.when(s.contains("&"), text_udf(lambda x: decode(x, strict))(s)).otherwise(s)


def entity_text(name: Column, mode: str = "extended") -> Column:
    """What a name without & and ; stands for, as text of one or two characters; null if mode (base or extended) has no such name."""
    table = ENTITIES[mode]

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(table.get, na_action="ignore").astype(object)

    return apply(name)


def is_entity(name: Column, mode: str = "extended") -> Column:
    return F.coalesce(entity_text(name, mode).isNotNull(), F.lit(False))


def entity_codepoints(name: Column, mode: str = "extended") -> Column:
    """array<int>, null for an unknown name."""
    return F.transform(F.split(entity_text(name, mode), ""), lambda c: F.ascii(c))


def entity_name(character: Column, mode: str = "base") -> Column:
    """The name that escaping in a mode gives a character, null if none."""
    table = names_by_character(mode)

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(table.get, na_action="ignore").astype(object)

    return apply(character)


# -- charsets ------------------------------------------------------------------


def mime_name(charset: Column) -> Column:
    """A charset's preferred name, null if unknown."""

    def of(name: str) -> str | None:
        import email.charset

        try:
            known = codecs.lookup(name.strip()).name
        except (LookupError, ValueError):
            return None
        return email.charset.ALIASES.get(known, known).upper().replace("ISO8859", "ISO-8859")

    return text_udf(of)(charset)


def can_encode(s: Column, charset: str) -> Column:
    """Whether a charset has all of a text's characters."""
    codecs.lookup(charset)

    def of(text: str) -> bool:
        try:
            text.encode(charset)
        except UnicodeEncodeError:
            return False
        return True

    return text_udf(of, "boolean")(s)


# -- URLs --------------------------------------------------------------------


def resolve_url(base: Column, relative: Column) -> Column:
    @F.pandas_udf("string")
    def apply(b: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([resolve(x, y) if y is not None else None for x, y in zip(b, r)], dtype=object)

    return apply(base, relative)


# -- nodes -------------------------------------------------------------------


def attr(n: Column, key: str) -> Column:
    """'' where the attribute is absent. abs: keys raise: abs_url takes the base URI that they need."""
    return F.coalesce(n["attr_map"][plain(key)], F.lit(""))


def has_attr(n: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(n["attr_map"], plain(key)), F.lit(False))


def plain(key: str) -> str:
    key = key.lower()
    if key.startswith("abs:"):
        raise ValueError(f"{key!r} needs a base URI: take abs_url")
    return key


def abs_url(n: Column, base_uri: Column, key: str) -> Column:
    return F.when(has_attr(n, key), resolve_url(base_uri, attr(n, key))).otherwise(F.lit(""))


def dataset(n: Column) -> Column:
    """data-* attributes without the prefix."""
    return F.transform_keys(F.map_filter(n["attr_map"], lambda k, v: k.startswith("data-") & (F.length(k) > 5)), lambda k, v: F.substring(k, 6, 1 << 30))


def has_class(n: Column, name: str) -> Column:
    return F.array_contains(n["classes_lc"], name.lower())


def val(n: Column) -> Column:
    return F.when(n["norm"] == "textarea", n["text"]).otherwise(attr(n, "value"))


def matches(n: Column, dom: Column, selector: str) -> Column:
    return (n["kind"] == "element") & condition(parse_selector(selector), n, dom)


# -- axes ----------------------------------------------------------------------


def node(dom: Column, pre: Column) -> Column:
    return F.get(dom, pre)


def parent(dom: Column, n: Column) -> Column:
    return F.get(dom, n["parent"])


def parents(dom: Column, n: Column) -> Column:
    """Nearest first, without the document."""
    return F.transform(F.filter(n["anc"], lambda i: i > 0), lambda i: F.get(dom, i))


def child_nodes(dom: Column, n: Column, kind: str | None = None) -> Column:
    below = F.slice(dom, n["pre"] + 2, F.greatest(n["last"] - n["pre"], F.lit(0)))
    return F.filter(below, lambda m: (m["parent"] == n["pre"]) & ((m["kind"] == kind) if kind else F.lit(True)))


def children(dom: Column, n: Column) -> Column:
    return child_nodes(dom, n, "element")


def siblings(dom: Column, n: Column, elements: bool = True) -> Column:
    return F.filter(dom, lambda m: (m["parent"] == n["parent"]) & (m["pre"] != n["pre"]) & ((m["kind"] == "element") if elements else F.lit(True)))


def next_element(dom: Column, n: Column) -> Column:
    return F.get(F.filter(dom, lambda m: (m["parent"] == n["parent"]) & (m["el_idx"] == n["el_idx"] + 1)), F.lit(0))


def previous_element(dom: Column, n: Column) -> Column:
    return F.get(dom, n["prev"])


def subtree(dom: Column, n: Column) -> Column:
    return F.slice(dom, n["pre"] + 1, n["last"] - n["pre"] + 1)


def form_elements(dom: Column, form: Column) -> Column:
    return F.filter(dom, lambda m: m["form_owner"] == form["pre"])


def first_by_tag(dom: Column, tag: str) -> Column:
    return F.get(F.filter(dom, lambda m: (m["kind"] == "element") & (m["norm"] == tag)), F.lit(0))


def title(dom: Column) -> Column:
    return F.coalesce(F.trim(normalise_whitespace(first_by_tag(dom, "title")["text"])), F.lit(""))


# -- lists of elements -----------------------------------------------------------


def each_text(els: Column) -> Column:
    return F.transform(F.filter(els, lambda n: n["has_text"]), lambda n: n["text"])


def joined_text(els: Column) -> Column:
    """A space stands before a text only once something has been written."""
    return F.aggregate(els, F.lit(""), lambda acc, n: F.when(acc == "", n["text"]).otherwise(F.concat(acc, F.lit(" "), n["text"])))


def first_attr(els: Column, key: str) -> Column:
    return F.coalesce(attr(F.get(F.filter(els, lambda n: has_attr(n, key)), F.lit(0)), key), F.lit(""))


def except_matching(els: Column, dom: Column, selector: str) -> Column:
    return F.filter(els, lambda n: ~matches(n, dom, selector))


def all_parents(dom: Column, els: Column) -> Column:
    return F.transform(F.filter(F.array_distinct(F.flatten(F.transform(els, lambda n: n["anc"]))), lambda i: i > 0), lambda i: F.get(dom, i))


# -- whole documents ----------------------------------------------------------------


def serialize(dom: Column, pre: Column | None = None, out: Output = Output()) -> Column:
    """HTML of a document or, with pre, of one of its nodes."""

    @F.pandas_udf("string")
    def apply(doms: pd.Series, at: pd.Series) -> pd.Series:
        texts = []
        for d, p in zip(doms, at):
            if d is None:
                texts.append(None)
                continue
            doc = from_structs([dict(s) for s in d])
            texts.append(document_html(doc, out) if p <= 0 else outer_html(list(doc.root.walk())[int(p)], out))
        return pd.Series(texts, dtype=object)

    return apply(structure(dom), pre if pre is not None else F.lit(0))


def html_of(dom: Column, pres: Column, inner: bool = False, out: Output = Output()) -> Column:
    """array<string>: outer or inner HTML of the nodes with these numbers."""

    @F.pandas_udf("array<string>")
    def apply(doms: pd.Series, lists: pd.Series) -> pd.Series:
        texts = []
        for d, ps in zip(doms, lists):
            nodes = list(from_structs([dict(s) for s in d]).root.walk()) if d is not None else []
            texts.append([(inner_html if inner else outer_html)(nodes[int(p)], out) for p in ps] if d is not None and ps is not None else None)
        return pd.Series(texts, dtype=object)

    return apply(structure(dom), pres)


def css_selectors(html: Column, mode: str = "auto") -> Column:
    """array<string>: a path for each element in document order."""
    from ..operators.tree import parse

    return text_udf(lambda x: [E.css_path(n) for n in parse(x, "", mode).root.walk() if n.kind == "element"], "array<string>")(html)


def based_udf(f: Callable[[str, str], object], html: Column, base_uri: str | Column) -> Column:
    """An Arrow UDF of a text and a base URI, one for all rows or each row's own; null texts stay, null base URIs are empty."""
    if not isinstance(base_uri, Column):
        return text_udf(lambda x: f(x, base_uri))(html)

    @F.pandas_udf("string")
    def apply(s: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([f(x, b or "") if x is not None else None for x, b in zip(s, bases)], dtype=object)

    return apply(html, base_uri)


def clean_html(html: Column, policy: Policy | str = "basic", base_uri: str | Column = "", out: Output = Output()) -> Column:
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    return based_udf(lambda x, base: clean(x, policy, base, out), html, base_uri)


def is_valid_html(html: Column, policy: Policy | str = "basic") -> Column:
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    return text_udf(lambda x: is_valid(x, policy), "boolean")(html)


def edit_html(html: Column, edits: list[tuple], mode: str = "auto", base_uri: str | Column = "", out: Output | None = None, inner: bool = False) -> Column:
    edits = E.check(edits)
    return based_udf(lambda x, base: E.edited(x, edits, base, mode, out, inner), html, base_uri)


def same_html(a: Column, b: Column, out: Output = Output(pretty=False)) -> Column:
    """Whether two documents are written alike."""
    return serialize(a, out=out).eqNullSafe(serialize(b, out=out))


def html_hash(dom: Column, pre: Column | None = None) -> Column:
    """A digest of what a document, or one of its nodes, is written as."""
    return F.xxhash64(serialize(dom, pre, Output(pretty=False)))


def reformat_html(html: Column, mode: str = "auto", out: Output | None = None, inner: bool = False) -> Column:
    """Parsed and written again."""
    return edit_html(html, [], mode, "", out, inner)


def register(spark) -> None:
    """The functions of texts under SQL names, and html_nodes as a table function."""
    from pyspark.sql.functions import udtf

    from ..operators.flatten import Columns
    from ..operators.tree import parse
    from ..schema import NODE, OPTIONAL

    spark.udf.register("html_unescape", text_udf(decode))
    spark.udf.register("html_escape_ascii", text_udf(lambda x: escape_text(x, Output(charset="ascii"))))
    for name, policy in POLICIES.items():
        spark.udf.register(f"html_clean_{name}", text_udf(lambda x, p=policy: clean(x, p)))
        spark.udf.register(f"html_is_valid_{name}", text_udf(lambda x, p=policy: is_valid(x, p), "boolean"))
    spark.udf.register("html_reformat", text_udf(lambda x: E.edited(x, [])))
    spark.udf.register("html_title", text_udf(lambda x: E.title_of(parse(x))))

    @udtf(returnType=NODE)
    class HtmlNodes:
        def eval(self, html: str):
            if html is not None:
                c = Columns(frozenset(OPTIONAL))
                c.add(parse(html))
                for row in c.array()[0].as_py():
                    row["attr_map"] = dict(row["attr_map"] or [])
                    yield tuple(row[f.name] for f in NODE.fields)

    spark.udtf.register("html_nodes", HtmlNodes)


__all__ = [name for name in dir() if not name.startswith("_")]
