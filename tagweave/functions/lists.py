"""Lists of nodes, as ordered sets by their numbers, and lists of attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.local import condition, is_element, select
from ..plans.selector import parse

# -- nodes -------------------------------------------------------------------


def numbers(els: Column) -> Column:
    return F.transform(els, lambda n: n["pre"])


def nodes(dom: Column, pres: Column) -> Column:
    return F.transform(pres, lambda i: F.get(dom, i))


def select_from(dom: Column, els: Column, selector: str) -> Column:
    """What a selector finds below and in each of els, each node once: in the order of els, then of the document."""
    return nodes(dom, F.array_distinct(F.flatten(F.transform(els, lambda e: numbers(select(dom, selector, e["pre"]))))))


def any_matches(dom: Column, els: Column, selector: str) -> Column:
    ast = parse(selector)
    return F.exists(els, lambda n: is_element(n) & condition(ast, n, dom))


def eq(els: Column, i: int) -> Column:
    """A list of the i-th, empty if there is none."""
    return F.slice(els, i + 1, 1)


def first(els: Column) -> Column:
    return F.get(els, F.lit(0))


def last(els: Column) -> Column:
    return F.get(els, F.size(els) - 1)


def union(dom: Column, a: Column, b: Column) -> Column:
    return nodes(dom, F.array_union(numbers(a), numbers(b)))


def difference(dom: Column, a: Column, b: Column) -> Column:
    return nodes(dom, F.array_except(numbers(a), numbers(b)))


def intersects(a: Column, b: Column) -> Column:
    return F.arrays_overlap(numbers(a), numbers(b))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(numbers(a), numbers(b))) == 0


def same(a: Column, b: Column) -> Column:
    return numbers(a) == numbers(b)


def any_attr(els: Column, key: str) -> Column:
    return F.exists(els, lambda n: F.map_contains_key(n["attr_map"], key.lower()))


def any_class(els: Column, name: str) -> Column:
    return F.exists(els, lambda n: F.array_contains(n["classes_lc"], name.lower()))


def any_text(els: Column) -> Column:
    return F.exists(els, lambda n: n["has_text"])


def forms(els: Column) -> Column:
    return F.filter(els, lambda n: n["norm"] == "form")


def raw_text(dom: Column, n: Column) -> Column:
    """Text of the subtree as it stands."""
    below = F.slice(dom, n["pre"] + 1, n["last"] - n["pre"] + 1)
    return F.array_join(F.transform(F.filter(below, lambda m: m["kind"] == "text"), lambda m: m["content"]), "")


# -- siblings ------------------------------------------------------------------


def first_sibling(dom: Column, n: Column) -> Column:
    """Null for an only child."""
    return F.when(n["n_siblings"] > 1, first(F.filter(dom, lambda m: (m["parent"] == n["parent"]) & (m["el_idx"] == 0))))


def last_sibling(dom: Column, n: Column) -> Column:
    return F.when(n["n_siblings"] > 1, first(F.filter(dom, lambda m: (m["parent"] == n["parent"]) & (m["el_idx_last"] == 0))))


def next_node(dom: Column, n: Column) -> Column:
    """The next sibling of any kind."""
    after = F.get(dom, n["last"] + 1)
    return F.when(after["parent"] == n["parent"], after)


def previous_node(dom: Column, n: Column) -> Column:
    return first(F.filter(dom, lambda m: (m["parent"] == n["parent"]) & (m["sib"] == n["sib"] - 1)))


def traversal(dom: Column) -> Column:
    """array<struct<pre,depth,tail>>: nodes as they are entered and left."""
    entered = F.transform(dom, lambda n: F.struct((n["pre"] + n["pre"] - n["depth"]).alias("at"), n["pre"].alias("pre"), n["depth"].alias("depth"), F.lit(False).alias("tail")))
    # A node is left after all nodes up to its last have been entered, and all but its ancestors left.
    left = F.transform(dom, lambda n: F.struct((n["last"] + 1 + n["post"]).alias("at"), n["pre"].alias("pre"), n["depth"].alias("depth"), F.lit(True).alias("tail")))
    return F.transform(F.array_sort(F.concat(entered, left)), lambda s: F.struct(s["pre"].alias("pre"), s["depth"].alias("depth"), s["tail"].alias("tail")))


# -- attributes: array<struct<k,v,b>> in order -----------------------------------


def _entry(key: Column, value: Column, bare: Column) -> Column:
    return F.struct(key.alias("k"), value.alias("v"), bare.alias("b"))


def put(attrs: Column, key: str, value: Column | None) -> Column:
    """Sets a value, or a bare attribute; a key keeps its place, a new one comes last."""
    entry = _entry(F.lit(key), value if value is not None else F.lit(""), F.lit(value is None))
    changed = F.transform(attrs, lambda a: F.when(a["k"] == key, entry).otherwise(_entry(a["k"], a["v"], a["b"])))
    return F.when(F.exists(attrs, lambda a: a["k"] == key), changed).otherwise(F.concat(changed, F.array(entry)))


def drop(attrs: Column, *keys: str, ignore_case: bool = False) -> Column:
    name = (lambda a: F.lower(a["k"])) if ignore_case else (lambda a: a["k"])
    gone = [k.lower() if ignore_case else k for k in keys]
    return F.filter(attrs, lambda a: ~name(a).isin(gone))


def rewrite(attrs: Column, keep: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """One pass that drops attributes and changes the values of the others."""
    return F.transform(F.filter(attrs, keep), lambda a: _entry(a["k"], value(a), a["b"]))


def lower_keys(attrs: Column) -> Column:
    return F.transform(attrs, lambda a: _entry(F.lower(a["k"]), a["v"], a["b"]))


def get(attrs: Column, key: str, ignore_case: bool = False) -> Column:
    """'' where the key is absent."""
    name = (lambda a: F.lower(a["k"])) if ignore_case else (lambda a: a["k"])
    found = F.filter(attrs, lambda a: name(a) == (key.lower() if ignore_case else key))
    return F.coalesce(F.get(found, F.lit(0))["v"], F.lit(""))


def has(attrs: Column, key: str, ignore_case: bool = False) -> Column:
    name = (lambda a: F.lower(a["k"])) if ignore_case else (lambda a: a["k"])
    return F.exists(attrs, lambda a: name(a) == (key.lower() if ignore_case else key))


def as_html(attrs: Column) -> Column:
    """As they stand in a tag, base names, UTF-8."""
    from . import escape

    return F.array_join(F.transform(attrs, lambda a: F.when(a["b"], F.concat(F.lit(" "), a["k"])).otherwise(F.concat(F.lit(" "), a["k"], F.lit('="'), escape(a["v"], True), F.lit('"')))), "")
