"""Selectors as Columns over one document's node array: no shuffle, no Python."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .selector import NTH_READ, cost, parse

#: Past every number of a node.
NONE = 2**31 - 1


def is_element(n: Column) -> Column:
    return n["kind"] == "element"


def attr(n: Column, key: str) -> Column:
    """An attribute's value, null where it is absent. Selectors with abs: keys aren't parsed: see functions.abs_url."""
    return n["attr_map"][key]


def java_regex(pattern: str) -> str | None:
    """None for a pattern that no engine takes."""
    try:
        re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern).replace("++", "+").replace("*+", "*"))
    except re.error:
        return None
    return pattern


def leaf(ast: tuple, n: Column, scope: Column | None = None) -> Column | None:
    """A condition on a node alone; None if it takes others."""
    kind, *args = ast
    in_element = n["parent"] > 0  # the parent is an element, not the document
    not_scope = n["pre"] != (scope if scope is not None else F.lit(0))
    if kind == "all":
        return F.lit(True)
    if kind == "tag":
        return n["norm"] == args[0]
    if kind == "tag_ends":
        return (n["norm"] == args[0]) | n["name"].endswith(":" + args[0])
    if kind == "id":
        return n["id_attr"] == args[0]
    if kind == "class":
        return F.array_contains(n["classes_lc"], args[0])
    if kind == "attr":
        return F.map_contains_key(n["attr_map"], args[0])
    if kind == "attr_starting":
        return F.exists(F.map_keys(n["attr_map"]), lambda k: k.startswith(args[0]))
    if kind == "attr_value":
        key, op, value = args
        raw = F.lower(attr(n, key))
        if op == "=":
            return (F.trim(raw) == value) if value else F.lit(False)
        if op == "!=":
            return F.coalesce(raw != value, F.lit(True))
        if not value:
            return F.lit(False)
        return {"^=": raw.startswith, "$=": raw.endswith, "*=": raw.contains}[op](value)
    if kind == "attr_matches":
        pattern = java_regex(args[1])
        return attr(n, args[0]).rlike(pattern) if pattern is not None else F.lit(False)
    if kind == "index":
        op, i = args
        return {"lt": n["el_idx"] < i, "gt": n["el_idx"] > i, "eq": n["el_idx"] == i}[op]
    if kind == "first_child":
        return in_element & (n["el_idx"] == 0) & not_scope
    if kind == "last_child":
        return in_element & (n["el_idx_last"] == 0) & not_scope
    if kind == "first_of_type":
        return in_element & (n["type_idx"] == 1)
    if kind == "last_of_type":
        return in_element & (n["type_idx_last"] == 1)
    if kind == "only_child":
        return in_element & (n["n_siblings"] == 1)
    if kind == "only_of_type":
        return in_element & (n["n_same_type"] == 1)
    if kind == "nth":
        which, a, b = args
        pos = n[NTH_READ[which]] + (1 if which.endswith("child") else 0)
        return in_element & ((pos == b) if a == 0 else (((pos - b) * a >= 0) & ((pos - b) % a == 0)))
    if kind == "empty":
        return n["n_content"] == 0
    if kind == "contains":
        return F.lower(n["text"]).contains(args[0])
    if kind == "contains_own":
        return F.lower(n["own_text"]).contains(args[0])
    if kind == "contains_data":
        return F.lower(n["data"]).contains(args[0])
    if kind in ("matches", "matches_own"):
        pattern = java_regex(args[0])
        return n["text" if kind == "matches" else "own_text"].rlike(pattern) if pattern is not None else F.lit(False)
    if kind == "scope":
        return n["pre"] == (scope if scope is not None else F.lit(0))
    return None


def condition(ast: tuple, n: Column, dom: Column, scope: Column | None = None, firsts: dict[tuple, Column] | None = None) -> Column:
    """Whether node n of dom matches; scope: the pre of the query's root, by default the document's. firsts: see first_children()."""
    root = scope if scope is not None else F.lit(0)
    alone = leaf(ast, n, scope)
    if alone is not None:
        return F.coalesce(alone, F.lit(False))
    kind, *args = ast
    if kind in ("and", "or"):
        parts = sorted(args[0], key=cost) if kind == "and" else args[0]
        out = condition(parts[0], n, dom, scope, firsts)
        for p in parts[1:]:
            c = condition(p, n, dom, scope, firsts)
            out = out & c if kind == "and" else out | c
        return out
    if kind == "not":
        return ~condition(args[0], n, dom, scope, firsts)
    if kind == "root":
        return F.when(root == 0, (n["parent"] == 0) & (n["el_idx"] == 0)).otherwise(n["pre"] == root)
    below = n["pre"] > root  # the query's root has neither parent nor siblings in it
    test = lambda m: element_or_root(args[0], m, dom, scope, firsts)
    if kind == "child":
        return below & F.coalesce(test(F.get(dom, n["parent"])), F.lit(False))
    if kind == "within":
        return below & F.exists(F.coalesce(n["anc"], F.array().cast("array<int>")), lambda i: (i >= root) & F.coalesce(test(F.get(dom, i)), F.lit(False)))
    if kind == "after":
        return below & F.coalesce(test(F.get(dom, n["prev"])), F.lit(False))
    if kind == "later" and firsts and ast in firsts:
        return below & (n["el_idx"] > 0) & F.coalesce(F.get(firsts[ast], n["parent"]) < n["pre"], F.lit(False))
    if kind == "later":
        before = F.slice(dom, n["parent"] + 2, F.greatest(n["pre"] - n["parent"] - 1, F.lit(0)))
        return below & (n["el_idx"] > 0) & F.exists(before, lambda m: (m["parent"] == n["parent"]) & test(m))
    if kind == "has":
        inside = F.slice(dom, n["pre"] + 2, F.greatest(n["last"] - n["pre"], F.lit(0)))
        return F.exists(inside, lambda m: test(m))
    raise AssertionError(ast)


def element_or_root(ast: tuple, n: Column, dom: Column, scope: Column | None, firsts: dict[tuple, Column] | None = None) -> Column:
    """Ancestors include the document, which only the query's root stands for."""
    ok = condition(ast, n, dom, scope, firsts)
    return (is_element(n) & ok) if ast[0] != "scope" else ok


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_children(ast: tuple, dom: Column, scope: Column | None, firsts: dict[tuple, Column]) -> Column:
    """array<int>: for each node of dom the first child that a condition holds for, by number; a large number if there is none."""
    hits = F.filter(dom, lambda m: (m["parent"] >= 0) & F.coalesce(element_or_root(ast, m, dom, scope, firsts), F.lit(False)))
    pairs = F.transform(hits, lambda m: F.struct(m["parent"].alias("k"), m["pre"].alias("v")))
    none = F.transform(dom, lambda m: F.struct(m["pre"].alias("k"), F.lit(NONE).alias("v")))
    heads = lambda rows: F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["k"] != x["k"]))
    return bound(F.sort_array(F.concat(none, pairs)), lambda rows: F.transform(heads(rows), lambda x: x["v"]))


def laters(ast: tuple) -> list[tuple]:
    """The parts of a selector that ask for earlier siblings, inner ones first."""
    inner = [y for x in ast[1:] if isinstance(x, tuple) for y in (x if x and isinstance(x[0], tuple) else (x,))]
    return list(dict.fromkeys([z for y in inner for z in laters(y)] + ([ast] if ast[0] == "later" else [])))


def select(dom: Column, selector: str, scope: Column | None = None) -> Column:
    """The matching elements of a node array in document order; scope: the pre of the element selected from, itself included."""
    ast = parse(selector)

    def found(todo: list[tuple], firsts: dict[tuple, Column]) -> Column:
        if todo:
            return bound(first_children(todo[0][1], dom, scope, firsts), lambda c: found(todo[1:], {**firsts, todo[0]: c}))

        def keep(n: Column) -> Column:
            ok = is_element(n) & condition(ast, n, dom, scope, firsts)
            return ok if scope is None else (n["pre"] >= scope) & (n["pre"] <= F.get(dom, scope)["last"]) & ok

        return F.filter(dom, keep)

    return found(laters(ast), {})
