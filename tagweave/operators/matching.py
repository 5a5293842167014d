"""Selectors against trees, for edits inside a worker."""

from __future__ import annotations

import re

from .textual import data_of, own_text, text_of
from .tree import Node


def elements(node: Node) -> list[Node]:
    return [k for k in node.kids if k.kind == "element"]


def siblings(n: Node) -> list[Node]:
    return elements(n.parent) if n.parent is not None else [n]


def lower(n: Node) -> dict[str, str]:
    return {k.lower(): v or "" for k, v in n.attrs.items()}


def matches(ast: tuple, n: Node, root: Node) -> bool:
    kind, *args = ast
    if kind == "and":
        return all(matches(p, n, root) for p in args[0])
    if kind == "or":
        return any(matches(p, n, root) for p in args[0])
    if kind == "scope":
        return n is root
    if n.kind != "element":
        return False
    if kind == "not":
        return not matches(args[0], n, root)
    if kind == "has":
        return any(m is not n and matches(args[0], m, root) for m in n.walk())
    if kind == "child":
        return n is not root and n.parent is not None and matches(args[0], n.parent, root)
    if kind == "within":
        up = n
        while up is not root and up.parent is not None:
            up = up.parent
            if matches(args[0], up, root):
                return True
        return False
    if kind in ("after", "later"):
        if n is root:
            return False
        row = siblings(n)
        before = row[: next(i for i, s in enumerate(row) if s is n)]
        return any(matches(args[0], s, root) for s in (before[-1:] if kind == "after" else before))
    if kind == "all":
        return True
    if kind == "tag":
        return n.norm == args[0]
    if kind == "tag_ends":
        return n.norm == args[0] or n.name.endswith(":" + args[0])
    attrs = lower(n)
    if kind == "id":
        return attrs.get("id") == args[0]
    if kind == "class":
        return args[0] in attrs.get("class", "").lower().split()
    if kind == "attr":
        return args[0] in attrs
    if kind == "attr_starting":
        return any(k.startswith(args[0]) for k in attrs)
    if kind == "attr_value":
        key, op, value = args
        have = attrs.get(key)
        if op == "!=":
            return have is None or have.lower() != value
        if have is None or not value:
            return False
        have = have.lower()
        return {"=": have.strip() == value, "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have}[op]
    if kind == "attr_matches":
        return args[0] in attrs and found(args[1], attrs[args[0]])
    if kind == "contains":
        return args[0] in text_of(n).lower()
    if kind == "contains_own":
        return args[0] in own_text(n).lower()
    if kind == "contains_data":
        return args[0] in data_of(n).lower()
    if kind == "matches":
        return found(args[0], text_of(n))
    if kind == "matches_own":
        return found(args[0], own_text(n))
    if kind == "empty":
        return not any(k.kind in ("text", "data", "element") for k in n.kids)
    if kind == "root":
        return n is (next(iter(elements(root)), None) if root.kind == "document" else root)
    row = siblings(n)
    i = next(i for i, s in enumerate(row) if s is n)
    if kind == "index":
        op, k = args
        return {"lt": i < k, "gt": i > k, "eq": i == k}[op]
    if n.parent is None or n.parent.kind == "document":
        return False
    same = [s for s in row if (s.name, s.closed) == (n.name, n.closed)]
    j = next(j for j, s in enumerate(same) if s is n)
    if kind == "first_child":
        return i == 0 and n is not root
    if kind == "last_child":
        return i == len(row) - 1 and n is not root
    if kind == "first_of_type":
        return j == 0
    if kind == "last_of_type":
        return j == len(same) - 1
    if kind == "only_child":
        return len(row) == 1
    if kind == "only_of_type":
        return len(same) == 1
    which, a, b = args
    pos = {"child": i + 1, "last_child": len(row) - i, "of_type": j + 1, "last_of_type": len(same) - j}[which]
    return pos == b if a == 0 else (pos - b) * a >= 0 and (pos - b) % a == 0


def found(pattern: str, text: str) -> bool:
    try:
        return re.search(pattern, text) is not None
    except re.error:
        return False


def select(root: Node, ast: tuple) -> list[Node]:
    return [n for n in root.walk() if n.kind == "element" and matches(ast, n, root)]
