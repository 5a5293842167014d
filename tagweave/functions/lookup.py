"""Lookups by tag, id, class, attribute, position and text: elements of a node array in document order.

They are selectors without a text to parse; unlike a selector, a pattern that
no engine takes raises when the plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.local import condition, is_element


def where(dom: Column, test: Callable[[Column], Column]) -> Column:
    """The elements for which a condition of one's own holds."""
    return F.filter(dom, lambda n: is_element(n) & F.coalesce(test(n), F.lit(False)))


def _leaf(dom: Column, *ast) -> Column:
    return F.filter(dom, lambda n: is_element(n) & condition(tuple(ast), n, dom))


def _pattern(text: str) -> str:
    re.compile(text)
    return text


def by_tag(dom: Column, tag: str) -> Column:
    return _leaf(dom, "tag", tag.strip().lower())


def by_id(dom: Column, value: str) -> Column:
    """All elements with the id; ids are case-sensitive."""
    return _leaf(dom, "id", value.strip())


def first_by_id(dom: Column, value: str) -> Column:
    return F.get(by_id(dom, value), F.lit(0))


def by_class(dom: Column, name: str) -> Column:
    return _leaf(dom, "class", name.lower())


def by_attribute(dom: Column, key: str) -> Column:
    return _leaf(dom, "attr", key.strip().lower())


def by_attribute_starting(dom: Column, prefix: str) -> Column:
    return _leaf(dom, "attr_starting", prefix.strip().lower())


def by_attribute_value(dom: Column, key: str, value: str, how: str = "=") -> Column:
    """how: = equal, != not, ^= starting, $= ending, *= containing."""
    return _leaf(dom, "attr_value", key.strip().lower(), how, value.strip().lower())


def by_attribute_matching(dom: Column, key: str, pattern: str) -> Column:
    return _leaf(dom, "attr_matches", key.strip().lower(), _pattern(pattern))


def by_index(dom: Column, index: int, how: str = "eq") -> Column:
    """how: lt, gt or eq; places among sibling elements count from 0."""
    return _leaf(dom, "index", how, index)


def containing_text(dom: Column, text: str, own: bool = False) -> Column:
    return _leaf(dom, "contains_own" if own else "contains", text.lower())


def matching_text(dom: Column, pattern: str, own: bool = False) -> Column:
    return _leaf(dom, "matches_own" if own else "matches", _pattern(pattern))


def all_elements(dom: Column) -> Column:
    return F.filter(dom, is_element)
