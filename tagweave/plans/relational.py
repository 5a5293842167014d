"""Selectors as windows over a table of nodes.

For documents whose node arrays are too large to search in one row. Rows carry
the document's key; one repartition by it serves every window, and every
combinator takes one pass over the rows, so that plans grow with a selector's
length and work with the rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .local import is_element, leaf
from .selector import cost, parse


#: Node fields that the windows read beside a selector's own.
READ = ("sib", "last")


class Marker:
    """Adds a boolean column for each part of a selector that other rows decide."""

    def __init__(self, nodes: DataFrame, key: str):
        # Texts and comments are no one's ancestors, siblings or matches, and needn't be moved.
        self.df, self.key, self.names = nodes.where(F.col("kind").isin("element", "document")).repartition(key), key, count()

    def node(self) -> dict[str, Column]:
        return {c: F.col(c) for c in self.df.columns}

    def keep(self, condition: Column) -> str:
        name = f"_m{next(self.names)}"
        self.df = self.df.withColumn(name, F.coalesce(condition, F.lit(False)))
        return name

    def mark(self, ast: tuple) -> Column:
        kind, *args = ast
        n = self.node()
        if kind == "root":
            return (n["parent"] == 0) & (n["el_idx"] == 0)
        alone = leaf(ast, n)
        if alone is not None:
            return F.coalesce(alone, F.lit(False)) & (F.lit(True) if kind == "scope" else is_element(n))
        if kind in ("and", "or"):
            parts = [self.mark(p) for p in (sorted(args[0], key=cost) if kind == "and" else args[0])]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if kind == "and" else out | p
            return out
        if kind == "not":
            return is_element(n) & ~self.mark(args[0])
        name = self.keep(self.mark(args[0]))
        if kind in ("after", "later"):
            # Ranked by siblings, without text nodes between them.
            row = Window.partitionBy(self.key, "parent", "kind").orderBy("sib")
            found = F.lag(name).over(row) if kind == "after" else F.max(name).over(row.rowsBetween(Window.unboundedPreceding, -1))
            return F.col(self.keep(is_element(n) & found))
        if kind == "child":
            # A marked row also stands, once more, among the rows whose parent it is.
            copy, group = f"_m{next(self.names)}", f"_m{next(self.names)}"
            twice = F.when(F.col(name), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
            rows = self.df.withColumn(copy, F.explode(twice)).withColumn(group, F.when(F.col(copy), F.col("pre")).otherwise(F.col("parent")))
            self.df = rows.withColumn(name, F.max(copy).over(Window.partitionBy(self.key, group))).where(~F.col(copy)).drop(copy, group)
            return is_element(n) & F.col(name)
        # Subtrees are [pre, last], nested or apart: the farthest end behind tells of ancestors, the nearest start ahead of descendants.
        order = F.col("pre") if kind == "within" else F.col("pre").desc()
        before = Window.partitionBy(self.key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        if kind == "within":
            found = F.max(F.when(F.col(name), F.col("last"))).over(before) >= F.col("pre")
        else:  # has
            found = F.min(F.when(F.col(name), F.col("pre"))).over(before) <= F.col("last")
        return F.col(self.keep(is_element(n) & found))


def select(nodes: DataFrame, selector: str, key: str) -> DataFrame:
    """The rows of elements that match, in any order: sort by key and pre for the documents'."""
    marker = Marker(nodes, key)
    hit = marker.keep(marker.mark(parse(selector)))
    return marker.df.where(F.col(hit) & is_element({c: F.col(c) for c in nodes.columns})).select(*nodes.columns)
