"""Markup columns parsed into node arrays, once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.edits import apply, check
from ..operators.flatten import Columns, from_structs
from ..operators.many import read_many
from ..operators.sanitize import Policy, clean_document
from ..operators.tree import Document, parse
from ..plans.selector import columns as selector_columns
from ..plans.selector import fields as selector_fields
from ..plans.selector import necessary
from ..plans.selector import parse as parse_selector
from ..schema import NODE, OPTIONAL

#: Bytes of markup, and documents, whose nodes are gathered into one Arrow batch at most.
BATCH_BYTES, BATCH_ROWS = 500_000, 4096
#: Columns of the result, which replace others so named.
RESULT = ("dom", "base_uri", "quirks")


def fields_of(selectors: Iterable[str]) -> frozenset[str]:
    return frozenset().union(*(selector_fields(parse_selector(s)) for s in selectors))


def columns_of(selectors: Iterable[str]) -> frozenset[str]:
    return frozenset().union(*(selector_columns(parse_selector(s)) for s in selectors))


def prefilter(html: Column, selector: str) -> Column:
    """A necessary condition on raw text, so that the JVM drops rows before they reach a parser."""
    out = F.lit(True)
    for x in necessary(parse_selector(selector)):
        out = out & F.lower(html).contains(x)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt anew: a file of one row group is one task, and parsing is what costs. Many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df  # counted in the JVM: their names don't come here


def parse_html(df: DataFrame, html_col: str = "html", *, base_col: str | None = None, mode: str = "auto", fields: Iterable[str] = OPTIONAL, selectors: Iterable[str] = (), drop_html: bool = True, keep_tag_case: bool | None = None, keep_attr_case: bool | None = None, nodes: Iterable[str] | None = None) -> DataFrame:
    """df with dom, base_uri and quirks in place of any columns so named.

    The parser stands behind mapInArrow, so filters above it never make it run
    twice. mode: auto, html, xml, fragment, xml_fragment, fragment:<tag>.
    fields: optional node fields to fill; with selectors only those they read,
    with nodes those among them, too.
    keep_tag_case, keep_attr_case: in every mode; by default False, for XML True.
    nodes: of the node struct, these fields and what the selectors read; by default all.
    A null text has a null dom; binary columns are read as UTF-8; other columns
    may have any name.
    """
    options = {"keep_tag_case": keep_tag_case, "keep_attr_case": keep_attr_case}
    base = F.coalesce(whole_name(base_col), F.lit("")) if base_col else F.lit("")

    def read(html: str | None, uri: str) -> Document | None:
        return None if html is None else parse(html, uri, mode, **options)

    kept = [c for c in df.columns if c.lower() not in RESULT and not (drop_html and c == html_col)]
    return with_documents(df, kept, [whole_name(html_col).cast("string"), base], read, fields, selectors, nodes, mode in ("auto", "html"))


def change_documents(df: DataFrame, *, edits: list[tuple] = (), policy: Policy | None = None, head_policy: Policy | None = None, fields: Iterable[str] = OPTIONAL, selectors: Iterable[str] = ()) -> DataFrame:
    """Parsed documents, edited and then cleaned, from nodes to nodes: no text between. df: what parse_html() gives.

    edits: as edit_html() takes them. policy: what stays of the body, in a new
    shell; head_policy: of the head, which is empty without one. Links are
    resolved with each row's own base_uri. A null dom stays null.
    """
    edits = check(list(edits))

    def change(nodes: list[dict] | None, uri: str) -> Document | None:
        if nodes is None:
            return None
        doc = apply(from_structs(nodes, uri or ""), edits)
        return clean_document(doc, policy, head_policy) if policy is not None else doc

    kept = [c for c in df.columns if c.lower() not in RESULT]
    return with_documents(df, kept, [structure(F.col("dom")), F.coalesce("base_uri", F.lit(""))], change, fields, selectors)


def with_documents(df: DataFrame, kept: list[str], inputs: list[Column], document: Callable[[object, str], Document | None], fields: Iterable[str], selectors: Iterable[str], nodes: Iterable[str] | None = None, plain: bool = False) -> DataFrame:
    """The kept columns with the documents that a function makes of each row's two inputs; plain: texts of plain markup need no tree."""
    chosen = None if nodes is None else {"pre", *nodes, *columns_of(selectors)}
    fields = fields_of(selectors) if selectors else frozenset(fields)
    if chosen is not None:
        fields = chosen & set(OPTIONAL)
    dom_type = T.ArrayType(T.StructType([f for f in NODE.fields if chosen is None or f.name in chosen]))
    names = [f"c{i}" for i in range(len(kept))]
    rows = df.select(*[whole_name(c).alias(x) for c, x in zip(kept, names)], *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*rows.schema.fields[: len(kept)], T.StructField("dom", dom_type), T.StructField("base_uri", T.StringType()), T.StructField("quirks", T.StringType())])

    def read_each(texts: pa.Array, uris: pa.Array) -> tuple[pa.Array, list, list]:
        gathered, bases, quirks = Columns(fields, chosen), [], []
        for given, uri in zip(texts.to_pylist(), uris.to_pylist()):
            if plain and given is not None and gathered.add_text(given):
                bases.append(uri or "")
                quirks.append("no")
                continue
            doc = document(given, uri)
            gathered.add(doc)
            bases.append(doc.base_uri if doc else None)
            quirks.append(doc.quirks if doc else None)
        dom = gathered.array()
        missing = [b is None for b in bases]
        if any(missing):
            dom = pa.ListArray.from_arrays(dom.offsets, dom.values, mask=pa.array(missing))
        return dom, bases, quirks

    def work(batches):
        for batch in batches:
            step = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n = len(names)
                texts, uris = part.column(n), part.column(n + 1)
                done, at_once = read_many(texts.cast(pa.string()), fields, chosen) if plain else (None, np.zeros(len(part), bool))
                rest = np.flatnonzero(~at_once)
                if not len(rest):
                    dom, bases, quirks = done, uris.fill_null(""), ["no"] * len(part)
                else:
                    if done is not None:
                        texts, uris = texts.take(pa.array(rest)), uris.take(pa.array(rest))
                    dom, bases, quirks = read_each(texts, uris)
                    if done is not None:
                        order = np.empty(len(part), int)
                        order[at_once], order[rest] = np.arange(len(done)), len(done) + np.arange(len(rest))
                        order = pa.array(order)
                        dom = pa.concat_arrays([done, dom]).take(order)
                        bases = pa.concat_arrays([part.column(n + 1).filter(pa.array(at_once)).fill_null("").cast(pa.string()), pa.array(bases, pa.string())]).take(order)
                        quirks = pa.concat_arrays([pa.array(["no"] * len(done), pa.string()), pa.array(quirks, pa.string())]).take(order)
                del done  # what it holds need not stand beside the next one's
                yield pa.record_batch([*part.columns[:n], dom, pa.array(bases, pa.string()), pa.array(quirks, pa.string())], [*names, "dom", "base_uri", "quirks"])

    return rows.mapInArrow(work, schema).toDF(*kept, "dom", "base_uri", "quirks")


def structure(dom: Column) -> Column:
    """The fields that a tree is built from again."""
    return F.transform(dom, lambda n: F.struct(*[n[x].alias(x) for x in ("pre", "parent", "kind", "name", "attrs", "content")]))


def whole_name(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def node_table(parsed: DataFrame, *keys: str) -> DataFrame:
    """A row for each node of parsed documents, with the documents' keys."""
    return parsed.select(*keys, F.inline("dom"))
