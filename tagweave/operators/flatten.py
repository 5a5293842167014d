"""Trees as columns of node structs, and node structs as trees."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa

from ..schema import PA_ATTRIBUTE, PA_NODE
from .plain import attributes, read
from .tags import PRESERVE_SPACE, is_block
from .textual import RUN
from .tree import Document, Node

CONTENT = ("text", "data", "element")
WHITE = "\t\n\r\f "
#: Nodes whose attributes are told apart at once.
AT_ONCE = 1 << 14


class Columns:
    """Gathers the nodes of many documents: what each holds, and where it ends. The rest is computed for all of them at once.

    names: the fields of array(); by default all.
    """

    def __init__(self, fields: Iterable[str] = (), names: Iterable[str] | None = None):
        chosen = None if names is None else frozenset(names)
        self.types = [f for f in PA_NODE if chosen is None or f.name in chosen]
        self.fields = frozenset(fields) & {f.name for f in self.types}
        self.offsets = [0]
        self.parent, self.last, self.tag = array("i"), array("i"), array("i")  # numbers within the document; a place in tags
        self.tags: list[tuple[str, str, str, bool]] = []  # (kind, name, norm, closed)
        self.codes: dict[tuple[str, str, bool], int] = {}
        self.plain: dict[str, int] = {}  # tags of plain documents by name
        self.contents: list[str] = []  # of nodes that are neither elements nor documents, in order
        self.attrs_at, self.attrs, self.lower = array("i"), [], []  # of nodes that have some; with lower-case keys and no nulls; of plain markup as written
        self.forms_at, self.forms = array("i"), array("i")
        self.texts: list[str | None] = []
        self.own: list[str | None] = []
        self.data: list[str | None] = []
        self.inked: list[bool | None] = []

    def add(self, doc: Document | None) -> None:
        if doc is not None:
            contents = len(self.contents)
            self.walk(doc.root)
            self.textual(contents)
        self.offsets.append(len(self.parent))

    def add_text(self, html: str) -> bool:
        """Adds a document if it is plain markup: see plain.py."""
        doc = read(html)
        if doc is None:
            return False
        base, contents = len(self.parent), len(self.contents)
        self.parent.extend(doc.parent)
        self.last.extend(doc.last)
        try:
            self.tag.extend([self.plain[name] for name in doc.names])
        except KeyError:
            for name in set(doc.names) - set(self.plain):
                self.plain[name] = self.code("document" if name == "#root" else "element" if name else "text", name)
            self.tag.extend([self.plain[name] for name in doc.names])
        self.contents += doc.contents
        if doc.attrs:
            self.attrs_at.extend([base + i for i in doc.attrs_at])
            self.attrs += doc.attrs
            self.lower += doc.attrs
        for i, form in doc.forms:
            self.forms_at.append(base + i)
            self.forms.append(form)
        self.textual(contents)
        self.offsets.append(len(self.parent))
        return True

    def code(self, kind: str, name: str, closed: bool = False) -> int:
        found = self.codes.get((kind, name, closed))
        if found is None:
            found = self.codes[kind, name, closed] = len(self.tags)
            self.tags.append((kind, name, name.lower(), closed))
        return found

    def walk(self, root: Node) -> None:
        base = len(self.parent)
        pre_of: dict[int, int] = {}
        owned: list[tuple[int, Node]] = []
        todo: list = [(root, -1)]
        while todo:
            node, parent = todo.pop()
            if node is None:  # everything below a node has been seen
                self.last[base + parent] = len(self.parent) - base - 1
                continue
            at = len(self.parent)
            pre = at - base
            pre_of[id(node)] = pre
            self.parent.append(parent)
            self.last.append(pre)
            self.tag.append(self.code(node.kind, node.name, node.closed))
            if node.kind != "element" and node.kind != "document":
                self.contents.append(node.content)
            if node.attrs:
                self.attrs_at.append(at)
                self.attrs.append(node.attrs)
                self.lower.append({k.lower(): v or "" for k, v in node.attrs.items()})
            if node.form:
                owned.append((pre, node.form))
            if node.kids:
                todo.append((None, pre))
                todo += [(k, pre) for k in reversed(node.kids)]
        for pre, form in owned:
            if pre_of.get(id(form), pre) < pre:
                self.forms_at.append(base + pre)
                self.forms.append(pre_of[id(form)])

    # -- text --------------------------------------------------------------------

    def textual(self, at: int) -> None:
        """The optional texts of the last document's nodes; at: where its contents begin."""
        fields = self.fields
        base, end = self.offsets[-1], len(self.parent)
        if fields & {"text", "has_text"}:
            self.all_texts(base, end, at)
        if "own_text" in fields:
            self.own_texts(base, end, at)
        if "data" in fields:
            self.all_data(base, end, at)

    def all_texts(self, base: int, end: int, at: int) -> None:
        """As textual.text_of() and has_text() have them, in one pass: an element's text is its stretch of the whole's.

        What stands before it only decides on white space at its beginning, which is stripped.
        """
        tags = [(kind, kind == "element" and (norm == "br" or is_block(norm)), norm in PRESERVE_SPACE) for kind, _, norm, _ in self.tags]
        parent, last, tag = self.parent, self.last, self.tag
        texts: list[str | None] = [None] * (end - base)
        inked: list[bool | None] = [None] * (end - base)
        parts: list[str] = []
        white, ink = False, 0
        opened: list[tuple[int, int, int, int]] = []  # (last, node, parts before, texts with more than white space before)
        for i in range(end - base):
            while opened and opened[-1][0] < i:
                _, n, start, before = opened.pop()
                texts[n], inked[n] = close(parts, start), ink > before
            kind, block, _ = tags[tag[base + i]]
            if kind == "element" or kind == "document":
                if block and parts and not white:
                    parts.append(" ")
                    white = True
                opened.append((last[base + i], i, len(parts), ink))
                continue
            data = self.contents[at]
            at += 1
            if kind != "text":
                continue
            if data.strip(WHITE):
                ink += 1
            up = parent[base + i]
            if not (up >= 0 and (tags[tag[base + up]][2] or (up > 0 and tags[tag[base + parent[base + up]]][2]))):
                data = RUN.sub(" ", data)
                if white and data.startswith(" "):
                    data = data[1:]
            if data:
                parts.append(data)
                white = data[-1] in " \t\n\r\f\xa0"
        while opened:
            _, n, start, before = opened.pop()
            texts[n], inked[n] = close(parts, start), ink > before
        if "text" in self.fields:
            self.texts += texts
        if "has_text" in self.fields:
            self.inked += inked

    def own_texts(self, base: int, end: int, at: int) -> None:
        """As textual.own_text() has them."""
        tags = [(kind, norm == "br", norm in PRESERVE_SPACE) for kind, _, norm, _ in self.tags]
        parent, tag = self.parent, self.tag
        parts: list[list[str] | None] = [[] if tags[tag[i]][0] in ("element", "document") else None for i in range(base, end)]
        white = bytearray(end - base)
        for i in range(end - base):
            kind, line_break, _ = tags[tag[base + i]]
            up = parent[base + i]
            if kind == "element" or kind == "document":
                if line_break and up >= 0 and parts[up] and not white[up]:
                    parts[up].append(" ")
                    white[up] = 1
                continue
            data = self.contents[at]
            at += 1
            if kind != "text":
                if line_break and parts[up] and not white[up]:
                    parts[up].append(" ")
                    white[up] = 1
                continue
            if not (tags[tag[base + up]][2] or (up > 0 and tags[tag[base + parent[base + up]]][2])):
                data = RUN.sub(" ", data)
                if white[up] and data.startswith(" "):
                    data = data[1:]
            if data:
                parts[up].append(data)
                white[up] = data[-1] in " \t\n\r\f\xa0"
        self.own += [None if p is None else "".join(p).strip(WHITE) for p in parts]

    def all_data(self, base: int, end: int, at: int) -> None:
        """As textual.data_of() has them."""
        starts: list[tuple[int, int, int]] = []
        out: list[str | None] = [None] * (end - base)
        parts: list[str] = []
        for i in range(end - base):
            while starts and starts[-1][0] < i:
                _, n, start = starts.pop()
                out[n] = "".join(parts[start:]) if len(parts) > start else ""
            kind = self.tags[self.tag[base + i]][0]
            if kind == "element" or kind == "document":
                starts.append((self.last[base + i], i, len(parts)))
                continue
            if kind == "data":
                parts.append(self.contents[at])
            at += 1
        while starts:
            _, n, start = starts.pop()
            out[n] = "".join(parts[start:]) if len(parts) > start else ""
        self.data += out

    # -- columns -----------------------------------------------------------------

    def array(self) -> pa.Array:
        return assembled(Places(self), self.types)


def assembled(places: Places, types: list[pa.Field]) -> pa.Array:
    """The documents as arrays of nodes with some fields."""
    children = [getattr(places, f.name)().cast(f.type) for f in types]
    return pa.ListArray.from_arrays(pa.array(places.rows.offsets, pa.int32()), pa.StructArray.from_arrays(children, fields=types))


def told(rows: list[dict | str]) -> Iterator[dict]:
    """Attributes, told apart one by one where they stand as written, so that those of a long document needn't stand there at once."""
    return (attributes(x) if type(x) is str else x for x in rows)


def close(parts: list[str], start: int) -> str:
    if len(parts) - start == 1:
        return parts[start].strip(WHITE)
    return "".join(parts[start:]).strip(WHITE) if len(parts) > start else ""


class Places:
    """The fields of gathered nodes, each as an Arrow array."""

    def __init__(self, rows: Columns):
        self.rows = rows
        self.n = n = len(rows.parent)
        self.up, self.end, self.tag = (np.frombuffer(x, np.int32) if n else np.zeros(0, np.int32) for x in (rows.parent, rows.last, rows.tag))
        offsets = np.array(rows.offsets)
        self.start = np.repeat(offsets[:-1], np.diff(offsets))
        self.at = np.arange(n) - self.start
        # A document's root has a group of its own.
        self.group = np.where(self.up >= 0, self.up + self.start, n + self.start)
        kinds = [t[0] for t in rows.tags]
        self.is_element = np.array([k == "element" for k in kinds], bool)[self.tag] if n else np.zeros(0, bool)
        self.is_content = np.array([k in CONTENT for k in kinds], bool)[self.tag] if n else np.zeros(0, bool)
        self.is_textual = self.is_element | (self.up < 0)
        self._ranks: dict[str, tuple] = {}

    def rank(self, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, place, number of nodes) among siblings, elements among them, or elements of a type, in order of groups."""
        if which not in self._ranks:
            nodes = np.arange(self.n) if which == "all" else np.flatnonzero(self.is_element)
            key = self.group[nodes]
            if which == "type":
                key = key * (len(self.rows.tags) + 1) + self.tag[nodes]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            counts = np.diff(np.r_[first, len(key)])
            self._ranks[which] = nodes[order], np.arange(len(key)) - np.repeat(first, counts), np.repeat(counts, counts)
        return self._ranks[which]

    def ints(self, nodes: np.ndarray, values: np.ndarray) -> pa.Array:
        """Values at some nodes, nulls at the others."""
        out, missing = np.zeros(self.n, np.int32), np.ones(self.n, bool)
        out[nodes], missing[nodes] = values, False
        return pa.array(out, mask=missing)

    def whole(self, values: np.ndarray) -> pa.Array:
        return pa.array(values.astype(np.int32))

    def depths(self) -> np.ndarray:
        """Nodes entered before, less those left."""
        left = np.cumsum(np.bincount(self.end + self.start + 1, minlength=self.n + 1))[: self.n]
        return np.arange(self.n) - left

    def pre(self):
        return self.whole(self.at)

    def post(self):
        return self.whole(self.end - self.depths())

    def last(self):
        return self.whole(self.end)

    def parent(self):
        return self.whole(self.up)

    def depth(self):
        return self.whole(self.depths())

    def sib(self):
        nodes, place, _ = self.rank("all")
        return self.ints(nodes, place)

    def el_idx(self):
        nodes, place, _ = self.rank("element")
        return self.ints(nodes, place)

    def el_idx_last(self):
        nodes, place, count = self.rank("element")
        return self.ints(nodes, count - 1 - place)

    def n_siblings(self):
        nodes, _, count = self.rank("element")
        return self.ints(nodes, count)

    def type_idx(self):
        nodes, place, _ = self.rank("type")
        return self.ints(nodes, place + 1)

    def type_idx_last(self):
        nodes, place, count = self.rank("type")
        return self.ints(nodes, count - place)

    def n_same_type(self):
        nodes, _, count = self.rank("type")
        return self.ints(nodes, count)

    def prev(self):
        nodes, place, _ = self.rank("element")
        later = np.flatnonzero(place > 0)
        return self.ints(nodes[later], self.at[nodes[later - 1]])

    def n_content(self):
        return self.whole(np.bincount(self.group[self.is_content & (self.up >= 0)], minlength=self.n)[: self.n])

    def form_owner(self):
        return self.ints(np.array(self.rows.forms_at, int), np.array(self.rows.forms, int))

    def named(self, i: int) -> pa.Array:
        return pa.array([t[i] for t in self.rows.tags], pa.string()).take(pa.array(self.tag))

    def kind(self):
        return self.named(0)

    def name(self):
        return self.named(1)

    def norm(self):
        return self.named(2)

    def id_attr(self):
        out: list[str | None] = [None] * self.n
        for i, attrs in zip(self.rows.attrs_at, told(self.rows.lower)):
            if "id" in attrs and self.is_element[i]:
                out[i] = attrs["id"]
        return pa.array(out, pa.string())

    def content(self):
        index = np.cumsum(~self.is_textual) - 1
        return pa.array(self.rows.contents, pa.string()).take(pa.array(index, mask=self.is_textual))

    def optional(self, name: str, values: list, kind: pa.DataType) -> pa.Array:
        return pa.array(values, kind) if name in self.rows.fields else pa.nulls(self.n, kind)

    def text(self):
        return self.optional("text", self.rows.texts, pa.string())

    def own_text(self):
        return self.optional("own_text", self.rows.own, pa.string())

    def data(self):
        return self.optional("data", self.rows.data, pa.string())

    def has_text(self):
        return self.optional("has_text", self.rows.inked, pa.bool_())

    def offsets(self, nodes, counts) -> pa.Array:
        ends = np.zeros(self.n + 1, np.int64)
        ends[np.asarray(nodes, int) + 1] = counts
        return pa.array(np.cumsum(ends).astype(np.int32))

    def attrs(self):
        rows, counts, parts = self.rows, [], []
        for some in batched(told(rows.attrs), AT_ONCE):
            counts += [len(a) for a in some]
            keys, values, bare = [k for a in some for k in a], [v or "" for a in some for v in a.values()], [v is None for a in some for v in a.values()]
            parts.append(pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string()), pa.array(bare, pa.bool_())], fields=list(PA_ATTRIBUTE)))
        return pa.ListArray.from_arrays(self.offsets(rows.attrs_at, counts), pa.concat_arrays(parts) if parts else pa.array([], PA_ATTRIBUTE))

    def attr_map(self):
        rows, counts, keys, values = self.rows, [], [pa.array([], pa.string())], [pa.array([], pa.string())]
        for some in batched(told(rows.lower), AT_ONCE):
            counts += [len(a) for a in some]
            keys.append(pa.array([k for a in some for k in a], pa.string()))
            values.append(pa.array([v for a in some for v in a.values()], pa.string()))
        return pa.MapArray.from_arrays(self.offsets(rows.attrs_at, counts), pa.concat_arrays(keys), pa.concat_arrays(values))

    def listed(self, lower: bool) -> pa.Array:
        split: dict[str, list[str]] = {}
        nodes, counts, out = [], [], []
        for i, attrs in zip(self.rows.attrs_at, told(self.rows.lower)):
            if given := attrs.get("class"):
                if given not in split:
                    found = list(dict.fromkeys(given.split()))
                    split[given] = [x.lower() for x in found] if lower else found
                nodes.append(i)
                counts.append(len(split[given]))
                out += split[given]
        return pa.ListArray.from_arrays(self.offsets(nodes, counts), pa.array(out, pa.string()))

    def classes(self):
        return self.listed(False)

    def classes_lc(self):
        return self.listed(True)

    def anc(self):
        """Nearest first."""
        if "anc" not in self.rows.fields:
            return pa.nulls(self.n, pa.list_(pa.int32()))
        depth = self.depths()
        starts = np.r_[0, np.cumsum(depth)]
        out = np.zeros(starts[-1], np.int32)
        nodes, at = np.flatnonzero(depth > 0), starts[:-1][depth > 0]
        up = nodes
        while len(at):
            out[at] = self.up[up]
            up = self.up[up] + self.start[up]
            more = self.up[up] >= 0
            up, at = up[more], at[more] + 1
        return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out))


def from_structs(dom: list[dict], base_uri: str = "", syntax: str = "html") -> Document:
    """The tree of a document's node structs."""
    doc = Document(base_uri, syntax)
    nodes: dict[int, Node] = {}
    for s in sorted(dom, key=lambda s: s["pre"]):
        if s["kind"] == "document":
            node = doc.root
        else:
            node = Node(s["kind"], s["name"], {a["k"]: None if a["b"] else a["v"] for a in (s["attrs"] if s["attrs"] is not None else ())}, s["content"] or "")
            nodes[s["parent"]].add(node)
        nodes[s["pre"]] = node
    return doc
