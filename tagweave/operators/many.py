"""Many short documents of plain markup, read at once: tags are told apart by their texts, nesting and text by sums over all of them.

What plain.read() takes one by one, without tables, forms and text whose spaces are kept; what is in doubt is left to it.
"""

from __future__ import annotations

from collections.abc import Iterable
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from ..schema import PA_ATTRIBUTE, PA_NODE
from .flatten import Places, assembled
from .plain import BLOCK, CELL, FORM, FORMAT, HEADING, ITEM, ROW, SECTION, STARTS, TABLE, TAG, VOID, attributes
from .tags import PRESERVE_SPACE, is_block
from .tokens import decode

#: Bytes of a document from which on it is read alone.
LONG = 1 << 14
#: What a tag's text is; UNREAD: left to plain.read().
UNREAD, START, CLOSE, ALONE = range(4)
#: (what it is, its kind, its name, its attributes) by a tag's text, for as many texts as it holds.
known: dict[str, tuple[int, int, str, str]] = {}
SHELL = ("#root", "html", "head", "body")
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[9, 10, 12, 13, 32]] = True


def told(text: str) -> tuple[int, int, str, str]:
    found = known.get(text)
    if found is None:
        match = TAG.fullmatch(text)
        name, raw = match.groups() if match else ("", "")
        kind, _, name = STARTS.get(name.removeprefix("/"), (TABLE, "", ""))
        if kind in (TABLE, SECTION, ROW, CELL, FORM) or name in PRESERVE_SPACE:
            what = UNREAD
        elif text[1] == "/":
            what = UNREAD if raw or kind == VOID else CLOSE
        else:
            what = ALONE if kind == VOID else START
        found = what, kind, name, raw
        if len(known) < 4096 and len(text) < 200:
            known[text] = found
    return found


def gathered(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of bytes one behind the other, and where each begins."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return data[np.repeat(at - ends[:-1], sizes) + np.arange(ends[-1])], ends


def strings(data: np.ndarray, ends: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    mask = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little"))
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data), mask)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, one behind the other, and where each begins."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0] : ends[-1]], ends - ends[0]


class Tags:
    """The tags of those documents that are plain. Arrays have one entry a tag, in order; ok: one a document."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        n = len(ends) - 1
        self.data, self.ends = data, ends
        at, closed = np.flatnonzero(data == 60), np.append(np.flatnonzero(data == 62), len(data))
        counts = np.diff(np.searchsorted(at, ends))
        self.ok = (counts > 0) & (np.diff(ends) < LONG)
        self.ok[np.searchsorted(ends, np.flatnonzero(data == 0), "right") - 1] = False
        self.doc = np.repeat(np.arange(n), counts)
        self.at, self.behind = at, closed[np.searchsorted(closed[:-1], at)] + 1
        # The text behind a tag ends with the next tag or its document.
        self.until = np.minimum(np.append(at[1:], len(data)), ends[1:][self.doc])
        self.code = self.level = None
        lead = np.append(at, len(data))[np.searchsorted(at, ends[:-1])]
        ink = np.append(0, np.cumsum(~IS_WHITE[data]))
        self.ok &= (lead == ends[:-1]) | (ink[np.minimum(lead, ends[1:])] > ink[ends[:-1]])
        self.refuse(self.doc[self.behind > self.until])
        if len(self.at):
            self.name()
        if len(self.at):
            self.nest()
        if len(self.at):
            self.judge()

    def refuse(self, docs: np.ndarray) -> None:
        self.ok[docs] = False
        keep = self.ok[self.doc]
        if not keep.all():
            for x in ("at", "behind", "until", "doc", "code", "level"):
                if getattr(self, x) is not None:
                    setattr(self, x, getattr(self, x)[keep])

    def name(self) -> None:
        bounds = np.empty(2 * len(self.at) + 1, np.int32)
        bounds[:-1:2], bounds[1::2], bounds[-1] = self.at, self.behind, len(self.data)
        parts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(self.data))
        found = parts.take(pa.array(np.arange(0, len(bounds) - 1, 2))).dictionary_encode()
        self.code = found.indices.to_numpy()
        tags = [told(x) for x in found.dictionary.to_pylist()]
        self.tags = tags
        self.what, self.kind = np.array([t[0] for t in tags]), np.array([t[1] for t in tags])
        names = {name: i for i, name in enumerate(dict.fromkeys((*SHELL, "", *(t[2] for t in tags))))}
        self.names, self.named = list(names), np.array([names[t[2]] for t in tags])
        self.refuse(self.doc[(self.what == UNREAD)[self.code]])

    def nest(self) -> None:
        """Sets level, the number of elements open behind each tag, and pairs the tags that open and close an element."""
        step = np.array([0, 1, -1, 0])[self.what]
        first = self.firsts()
        open_ = np.cumsum(step[self.code])
        before = np.where(first > 0, open_[first - 1], 0)
        self.level = open_ - np.repeat(before, np.diff(np.append(first, len(self.at))))
        wrong = self.level < 0
        last = np.append(first[1:], len(self.at)) - 1
        wrong[last] |= self.level[last] != 0
        self.refuse(self.doc[wrong])
        what = self.what[self.code]
        inner = self.level + (what == CLOSE)
        nodes = np.flatnonzero((what == START) | (what == CLOSE))
        nodes = nodes[np.argsort(inner[nodes].astype(np.uint16), kind="stable")]  # documents are shorter than that
        name = self.named[self.code]
        differ = name[nodes[::2]] != name[nodes[1::2]]
        self.refuse(self.doc[nodes[::2][differ]])
        if differ.any() and len(self.at):
            return self.nest()
        self.opens, self.closes = nodes[::2], nodes[1::2]

    def firsts(self) -> np.ndarray:
        return np.flatnonzero(np.append(True, self.doc[1:] != self.doc[:-1]))

    def around(self, level: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The tag of the element of a level that is open behind each of some tags; -1 for the body."""
        size = len(self.at)
        keys = self.level[self.opens] * size + self.opens
        found = self.opens[np.maximum(np.searchsorted(keys, level * size + tags, "right") - 1, 0)] if len(keys) else np.zeros(len(tags), int)
        return np.where(level > 0, found, -1)

    def opened(self, name: int) -> np.ndarray:
        """How many elements of a name are open behind each tag."""
        return np.cumsum((np.array([0, 1, -1, 0])[self.what] * (self.named == name))[self.code])

    def judge(self) -> None:
        """Refuses what recovery would move, as plain.read() does."""
        starts = np.flatnonzero((self.what == START)[self.code])
        kind = self.kind[self.code[starts]]
        up = self.around(self.level[starts] - 1, starts)
        around = np.where(up >= 0, self.code[up], -1)  # a code
        lists = np.append(np.isin(self.named, [i for i, x in enumerate(self.names) if x in ("ol", "ul")]), False)
        wrong = (kind == ITEM) & ~lists[around]
        wrong |= (kind == HEADING) & np.append(self.kind == HEADING, False)[around]
        if "p" in self.names:
            p = self.names.index("p")
            inside = self.opened(p)[starts] > (self.named[self.code[starts]] == p)
            wrong |= inside & np.isin(kind, (BLOCK, ITEM, HEADING))
        for name in np.unique(self.named[(self.kind == FORMAT) & (self.what == START)]):
            wrong |= (self.named[self.code[starts]] == name) & (self.opened(name)[starts] > 1)
        if wrong.any():
            self.refuse(self.doc[starts[wrong]])
            if len(self.at):
                self.nest()


class Many(Places):
    """The fields of the nodes of plain documents."""

    def __init__(self, tags: Tags, fields: frozenset[str]):
        self.fields = fields
        first, size = tags.firsts(), len(tags.at)
        what = tags.what[tags.code]
        docs = tags.doc[first]
        lead = tags.at[first] - tags.ends[docs]
        element, behind = (what == START) | (what == ALONE), tags.until > tags.behind
        extra = np.zeros(size, np.int64)
        extra[first] = 4 + (lead > 0)
        ends = np.cumsum(extra + element + behind)
        begin = ends - element - behind  # the number of nodes before each tag's own
        bases = begin[first] - extra[first]
        n = int(ends[-1])
        offsets = np.append(bases, n)
        of = np.repeat(bases, np.diff(np.append(first, size)))
        parent, last = np.full(n, 3, np.int32), np.arange(n) - np.repeat(bases, np.diff(offsets))
        text = tags.names.index("")
        tag = np.full(n, text, np.int32)
        ends_of = np.diff(offsets) - 1
        for i, up in enumerate((-1, 0, 1, 1)):
            parent[bases + i], tag[bases + i] = up, i
            if i != 2:
                last[bases + i] = ends_of
        own = np.flatnonzero(element)
        tag[begin[own]] = tags.named[tags.code[own]]
        self.raws = list(dict.fromkeys(("", *(t[3] for t in tags.tags))))
        places = {raw: i for i, raw in enumerate(self.raws)}
        self.raw = np.zeros(n, np.int32)
        self.raw[begin[own]] = np.array([places[t[3]] for t in tags.tags], np.int32)[tags.code[own]]
        last[begin[tags.opens]] = begin[tags.closes] - 1 - of[tags.opens]
        texts = np.flatnonzero(behind)
        for nodes, some, level in ((begin[own], own, tags.level[own] - (what[own] == START)), (begin[texts] + element[texts], texts, tags.level[texts])):
            up = tags.around(level, some)
            parent[nodes] = np.where(up >= 0, begin[up] - of[some], 3)
        self.content_at = np.flatnonzero(tag == text)
        at, until = np.zeros(n, np.int64), np.zeros(n, np.int64)
        led = np.flatnonzero(lead > 0)
        at[bases[led] + 4], until[bases[led] + 4] = tags.ends[docs[led]], tags.at[first[led]]
        nodes = begin[texts] + element[texts]
        at[nodes], until[nodes] = tags.behind[texts], tags.until[texts]
        at, until = at[self.content_at], until[self.content_at]
        self.contents = gathered(tags.data, at, until - at)
        if (tags.data == 38).any():
            self.contents = bytes_of(pa.array([decode(x, query_guard=True) if "&" in x else x for x in strings(*self.contents).to_pylist()], pa.string()))
        kinds = [("document" if x == "#root" else "element" if x else "text", x, x, False) for x in tags.names]
        super().__init__(SimpleNamespace(parent=parent, last=last.astype(np.int32), tag=tag, offsets=offsets, tags=kinds, forms_at=[], forms=[]))

    def listed_by_attributes(self, rows: list[list], values: pa.Array) -> pa.Array:
        ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, values).take(pa.array(self.raw))

    def id_attr(self):
        return pa.array([attributes(x).get("id") if x else None for x in self.raws], pa.string()).take(pa.array(self.raw))

    def attrs(self):
        rows = [list(attributes(x).items()) if x else [] for x in self.raws]
        keys, values = pa.array([k for r in rows for k, _ in r], pa.string()), pa.array([v for r in rows for _, v in r], pa.string())
        bare = pa.array(np.zeros(len(keys), bool))
        return self.listed_by_attributes(rows, pa.StructArray.from_arrays([keys, values, bare], fields=list(PA_ATTRIBUTE)))

    def attr_map(self):
        rows = [list(attributes(x).items()) if x else [] for x in self.raws]
        ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
        keys, values = pa.array([k for r in rows for k, _ in r], pa.string()), pa.array([v for r in rows for _, v in r], pa.string())
        return pa.MapArray.from_arrays(ends, keys, values).take(pa.array(self.raw))

    def listed(self, lower: bool):
        rows = [list(dict.fromkeys(attributes(x).get("class", "").split())) if x else [] for x in self.raws]
        return self.listed_by_attributes(rows, pa.array([c.lower() if lower else c for r in rows for c in r], pa.string()))

    def content(self):
        missing = np.ones(self.n, bool)
        missing[self.content_at] = False
        data, ends = self.contents
        sizes = np.zeros(self.n + 1, np.int64)
        sizes[self.content_at + 1] = np.diff(ends)
        return strings(data, np.cumsum(sizes), missing)

    # -- text --------------------------------------------------------------------

    def collapsed(self, order: np.ndarray, group: np.ndarray, parted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contents in an order, their white space collapsed within each group, and where each begins; parted: where a space stands before one."""
        data, ends = self.plain_contents
        data, ends = gathered(data, ends[order], np.diff(ends)[order])
        data = np.insert(data, ends[:-1][parted], 32)
        ends = ends + np.append(0, np.cumsum(parted))
        white = IS_WHITE[data]
        after = np.append(True, white[:-1])
        heads = ends[:-1][np.append(True, group[1:] != group[:-1])]
        after[heads[heads < len(data)]] = True
        keep = ~(white & after)
        data = np.where(white, np.uint8(32), data)[keep]
        return data, np.append(0, np.cumsum(keep))[ends]

    @property
    def plain_contents(self) -> tuple[np.ndarray, np.ndarray]:
        """The contents with other spaces as spaces."""
        data, ends = self.contents
        if ((data[:-1] == 0xC2) & (data[1:] == 0xA0)).any():
            return bytes_of(pa.array([x.replace("\xa0", " ") for x in strings(data, ends).to_pylist()], pa.string()))
        return data, ends

    def stripped(self, data: np.ndarray, at: np.ndarray, until: np.ndarray) -> pa.Array:
        """Stretches for each node that holds others, less a space at either end; null for the others."""
        if len(data):
            at = at + ((until > at) & (data[np.minimum(at, len(data) - 1)] == 32))
            until = until - ((until > at) & (data[np.maximum(until - 1, 0)] == 32))
        return strings(*gathered(data, at, until - at), ~self.is_textual)

    def before(self, hits: np.ndarray) -> np.ndarray:
        """How many of some nodes stand before each node, and at the end."""
        return np.append(0, np.cumsum(hits))

    def within(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts before and behind each node's subtree."""
        return before[:-1], before[self.end + self.start + 1]

    def marks(self, f) -> np.ndarray:
        return np.array([f(t[1]) for t in self.rows.tags], bool)[self.tag]

    def is_content_node(self) -> np.ndarray:
        hits = np.zeros(self.n, bool)
        hits[self.content_at] = True
        return hits

    def text(self):
        if "text" not in self.fields:
            return pa.nulls(self.n, pa.string())
        at = self.content_at
        parts = self.before(self.marks(lambda x: x != "#root" and (x == "br" or is_block(x))))[at]
        data, ends = self.collapsed(np.arange(len(at)), self.start[at], np.append(parts[:1] > 0, parts[1:] > parts[:-1]))
        a, b = self.within(self.before(self.is_content_node()))
        hold = self.is_textual
        return self.stripped(data, np.where(hold, ends[a], 0), np.where(hold, ends[b], 0))

    def own_text(self):
        if "own_text" not in self.fields:
            return pa.nulls(self.n, pa.string())
        content, breaks = self.is_content_node(), self.marks(lambda x: x == "br")
        nodes = np.flatnonzero(content | breaks)
        nodes = nodes[np.argsort(self.group[nodes], kind="stable")]
        seen, keep = np.cumsum(breaks[nodes]), content[nodes]
        parts, nodes = seen[keep], nodes[keep]
        group = self.group[nodes]
        order = (self.before(content)[:-1])[nodes]
        data, ends = self.collapsed(order, group, np.append(parts[:1] > 0, parts[1:] > parts[:-1]))
        counts = self.before(np.bincount(group, minlength=self.n)[: self.n])
        hold = self.is_textual
        return self.stripped(data, np.where(hold, ends[counts[:-1]], 0), np.where(hold, ends[counts[1:]], 0))

    def has_text(self):
        if "has_text" not in self.fields:
            return pa.nulls(self.n, pa.bool_())
        data, ends = self.contents
        ink = np.append(0, np.cumsum(~IS_WHITE[data]))[ends]
        inked = np.zeros(self.n, bool)
        inked[self.content_at] = np.diff(ink) > 0
        a, b = self.within(self.before(inked))
        return pa.array(b > a, mask=~self.is_textual)

    def data(self):
        if "data" not in self.fields:
            return pa.nulls(self.n, pa.string())
        return strings(np.zeros(0, np.uint8), np.zeros(self.n + 1, np.int64), ~self.is_textual)

    def anc(self):
        self.rows.fields = self.fields
        return super().anc()


def read_many(texts: pa.Array, fields: Iterable[str], names: Iterable[str] | None = None) -> tuple[pa.Array | None, np.ndarray]:
    """(the node arrays of those texts that are plain, in order; which these are)."""
    chosen = None if names is None else frozenset(names)
    types = [f for f in PA_NODE if chosen is None or f.name in chosen]
    if not len(texts):
        return None, np.zeros(0, bool)
    tags = Tags(*bytes_of(texts))
    if not len(tags.at):
        return None, np.zeros(len(texts), bool)
    return assembled(Many(tags, frozenset(fields) & {f.name for f in types}), types), tags.ok
