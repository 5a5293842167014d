"""Plain markup: what a pattern can split into tags and texts, and whose tree is what the tags say.

Most fragments that programs write close every tag in order and hold nothing that recovery would move. read() gives such
a document's nodes without a tree, and None where anything is in doubt: then the builder of tree.py decides.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain
from sys import intern

from .tags import FORM_LISTED
from .tokens import decode

KEY = r"[a-z][a-z0-9_:.-]*"
TAG = re.compile(rf'<(/?[a-z][a-z0-9]*)((?:[\t\n\r\f ]+{KEY}=(?:"[^"]*"|[a-zA-Z0-9_-]+))*)[\t\n\r\f ]*>')
ATTRIBUTE = re.compile(rf'({KEY})=(?:"([^"]*)"|([a-zA-Z0-9_-]+))')

# What plain markup may hold, by what the builder asks of a start tag.
INLINE, BLOCK, ITEM, FORMAT, VOID, FORM, TABLE, SECTION, ROW, CELL, HEADING = range(11)
KINDS = {
    INLINE: "abbr bdi bdo cite del dfn ins kbd label mark output q samp span sub sup textarea time var",
    BLOCK: "address article aside blockquote center div figcaption figure footer header menu nav ol p pre section ul",
    ITEM: "li",
    FORMAT: "a b big code em font i s small strike strong tt u",
    VOID: "br hr img input wbr",
    FORM: "form",
    TABLE: "table",
    SECTION: "tbody tfoot thead",
    ROW: "tr",
    CELL: "td th",
    HEADING: "h1 h2 h3 h4 h5 h6",
}
# End of fixed values.
STARTS = {tag: (kind, f"/{tag}", tag) for kind, tags in KINDS.items() for tag in tags.split()}
#: End tags that change what may follow.
ENDS = {"/p": BLOCK, "/form": FORM, "/table": TABLE} | {f"/{t}": FORMAT for t in KINDS[FORMAT].split()} | {f"/{t}": CELL for t in KINDS[CELL].split()}
#: Where text has no place.
BARE = frozenset(("/table", "/tbody", "/tfoot", "/thead", "/tr", "tbody"))
#: Characters of markup that are split at once.
PIECE = 1 << 18
#: Attributes by the text that they were written as, for as many texts as it holds.
known: dict[str, dict[str, str]] = {"": {}}


class Plain:
    """A document's nodes in document order; numbers count from 0. names: "" for texts, of which contents holds what stands there; attrs: as they were written, see attributes()."""

    __slots__ = ("attrs", "attrs_at", "contents", "forms", "last", "names", "parent")

    def __init__(self):
        self.parent, self.last = array("i", (-1, 0, 1, 1)), array("i", (0, 0, 2, 0))
        self.names: list[str] = ["#root", "html", "head", "body"]
        self.contents: list[str] = []
        self.attrs: list[str] = []
        self.attrs_at: list[int] = []
        self.forms: list[tuple[int, int]] = []  # (a control, its form)


def attributes(raw: str) -> dict[str, str]:
    found = known.get(raw)
    if found is None:
        found = {intern(k): v or w for k, v, w in ATTRIBUTE.findall(raw)}
        if "&" in raw:
            found = {k: decode(v, True) for k, v in found.items()}
        if len(known) < 4096 and len(raw) < 200:
            known[raw] = found
    return found


def pieces(html: str) -> Iterator[Iterator[tuple[str, str, str]]]:
    """(tag, its attributes, the text behind it), piece by piece, so that what a long document is split into needn't stand there at once."""
    at = 0
    while at < len(html):
        end = html.find("<", at + PIECE)
        piece = html[at:] if end < 0 else html[at:end]
        parts = TAG.split(piece)
        # A < that stands in no tag, or in a value: no tag is called so.
        if piece.count("<") != len(parts) // 3:
            yield iter((("<", "", ""),))
            return
        at += len(piece)
        yield zip(parts[1::3], parts[2::3], parts[3::3])


def read(html: str) -> Plain | None:
    begin = html.find("<")
    if begin < 0 or "<!" in html or "\x00" in html or (begin and not html[:begin].strip("\t\n\r\f ")):
        return None
    out = Plain()
    parent, last, names, contents = out.parent.append, out.last, out.names.append, out.contents.append
    more = last.append
    references = "&" in html
    n, top, end = 4, 3, ""  # the next number, the innermost open element's, the end tag that closes it
    stack, ends = [], []  # of those around it
    paragraph = table = cell = False
    form, formats = -1, set()
    if text := html[:begin]:
        contents(decode(text, query_guard=True) if references else text)
        parent(3), more(4), names("")
        n = 5
    for name, raw, text in chain.from_iterable(pieces(html)):
        if name[0] == "/":
            if name != end:
                if name != "/table" or end != "tbody":
                    return None
                last[top] = n - 1  # a tbody that was implied
                top, end = stack.pop(), ends.pop()
            if raw:
                return None
            kind = ENDS.get(name)
            if kind is not None:
                if kind == FORMAT:
                    formats.discard(name)
                elif kind == BLOCK:
                    paragraph = False
                elif kind == FORM:
                    form = -1
                elif kind == TABLE:
                    table = False
                else:
                    cell = False
            last[top] = n - 1
            top, end = stack.pop(), ends.pop()
        else:
            start = STARTS.get(name)
            if start is None:
                return None
            kind, closing, name = start
            if table and not cell and kind not in (SECTION, ROW, CELL):
                return None
            if kind == ITEM:
                if paragraph or (end != "/ol" and end != "/ul"):
                    return None
            elif kind == BLOCK:
                if paragraph:
                    return None
                paragraph = name == "p"
            elif kind == FORMAT:
                if closing in formats:
                    return None
                formats.add(closing)
            elif kind == CELL:
                if cell or end != "/tr":
                    return None
                cell = True
            elif kind == ROW:
                if cell or not table or end not in BARE or end == "/tr":
                    return None
                if end == "/table":
                    parent(top), more(n), names("tbody")
                    stack.append(top), ends.append(end)
                    top, end = n, "tbody"
                    n += 1
            elif kind == SECTION:
                if cell or end != "/table":
                    return None
            elif kind == TABLE:
                if table or paragraph or formats or form >= 0:
                    return None
                table = True
            elif kind == FORM:
                if form >= 0 or paragraph or table:
                    return None
                form = n
            elif kind == HEADING:
                if paragraph or end in HEADING_ENDS:
                    return None
            if raw:
                out.attrs.append(raw)
                out.attrs_at.append(n)
            if form >= 0 and name in FORM_LISTED:
                out.forms.append((n, form))
            parent(top), more(n), names(name)
            if kind != VOID:
                stack.append(top), ends.append(end)
                top, end = n, closing
            n += 1
        if text:
            if table and end in BARE:
                return None
            contents(decode(text, query_guard=True) if references else text)
            parent(top), more(n), names("")
            n += 1
    if stack:
        return None
    last[0] = last[1] = last[3] = n - 1
    return out


HEADING_ENDS = frozenset(f"/{t}" for t in KINDS[HEADING].split())
