"""Text of nodes."""

from __future__ import annotations

import re

from .tags import PRESERVE_SPACE, is_block
from .tree import Node

RUN = re.compile("[\t\n\r\f \xa0]+")


def keeps_space(node: Node | None) -> bool:
    return node is not None and (node.norm in PRESERVE_SPACE or (node.parent is not None and node.parent.norm in PRESERVE_SPACE))


class Joined:
    """Text as it is gathered, with white space collapsed."""

    def __init__(self):
        self.parts: list[str] = []
        self.white, self.any = False, False

    def add(self, node: Node) -> None:
        data = node.content
        if not keeps_space(node.parent):
            data = RUN.sub(" ", data)
            if self.white and data.startswith(" "):
                data = data[1:]
        if data:
            self.parts.append(data)
            self.any, self.white = True, data[-1] in " \t\n\r\f\xa0"

    def space(self) -> None:
        if self.any and not self.white:
            self.parts.append(" ")
            self.white = True

    def done(self) -> str:
        return "".join(self.parts).strip("\t\n\r\f ")


def text_of(node: Node) -> str:
    """Text of the subtree; blocks and line breaks part words."""
    out = Joined()
    for n in node.walk():
        if n.kind == "text":
            out.add(n)
        elif n.kind == "element" and (is_block(n.norm) or n.norm == "br"):
            out.space()
    return out.done()


def all_texts(root: Node) -> dict[int, tuple[str, bool]]:
    """id(node) -> (text_of, has_text) of all elements below and at root, in one walk.

    An element's text is its stretch of the whole's: what stands before it
    only decides on white space at its beginning, which is stripped.
    """
    out: dict[int, tuple[str, bool]] = {}
    whole, ink = Joined(), 0
    parts = whole.parts
    todo: list = [root]
    while todo:
        n = todo.pop()
        if type(n) is tuple:
            n, start, before = n
            out[id(n)] = ("".join(parts[start:]).strip("\t\n\r\f ") if len(parts) > start else "", ink > before)
            continue
        if n.kind == "text":
            whole.add(n)
            if n.content.strip("\t\n\r\f "):
                ink += 1
        elif n.kind == "element" or n.kind == "document":
            if n.kind == "element" and (n.norm == "br" or is_block(n.norm)):
                whole.space()
            todo.append((n, len(parts), ink))
            todo += reversed(n.kids)
    return out


def own_text(node: Node) -> str:
    out = Joined()
    for n in node.kids:
        if n.kind == "text":
            out.add(n)
        elif n.norm == "br":
            out.space()
    return out.done()


def raw_text(node: Node) -> str:
    """Text of the subtree as it stands."""
    return "".join(n.content for n in node.walk() if n.kind == "text")


def data_of(node: Node) -> str:
    return "".join(n.content for n in node.walk() if n.kind == "data")


def has_text(node: Node) -> bool:
    return any(n.kind == "text" and n.content.strip("\t\n\r\f ") for n in node.walk())
