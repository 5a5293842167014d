"""Trees as HTML or XML text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from .tags import BOOLEAN_ATTRIBUTES, formats_as_block, is_self_closing, names_by_character
from .textual import keeps_space
from .tree import Document, Node


@dataclass(frozen=True)
class Output:
    escape_mode: str = "base"
    charset: str = "utf-8"
    syntax: str = "html"
    pretty: bool = True
    outline: bool = False
    indent: int = 1


@lru_cache(8)
def names(mode: str) -> dict[str, str]:
    return names_by_character(mode)


def escape(text: str, out: Output = Output(), in_attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("\xa0", "&#xa0;" if out.escape_mode == "xhtml" else "&nbsp;")
    if in_attribute:
        text = text.replace('"', "&quot;")
        if out.escape_mode == "xhtml":
            text = text.replace("<", "&lt;")
    else:
        text = text.replace("<", "&lt;").replace(">", "&gt;")
    if out.charset.lower().replace("_", "-") in ("utf-8", "utf8", "utf-16", "utf-32") or text.isascii():
        return text
    known = names(out.escape_mode)

    def one(c: str) -> str:
        try:
            c.encode(out.charset)
            return c
        except UnicodeEncodeError:
            return f"&{known[c]};" if c in known else f"&#x{ord(c):x};"

    return re.sub(r"[^\x00-\x7f]", lambda m: one(m[0]), text)


def attributes(node: Node, out: Output) -> str:
    parts = []
    for k, v in node.attrs.items():
        bare = out.syntax == "html" and (v is None or (k.lower() in BOOLEAN_ATTRIBUTES and (not v or v.lower() == k.lower())))
        parts.append(f" {k}" if bare else f' {k}="{escape(v or "", out, True)}"')
    return "".join(parts)


def doctype_text(node: Node, out: Output) -> str:
    a = node.attrs
    plain = out.syntax == "html" and not a["publicId"] and not a["systemId"]
    text = "<!doctype" if plain else "<!DOCTYPE"
    if a["name"]:
        text += f" {a['name']}"
    if a["pubSysKey"]:
        text += f" {a['pubSysKey']}"
    for x in (a["publicId"], a["systemId"]):
        if x:
            text += f' "{x}"'
    return text + ">"


def write(node: Node, out: Output, parts: list[str]) -> None:
    """Appends a node's outer text; a line is begun only after something."""
    todo: list = [(node, 0, False)]
    while todo:
        n, depth, tail = todo.pop()
        line = "\n" + " " * (depth * out.indent)
        block = n.kind == "element" and formats_as_block(n.norm)
        if tail:
            inner = n.kids
            if out.pretty and inner and (block or (out.outline and (len(inner) > 1 or inner[0].kind != "text"))):
                parts.append(line)
            parts.append(f"</{n.name}>")
            continue
        parent = n.parent
        if n.kind == "element":
            if out.pretty and parts and (block or (parent is not None and parent.kind == "element" and formats_as_block(parent.norm)) or out.outline):
                parts.append(line)
            closed = not n.kids and is_self_closing(n.norm, n.closed)
            parts.append(f"<{n.name}{attributes(n, out)}{' />' if closed else '>'}")
            if not closed:
                todo.append((n, depth, True))
                todo += [(k, depth + 1, False) for k in reversed(n.kids)]
        elif n.kind == "text":
            has_ink = bool(n.content.strip("\t\n\r\f "))
            if out.pretty and has_ink and parent is not None and ((parent.kids[0] is n and parent.kind == "element" and formats_as_block(parent.norm)) or (out.outline and len(parent.kids) > 1)):
                parts.append(line)
            text = n.content
            if out.pretty and parent is not None and parent.kind == "element" and not keeps_space(parent):
                text = RUN_ASCII.sub(" ", text)
            parts.append(escape(text, out))
        elif n.kind == "data":
            parts.append(n.content)
        elif n.kind == "comment":
            if out.pretty:
                parts.append(line)
            parts.append(f"<!--{n.content}-->")
        elif n.kind == "doctype":
            parts.append(doctype_text(n, out))
        elif n.kind == "xmldecl":
            parts.append(f"<{n.content}{n.name}{attributes(n, Output(syntax='xml'))}{n.content}>")
        else:
            todo += [(k, depth, False) for k in reversed(n.kids)]


RUN_ASCII = re.compile("[\t\n\r\f ]+")


def outer_html(node: Node, out: Output = Output()) -> str:
    parts: list[str] = []
    if node.kind == "document":
        return inner_html(node, out)
    write(node, out, parts)
    return "".join(parts)


def inner_html(node: Node, out: Output = Output()) -> str:
    parts: list[str] = []
    for k in node.kids:
        write(k, out, parts)
    text = "".join(parts)
    return text.strip("\t\n\r\f ") if out.pretty else text


def document_html(doc: Document, out: Output | None = None) -> str:
    return inner_html(doc.root, out or Output(syntax=doc.syntax, escape_mode="xhtml" if doc.syntax == "xml" else "base"))
