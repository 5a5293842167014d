"""Edits of a document: a list of operations applied in one pass over one parse.

An edit is (operation, selector, arguments...); it applies to every match, in
document order. Each gives a new text; rows are never changed in place.
"""

from __future__ import annotations

from ..plans.selector import parse as parse_selector
from .matching import select
from .serialize import Output, document_html, inner_html
from .textual import text_of
from .tree import Document, Node, parse, parse_fragment, parse_xml

OPERATIONS: dict = {}


def operation(f):
    OPERATIONS[f.__name__] = f
    return f


def nodes_of(html: str, context: Node, doc: Document) -> list[Node]:
    if doc.syntax == "xml":
        nodes = list(parse_xml(html).root.kids)
        for n in nodes:
            n.detach()
        return nodes
    return parse_fragment(html, context.norm if context.kind == "element" else "body", doc.base_uri)


def key_of(n: Node, key: str) -> str:
    return next((k for k in n.attrs if k.lower() == key.lower()), key)


@operation
def attr(n: Node, doc: Document, key: str, value) -> None:
    """A value, True for a bare attribute, False to remove it."""
    if value is False:
        n.attrs.pop(key_of(n, key), None)
    else:
        n.attrs[key_of(n, key.strip())] = None if value is True else value


@operation
def remove_attr(n: Node, doc: Document, key: str) -> None:
    n.attrs.pop(key_of(n, key), None)


def class_set(n: Node, change) -> None:
    names = dict.fromkeys((n.attrs.get(key_of(n, "class")) or "").split())
    change(names)
    n.attrs[key_of(n, "class")] = " ".join(names)


@operation
def add_class(n: Node, doc: Document, name: str) -> None:
    class_set(n, lambda c: c.setdefault(name))


@operation
def remove_class(n: Node, doc: Document, name: str) -> None:
    class_set(n, lambda c: c.pop(name, None))


@operation
def toggle_class(n: Node, doc: Document, name: str) -> None:
    class_set(n, lambda c: c.pop(name, None) if name in c else c.setdefault(name))


@operation
def val(n: Node, doc: Document, value: str) -> None:
    if n.norm == "textarea":
        text(n, doc, value)
    else:
        n.attrs["value"] = value


@operation
def empty(n: Node, doc: Document) -> None:
    for k in list(n.kids):
        k.detach()


@operation
def text(n: Node, doc: Document, value: str) -> None:
    empty(n, doc)
    n.add(Node("text", content=value))


@operation
def html(n: Node, doc: Document, value: str) -> None:
    empty(n, doc)
    append(n, doc, value)


@operation
def tag_name(n: Node, doc: Document, name: str) -> None:
    if not name:
        raise ValueError("a tag needs a name")
    n.name, n.norm = name, name.lower()


@operation
def insert_children(n: Node, doc: Document, index: int, value: str) -> None:
    """A negative index counts from the end: -1 is after the last child."""
    size = len(n.kids)
    at = index + size + 1 if index < 0 else index
    if not 0 <= at <= size:
        raise IndexError(f"insert position {index} of {size} children")
    for k in reversed(nodes_of(value, n, doc)):
        n.add(k, at)


@operation
def append(n: Node, doc: Document, value: str) -> None:
    insert_children(n, doc, -1, value)


@operation
def prepend(n: Node, doc: Document, value: str) -> None:
    insert_children(n, doc, 0, value)


@operation
def append_element(n: Node, doc: Document, name: str) -> None:
    n.add(Node("element", name))


@operation
def prepend_element(n: Node, doc: Document, name: str) -> None:
    n.add(Node("element", name), 0)


@operation
def append_text(n: Node, doc: Document, value: str) -> None:
    n.add(Node("text", content=value))


@operation
def prepend_text(n: Node, doc: Document, value: str) -> None:
    n.add(Node("text", content=value), 0)


@operation
def before(n: Node, doc: Document, value: str) -> None:
    for k in nodes_of(value, n.parent, doc):
        n.parent.add(k, n.index())


@operation
def after(n: Node, doc: Document, value: str) -> None:
    for k in reversed(nodes_of(value, n.parent, doc)):
        n.parent.add(k, n.index() + 1)


@operation
def wrap(n: Node, doc: Document, value: str) -> None:
    """The first element of value takes the node's place, its innermost first child the node."""
    found = nodes_of(value, n.parent, doc)
    outer = next((k for k in found if k.kind == "element"), None)
    if outer is None:
        return
    n.parent.add(outer, n.index())
    deep = outer
    while (first := next((k for k in deep.kids if k.kind == "element"), None)) is not None:
        deep = first
    deep.add(n)
    for k in found:
        if k is not outer:
            outer.add(k)


@operation
def unwrap(n: Node, doc: Document) -> None:
    for k in list(n.kids):
        n.parent.add(k, n.index())
    n.detach()


@operation
def remove(n: Node, doc: Document) -> None:
    n.detach()


@operation
def replace_with(n: Node, doc: Document, value: str) -> None:
    before(n, doc, value)
    n.detach()


@operation
def split_text(n: Node, doc: Document, index: int, offset: int) -> None:
    """Parts the text node that is a child's place at an offset."""
    node = n.kids[index]
    if node.kind != "text" or not 0 <= offset <= len(node.content):
        raise IndexError(f"no text at {index} with offset {offset}")
    n.add(Node("text", content=node.content[offset:]), index + 1)
    node.content = node.content[:offset]


@operation
def remove_child(n: Node, doc: Document, index: int) -> None:
    n.kids[index].detach()


@operation
def replace_child(n: Node, doc: Document, index: int, value: str) -> None:
    remove_child(n, doc, index)
    insert_children(n, doc, index, value)


# -- of documents: the selector is left empty ---------------------------------


def first(doc: Document, name: str) -> Node | None:
    return next((n for n in doc.root.walk() if n.kind == "element" and n.norm == name), None)


@operation
def title(n: Node, doc: Document, value: str) -> None:
    node = first(doc, "title")
    if node is None and (head := first(doc, "head")) is not None:
        node = head.add(Node("element", "title"))
    if node is not None:
        text(node, doc, value)


@operation
def body_text(n: Node, doc: Document, value: str) -> None:
    if (body := first(doc, "body")) is not None:
        text(body, doc, value)


@operation
def base_uri(n: Node, doc: Document, value: str) -> None:
    doc.base_uri = value


@operation
def charset(n: Node, doc: Document, value: str) -> None:
    """<meta charset> of HTML, the declaration of XML."""
    value = value.upper()
    if doc.syntax == "xml":
        head = doc.root.kids[0] if doc.root.kids else None
        if head is None or head.kind != "xmldecl" or head.norm != "xml":
            head = doc.root.add(Node("xmldecl", "xml", {"version": "1.0"}, "?"), 0)
        head.attrs["encoding"] = value
        head.attrs.setdefault("version", "1.0")
        return
    metas = [m for m in doc.root.walk() if m.norm == "meta"]
    known = next((m for m in metas if "charset" in m.attrs), None)
    if known is not None:
        known.attrs["charset"] = value
    elif (head := first(doc, "head")) is not None:
        head.add(Node("element", "meta", {"charset": value}))
    for m in metas:
        if (m.attrs.get("name") or "").lower() == "charset":
            m.detach()


@operation
def normalise(n: Node, doc: Document) -> None:
    """Stray text moves into the body, further heads and bodies into the first ones."""
    root = first(doc, "html") or doc.root.add(Node("element", "html"))
    head = first(doc, "head") or root.add(Node("element", "head"), 0)
    body = first(doc, "body") or root.add(Node("element", "body"))
    for place in (head, root, doc.root):
        for k in [k for k in place.kids if k.kind == "text" and k.content.strip()]:
            body.add(k, 0)
            body.add(Node("text", content=" "), 0)
    for name, to in (("head", head), ("body", body)):
        for other in [x for x in doc.root.walk() if x.kind == "element" and x.norm == name and x is not to]:
            for k in list(other.kids):
                to.add(k)
            other.detach()


OF_DOCUMENTS = {"title", "body_text", "base_uri", "charset", "normalise"}


def apply(doc: Document, edits: list[tuple]) -> Document:
    for name, selector, *args in edits:
        f = OPERATIONS[name]
        if name in OF_DOCUMENTS:
            f(doc.root, doc, *args)
            continue
        for n in select(doc.root, parse_selector(selector)):
            if n.parent is not None:  # not gone with an earlier match
                f(n, doc, *args)
    return doc


def check(edits: list[tuple]) -> list[tuple]:
    """Raises on the driver what would fail on every row."""
    for name, selector, *_ in edits:
        if name not in OPERATIONS:
            raise ValueError(f"no such edit: {name}")
        if name not in OF_DOCUMENTS:
            parse_selector(selector)
    return [tuple(e) for e in edits]


def edited(html_text: str, edits: list[tuple], base: str = "", mode: str = "auto", out: Output | None = None, inner: bool = False) -> str:
    doc = apply(parse(html_text, base, mode), edits)
    if inner:  # of the body
        node = first(doc, "body") or doc.root
        return inner_html(node, out or Output())
    return document_html(doc, out)


def title_of(doc: Document) -> str:
    node = first(doc, "title")
    return " ".join(text_of(node).split()) if node is not None else ""


def css_path(n: Node) -> str:
    """A selector that finds the node: from the nearest id down, tags with their classes, and their place where these aren't enough."""
    steps: list[str] = []
    while True:
        if n.attrs.get("id"):
            steps.append(f"#{n.attrs['id']}")
            break
        names = dict.fromkeys((n.attrs.get("class") or "").split())
        own = ".".join([n.name.replace(":", "|"), *names])
        if n.parent is None or n.parent.kind == "document":
            steps.append(own)
            break
        row = [k for k in n.parent.kids if k.kind == "element"]
        if sum(k.norm == n.norm and set(names) <= set((k.attrs.get("class") or "").split()) for k in row) > 1:
            own += f":nth-child({row.index(n) + 1})"
        steps.append(own)
        n = n.parent
    return " > ".join(reversed(steps))
