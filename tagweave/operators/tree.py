"""Trees from tokens: HTML with recovery from tag soup, and XML.

Nodes are plain objects that live within one row's parse; what leaves a worker
are the structs of schema.NODE. All walks are loops, so depth is no limit.
"""

from __future__ import annotations

from .tags import FORM_LISTED, SPECIAL, is_known
from .tokens import Comment, Doctype, End, Start, Text, Tokenizer


class Node:
    __slots__ = ("attrs", "closed", "content", "form", "kids", "kind", "name", "norm", "parent")

    def __init__(self, kind: str, name: str = "", attrs: dict | None = None, content: str = ""):
        self.kind, self.name, self.norm, self.attrs, self.content = kind, name, name.lower(), attrs if attrs is not None else {}, content
        self.kids: list[Node] = []
        self.parent: Node | None = None
        self.closed = False  # written as <x /> though its tag isn't known
        self.form: Node | None = None

    def add(self, node: Node, at: int | None = None) -> Node:
        node.detach()
        node.parent = self
        if at is None:
            self.kids.append(node)
        else:
            self.kids.insert(at, node)
        return node

    def detach(self) -> None:
        if self.parent is not None:
            kids = self.parent.kids
            del kids[kids.index(self) if kids[-1] is not self else -1]
            self.parent = None

    def index(self) -> int:
        return next(i for i, k in enumerate(self.parent.kids) if k is self)

    def __eq__(self, other) -> bool:
        return self is other

    __hash__ = object.__hash__

    def walk(self):
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.kids)


class Document:
    def __init__(self, base_uri: str = "", syntax: str = "html"):
        self.root, self.base_uri, self.quirks, self.syntax = Node("document", "#root"), base_uri or "", "no", syntax


def element(start: Start) -> Node:
    return Node("element", start.name, dict(start.attrs))


def add_text(parent: Node, data: str, kind: str = "text", at: int | None = None) -> None:
    before = parent.kids[-1] if at is None and parent.kids else parent.kids[at - 1] if at else None
    if before is not None and before.kind == kind:
        before.content += data
    else:
        parent.add(Node(kind, content=data), at)


def blank(data: str) -> bool:
    return not data.strip("\t\n\r\f ")


# Tags that the rules of tree construction name.
SCOPE = frozenset("applet caption html table td th marquee object".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
IMPLIED = frozenset("dd dt li option optgroup p rp rt".split())
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
CELLS = ("td", "th")
SECTIONS = ("tbody", "tfoot", "thead")
IN_HEAD = frozenset("base basefont bgsound command link meta noframes noscript script style title".split())


def groups(**sets: str) -> dict[str, str]:
    return {tag: group for group, tags in sets.items() for tag in tags.split()}


#: What a start tag does in the body; tags that aren't named here are inserted after formatting is restored.
BODY_START = groups(
    anchor="a",
    block="address article aside blockquote center details dir div dl fieldset figcaption figure footer header hgroup menu nav ol p section summary ul",
    heading="h1 h2 h3 h4 h5 h6",
    verbatim="pre listing",
    item="li dd dt",
    format="b big code em font i s small strike strong tt u",
    scope="applet marquee object",
    void="area br hr img keygen wbr",
    embed="embed",
    media="param source track",
    input="input",
    table="table",
    form="form",
    html="html",
    body="body",
    head="base basefont bgsound command link meta noframes script style title",
    select="select",
    plaintext="plaintext",
    option="option optgroup",
    ruby="rp rt",
    drop="caption col colgroup frame head tbody td tfoot th thead tr frameset",
)
BODY_END = groups(
    block="address article aside blockquote button center details dir div dl fieldset figcaption figure footer header hgroup listing menu nav ol pre section summary ul",
    item="dd dt",
    list_item="li",
    heading="h1 h2 h3 h4 h5 h6",
    paragraph="p",
    body="body",
    html="html",
    form="form",
    scope="applet marquee object",
    line_break="br",
    format="a b big code em font i nobr s small strike strong tt u",
)


# End of fixed values.


class HtmlBuilder:
    """One parse. mode names a method that takes a token and says whether the token was of use."""

    def __init__(self, html: str, base_uri: str = "", keep_tag_case: bool = False, keep_attr_case: bool = False):
        self.doc = Document(base_uri)
        self.tokens = Tokenizer(html, keep_tag_case, keep_attr_case)
        self.stack: list[Node] = []
        self.formatting: list[Node | None] = []  # None: a marker
        self.mode, self.after_text = "initial", ""
        self.head: Node | None = None
        self.form: Node | None = None
        self.frameset_ok, self.fostering, self.base_set = True, False, False
        self.fragment, self.context = False, ""
        self.table_text: list[str] = []

    # -- runs ---------------------------------------------------------------

    def run(self) -> Document:
        while (token := self.tokens.next()) is not None:
            self.process(token)
            if isinstance(token, Start) and token.self_closing and self.pending_close:
                self.pending_close = False
                self.process(End(token.name))
        self.process(None)
        return self.doc

    pending_close = False

    def process(self, token) -> bool:
        return getattr(self, f"on_{self.mode}")(token)

    def start(self, name: str, attrs: dict | None = None) -> bool:
        return self.process(Start(name, attrs or {}))

    def end(self, name: str) -> bool:
        return self.process(End(name))

    # -- stack --------------------------------------------------------------

    @property
    def current(self) -> Node:
        return self.stack[-1] if self.stack else self.doc.root

    @property
    def at(self) -> str:
        return self.stack[-1].norm if self.stack else ""

    def on_stack(self, name: str) -> Node | None:
        return next((n for n in reversed(self.stack) if n.norm == name), None)

    def pop_to(self, *names: str) -> None:
        """Closes elements up to one so named."""
        while self.stack and self.stack.pop().norm not in names:
            pass

    def pop_before(self, *names: str) -> None:
        while self.stack and self.stack[-1].norm not in names:
            self.stack.pop()

    def in_scope(self, names, more=()) -> bool:
        names = (names,) if isinstance(names, str) else names
        for n in reversed(self.stack):
            if n.norm in names:
                return True
            if n.norm in SCOPE or n.norm in more:
                return False
        return False

    def in_table_scope(self, name: str) -> bool:
        for n in reversed(self.stack):
            if n.norm == name:
                return True
            if n.norm in ("html", "table"):
                return False
        return False

    def in_select_scope(self, name: str) -> bool:
        for n in reversed(self.stack):
            if n.norm == name:
                return True
            if n.norm not in ("optgroup", "option"):
                return False
        return False

    def close_implied(self, keep: str | None) -> None:
        """Nothing is closed unless one tag is kept from it."""
        while keep is not None and self.at in IMPLIED and self.at != keep:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope("p", ("button",)):
            self.end("p")

    # -- insertion ----------------------------------------------------------

    def place(self, node: Node) -> Node:
        if not self.stack:
            self.doc.root.add(node)
        elif self.fostering:
            self.foster(node)
        else:
            self.stack[-1].add(node)
        if node.kind == "element" and self.form is not None and node.norm in FORM_LISTED:
            node.form = self.form
        return node

    def insert(self, token: Start) -> Node:
        """Opens an element; one that closes itself is closed by an end tag of its own."""
        if token.self_closing:
            node = self.insert_empty(token)
            self.stack.append(node)
            self.pending_close = True
            self.tokens.mode = "data"
            return node
        node = self.place(element(token))
        self.stack.append(node)
        return node

    def insert_empty(self, token: Start) -> Node:
        node = element(token)
        node.closed = token.self_closing and not is_known(node.norm)
        return self.place(node)

    def insert_text(self, data: str) -> None:
        add_text(self.current, data, "data" if self.at in ("script", "style") else "text")

    def insert_comment(self, token: Comment) -> None:
        self.place(comment(token))

    def foster(self, node: Node) -> None:
        table = next((n for n in reversed(self.stack) if n.norm == "table"), None)
        if table is None:
            self.stack[0].add(node)
        elif table.parent is not None:
            table.parent.add(node, table.index())
        else:
            self.stack[self.stack.index(table) - 1].add(node)

    # -- formatting ---------------------------------------------------------

    def push_formatting(self, node: Node) -> None:
        alike = 0
        for i in range(len(self.formatting) - 1, -1, -1):
            other = self.formatting[i]
            if other is None:
                break
            if other.norm == node.norm and other.attrs == node.attrs:
                alike += 1
            if alike == 3:
                del self.formatting[i]
                break
        self.formatting.append(node)

    def active(self, name: str) -> Node | None:
        for n in reversed(self.formatting):
            if n is None:
                return None
            if n.norm == name:
                return n
        return None

    def restore_formatting(self) -> None:
        f = self.formatting
        if not f or f[-1] is None or f[-1] in self.stack:
            return
        i = len(f) - 1
        while i > 0 and f[i - 1] is not None and f[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(f)):
            node = self.place(Node("element", f[k].name, dict(f[k].attrs)))
            self.stack.append(node)
            f[k] = node

    def clear_formatting(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    # -- modes before the body ----------------------------------------------

    def on_initial(self, t) -> bool:
        if isinstance(t, Text) and blank(t.data):
            return True
        if isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Doctype):
            self.doc.root.add(doctype(t))
            if t.force_quirks:
                self.doc.quirks = "quirks"
            self.mode = "before_html"
        else:
            self.mode = "before_html"
            return self.process(t)
        return True

    def open_html(self) -> None:
        self.stack.append(self.place(Node("element", "html")))
        self.mode = "before_head"

    def on_before_html(self, t) -> bool:
        if isinstance(t, Doctype) or (isinstance(t, End) and t.name not in ("head", "body", "html", "br")):
            return False
        if isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Text) and blank(t.data):
            pass
        elif isinstance(t, Start) and t.name == "html":
            self.insert(t)
            self.mode = "before_head"
        else:
            self.open_html()
            return self.process(t)
        return True

    def on_before_head(self, t) -> bool:
        if isinstance(t, Text) and blank(t.data):
            return True
        if isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Doctype) or (isinstance(t, End) and t.name not in ("head", "body", "html", "br")):
            return False
        elif isinstance(t, Start) and t.name == "html":
            return self.on_in_body(t)
        elif isinstance(t, Start) and t.name == "head":
            self.head = self.insert(t)
            self.mode = "in_head"
        else:
            self.start("head")
            return self.process(t)
        return True

    def on_in_head(self, t) -> bool:
        if isinstance(t, Text) and blank(t.data):
            self.insert_text(t.data)
            return True
        if isinstance(t, Comment):
            self.insert_comment(t)
            return True
        if isinstance(t, Doctype):
            return False
        name = t.name if isinstance(t, (Start, End)) else ""
        if isinstance(t, Start):
            if name == "html":
                return self.on_in_body(t)
            if name in ("base", "basefont", "bgsound", "command", "link"):
                node = self.insert_empty(t)
                if name == "base" and node.attrs.get("href") is not None:
                    self.set_base(node.attrs["href"])
                return True
            if name == "meta":
                self.insert_empty(t)
                return True
            if name == "title":
                return self.text_element(t, "rcdata")
            if name in ("noframes", "style"):
                return self.text_element(t, "rawtext")
            if name == "noscript":
                self.insert(t)
                self.mode = "in_head_noscript"
                return True
            if name == "script":
                return self.text_element(t, "script")
            if name == "head":
                return False
        if isinstance(t, End):
            if name == "head":
                self.stack.pop()
                self.mode = "after_head"
                return True
            if name not in ("body", "html", "br"):
                return False
        self.end("head")
        return self.process(t)

    def text_element(self, t: Start, mode: str) -> bool:
        self.tokens.mode, self.tokens.last_start = mode, t.name
        self.after_text, self.mode = self.mode, "text"
        self.insert(t)
        return True

    def set_base(self, href: str) -> None:
        if self.base_set:
            return
        from ..functions.urls import resolve

        if url := resolve(self.doc.base_uri, href):
            self.doc.base_uri, self.base_set = url, True

    def on_in_head_noscript(self, t) -> bool:
        if isinstance(t, Doctype):
            return False
        if isinstance(t, Start) and t.name == "html":
            return self.on_in_body(t)
        if isinstance(t, End) and t.name == "noscript":
            self.stack.pop()
            self.mode = "in_head"
            return True
        if isinstance(t, Comment) or (isinstance(t, Text) and blank(t.data)) or (isinstance(t, Start) and t.name in ("basefont", "bgsound", "link", "meta", "noframes", "style")):
            return self.on_in_head(t)
        if isinstance(t, End) and t.name == "br":
            pass
        elif isinstance(t, End) or (isinstance(t, Start) and t.name in ("head", "noscript")):
            return False
        # Anything else is kept as text.
        if isinstance(t, Text):
            self.insert_text(t.data)
        elif isinstance(t, Start):
            self.insert_text(source(t))
        elif isinstance(t, End):
            self.insert_text(f"</{t.name}>")
        elif t is None:
            self.stack.pop()
            self.mode = "in_head"
            return self.process(t)
        return True

    def on_after_head(self, t) -> bool:
        if isinstance(t, Text) and blank(t.data):
            self.insert_text(t.data)
        elif isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Doctype):
            return False
        elif isinstance(t, Start) and t.name == "html":
            return self.on_in_body(t)
        elif isinstance(t, Start) and t.name == "body":
            self.insert(t)
            self.frameset_ok, self.mode = False, "in_body"
        elif isinstance(t, Start) and t.name == "frameset":
            self.insert(t)
            self.mode = "in_frameset"
        elif isinstance(t, Start) and t.name in IN_HEAD - {"command", "noscript"}:
            if self.head is not None:
                self.stack.append(self.head)
            self.on_in_head(t)
            if self.head in self.stack:
                self.stack.remove(self.head)
        elif (isinstance(t, Start) and t.name == "head") or (isinstance(t, End) and t.name not in ("body", "html")):
            return False
        else:
            self.start("body")
            self.frameset_ok = True
            return self.process(t)
        return True

    # -- body ---------------------------------------------------------------

    def on_in_body(self, t) -> bool:
        if isinstance(t, Text):
            if t.data == "\x00":
                return False
            self.restore_formatting()
            self.insert_text(t.data)
            if not blank(t.data):
                self.frameset_ok = False
            return True
        if isinstance(t, Comment):
            self.insert_comment(t)
            return True
        if isinstance(t, Start):
            return getattr(self, f"body_{BODY_START.get(t.name, 'other')}")(t)
        if isinstance(t, End):
            return getattr(self, f"body_end_{BODY_END.get(t.name, 'other')}")(t.name)
        return t is None

    def body_other(self, t: Start) -> bool:
        self.restore_formatting()
        self.insert(t)
        return True

    def body_anchor(self, t: Start) -> bool:
        if self.active("a") is not None:
            self.end("a")
            left = self.on_stack("a")
            if left is not None:
                self.stack.remove(left)
                if left in self.formatting:
                    self.formatting.remove(left)
        return self.body_format(t)

    def body_format(self, t: Start) -> bool:
        self.restore_formatting()
        self.push_formatting(self.insert(t))
        return True

    def body_block(self, t: Start) -> bool:
        self.close_p()
        self.insert(t)
        return True

    def body_heading(self, t: Start) -> bool:
        heading = self.at in HEADINGS  # as it stood before a p was closed
        self.close_p()
        if heading:
            self.stack.pop()
        self.insert(t)
        return True

    def body_verbatim(self, t: Start) -> bool:
        self.body_block(t)
        self.frameset_ok = False
        return True

    def body_item(self, t: Start) -> bool:
        self.frameset_ok = False
        alike = ("li",) if t.name == "li" else ("dd", "dt")
        for n in reversed(self.stack[1:]):
            if n.norm in alike:
                self.end(n.norm)
                break
            if n.norm in SPECIAL and n.norm not in ("address", "div", "p"):
                break
        return self.body_block(t)

    def body_scope(self, t: Start) -> bool:
        self.body_other(t)
        self.formatting.append(None)
        self.frameset_ok = False
        return True

    def body_void(self, t: Start) -> bool:
        self.restore_formatting()
        return self.body_embed(t)

    def body_embed(self, t: Start) -> bool:
        self.insert_empty(t)
        self.frameset_ok = False
        return True

    def body_media(self, t: Start) -> bool:
        self.insert_empty(t)
        return True

    def body_input(self, t: Start) -> bool:
        self.restore_formatting()
        if (self.insert_empty(t).attrs.get("type") or "").lower() != "hidden":
            self.frameset_ok = False
        return True

    def body_table(self, t: Start) -> bool:
        self.body_verbatim(t)
        self.mode = "in_table"
        return True

    def body_form(self, t: Start) -> bool:
        if self.form is not None:
            return False
        self.close_p()
        self.form = self.insert(t)
        self.frameset_ok = False
        return True

    def merge(self, node: Node | None, t: Start) -> None:
        if node is not None:
            known = {k.lower() for k in node.attrs}
            node.attrs.update({k: v for k, v in t.attrs.items() if k.lower() not in known})

    def body_html(self, t: Start) -> bool:
        self.merge(self.on_stack("html"), t)
        return True

    def body_body(self, t: Start) -> bool:
        self.merge(self.on_stack("body"), t)
        return True

    def body_head(self, t: Start) -> bool:
        return self.on_in_head(t)

    def body_select(self, t: Start) -> bool:
        self.body_other(t)
        self.frameset_ok = False
        self.mode = "in_select"
        return True

    def body_plaintext(self, t: Start) -> bool:
        self.body_other(t)
        self.tokens.mode = "plaintext"
        return True

    def body_option(self, t: Start) -> bool:
        if self.at == "option":
            self.end("option")
        return self.body_other(t)

    def body_ruby(self, t: Start) -> bool:
        if self.in_scope("ruby"):
            if self.at != "ruby":
                self.pop_before("ruby")
            self.insert(t)
        return True

    def body_drop(self, t: Start) -> bool:
        return False

    # -- ends in the body ---------------------------------------------------

    def body_end_other(self, name: str) -> bool:
        for n in reversed(self.stack):
            if n.norm == name:
                self.close_implied(name)
                self.pop_to(name)
                return True
            if n.norm in SPECIAL:
                return False
        return True

    def body_end_block(self, name: str) -> bool:
        if not self.in_scope(name):
            return False
        self.pop_to(name)
        return True

    def body_end_item(self, name: str) -> bool:
        if not self.in_scope(name):
            return False
        self.close_implied(name)
        self.pop_to(name)
        return True

    def body_end_list_item(self, name: str) -> bool:
        if not self.in_scope(name, ("ol", "ul")):
            return False
        self.close_implied(name)
        self.pop_to(name)
        return True

    def body_end_heading(self, name: str) -> bool:
        if not self.in_scope(HEADINGS):
            return False
        self.close_implied(name)
        self.pop_to(*HEADINGS)
        return True

    def body_end_paragraph(self, name: str) -> bool:
        if not self.in_scope("p", ("button",)):
            self.start("p")
            return self.end("p")
        self.close_implied("p")
        self.pop_to("p")
        return True

    def body_end_body(self, name: str) -> bool:
        if not self.in_scope("body"):
            return False
        self.mode = "after_body"
        return True

    def body_end_html(self, name: str) -> bool:
        return self.process(End("html")) if self.end("body") else True

    def body_end_form(self, name: str) -> bool:
        form, self.form = self.form, None
        if form is None or not self.in_scope("form"):
            return False
        if form in self.stack:
            self.stack.remove(form)
        return True

    def body_end_scope(self, name: str) -> bool:
        if not self.in_scope("name"):
            if not self.in_scope(name):
                return False
            self.pop_to(name)
            self.clear_formatting()
        return True

    def body_end_line_break(self, name: str) -> bool:
        self.start("br")
        return False

    def body_end_format(self, name: str) -> bool:
        """Misnested formatting is taken apart: of elements in it that must not be, each pass moves the furthest out, with a copy of the formatting in it."""
        for _ in range(8):
            fmt = self.active(name)
            if fmt is None:
                return self.body_end_other(name)
            if fmt not in self.stack:
                self.formatting.remove(fmt)
                return self.body_end_other(name)
            if not self.in_scope(fmt.norm):
                return False
            at = self.stack.index(fmt)
            above = next((n for n in self.stack[at + 1 : 64] if n.norm in SPECIAL), None)
            if above is None:
                self.pop_to(fmt.norm)
                self.formatting.remove(fmt)
                return True
            common = self.stack[at - 1]
            node = last = above
            for _ in range(3):
                i = self.stack.index(node) if node in self.stack else at + 1
                node = self.stack[i - 1]
                if node is fmt:
                    break
                if node not in self.formatting:
                    below = self.stack[i - 1 + 1]
                    self.stack.remove(node)
                    node = below
                    continue
                copy = Node("element", node.name)
                self.formatting[self.formatting.index(node)] = copy
                self.stack[self.stack.index(node)] = copy
                node = copy
                node.add(last)
                last = node
            if common.norm in TABLE_PARTS:
                last.detach()
                self.foster(last)
            else:
                common.add(last)
            adopter = Node("element", fmt.name, dict(fmt.attrs))
            for kid in list(above.kids):
                adopter.add(kid)
            above.add(adopter)
            self.formatting.remove(fmt)
            self.stack.remove(fmt)
            self.stack.insert(self.stack.index(above) + 1, adopter)
        return True

    def on_text(self, t) -> bool:
        if isinstance(t, Text):
            self.insert_text(t.data)
        elif t is None:
            self.stack.pop()
            self.mode = self.after_text
            return self.process(t)
        elif isinstance(t, End):
            self.stack.pop()
            self.mode = self.after_text
        return True

    # -- tables -------------------------------------------------------------

    def on_in_table(self, t) -> bool:
        if isinstance(t, Text):
            self.table_text, self.after_text, self.mode = [], self.mode, "in_table_text"
            return self.process(t)
        if isinstance(t, Comment):
            self.insert_comment(t)
            return True
        if isinstance(t, Doctype):
            return False
        if isinstance(t, Start):
            name = t.name
            if name == "caption":
                self.clear_stack("table")
                self.formatting.append(None)
                self.insert(t)
                self.mode = "in_caption"
            elif name == "colgroup":
                self.clear_stack("table")
                self.insert(t)
                self.mode = "in_column_group"
            elif name == "col":
                self.start("colgroup")
                return self.process(t)
            elif name in SECTIONS:
                self.clear_stack("table")
                self.insert(t)
                self.mode = "in_table_body"
            elif name in (*CELLS, "tr"):
                self.start("tbody")
                return self.process(t)
            elif name == "table":
                if self.end("table"):
                    return self.process(t)
            elif name in ("style", "script"):
                return self.on_in_head(t)
            elif name == "input" and (t.attrs.get("type") or "").lower() == "hidden":
                self.insert_empty(t)
            elif name == "form":
                if self.form is not None:
                    return False
                self.form = self.place(element(t))
            else:
                return self.beside_table(t)
            return True
        if isinstance(t, End):
            if t.name == "table":
                if not self.in_table_scope("table"):
                    return False
                self.pop_to("table")
                self.reset_mode()
                return True
            if t.name in "body caption col colgroup html tbody td tfoot th thead tr".split():
                return False
            return self.beside_table(t)
        return t is None

    def clear_stack(self, *names: str) -> None:
        while self.stack and self.stack[-1].norm not in (*names, "html"):
            self.stack.pop()

    def beside_table(self, t) -> bool:
        """What has no place in a table: elements go before it."""
        if self.at not in TABLE_PARTS:
            return self.on_in_body(t)
        self.fostering = True
        done = self.on_in_body(t)
        self.fostering = False
        return done

    def on_in_table_text(self, t) -> bool:
        if isinstance(t, Text):
            if t.data != "\x00":
                self.table_text.append(t.data)
            return True
        for data in self.table_text:
            if blank(data):
                self.insert_text(data)
            else:
                self.beside_table(Text(data))
        self.table_text = []
        self.mode = self.after_text
        return self.process(t)

    def on_in_caption(self, t) -> bool:
        name = t.name if isinstance(t, (Start, End)) else ""
        if isinstance(t, End) and name == "caption":
            if not self.in_table_scope("caption"):
                return False
            self.pop_to("caption")
            self.clear_formatting()
            self.mode = "in_table"
            return True
        if (isinstance(t, Start) and name in "caption col colgroup tbody td tfoot th thead tr".split()) or (isinstance(t, End) and name == "table"):
            return self.process(t) if self.end("caption") else True
        if isinstance(t, End) and name in "body col colgroup html tbody td tfoot th thead tr".split():
            return False
        return self.on_in_body(t)

    def on_in_column_group(self, t) -> bool:
        if isinstance(t, Text) and blank(t.data):
            self.insert_text(t.data)
            return True
        if isinstance(t, Comment):
            self.insert_comment(t)
            return True
        if isinstance(t, Doctype):
            return True
        if isinstance(t, Start) and t.name == "html":
            return self.on_in_body(t)
        if isinstance(t, Start) and t.name == "col":
            self.insert_empty(t)
            return True
        if isinstance(t, End) and t.name == "colgroup":
            if self.at == "html":
                return False
            self.stack.pop()
            self.mode = "in_table"
            return True
        if t is None and self.at == "html":
            return True
        return self.process(t) if self.end("colgroup") else True

    def on_in_table_body(self, t) -> bool:
        if isinstance(t, Start):
            if t.name == "tr":
                self.clear_stack(*SECTIONS, "template")
                self.insert(t)
                self.mode = "in_row"
                return True
            if t.name in CELLS:
                self.start("tr")
                return self.process(t)
            if t.name in ("caption", "col", "colgroup", *SECTIONS):
                return self.leave_section(t)
        elif isinstance(t, End):
            if t.name in SECTIONS:
                if not self.in_table_scope(t.name):
                    return False
                self.clear_stack(*SECTIONS, "template")
                self.stack.pop()
                self.mode = "in_table"
                return True
            if t.name == "table":
                return self.leave_section(t)
            if t.name in "body caption col colgroup html td th tr".split():
                return False
        return self.on_in_table(t)

    def leave_section(self, t) -> bool:
        if not any(self.in_table_scope(s) for s in ("tbody", "thead", "tfoot")):
            return False
        self.clear_stack(*SECTIONS, "template")
        self.end(self.at)
        return self.process(t)

    def on_in_row(self, t) -> bool:
        if isinstance(t, Start):
            if t.name in CELLS:
                self.clear_stack("tr", "template")
                self.insert(t)
                self.mode = "in_cell"
                self.formatting.append(None)
                return True
            if t.name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
                return self.process(t) if self.end("tr") else False
        elif isinstance(t, End):
            if t.name == "tr":
                if not self.in_table_scope("tr"):
                    return False
                self.clear_stack("tr", "template")
                self.stack.pop()
                self.mode = "in_table_body"
                return True
            if t.name == "table":
                return self.process(t) if self.end("tr") else False
            if t.name in SECTIONS:
                if not self.in_table_scope(t.name):
                    return False
                self.end("tr")
                return self.process(t)
            if t.name in "body caption col colgroup html td th".split():
                return False
        return self.on_in_table(t)

    def on_in_cell(self, t) -> bool:
        if isinstance(t, End):
            if t.name in CELLS:
                if not self.in_table_scope(t.name):
                    self.mode = "in_row"
                    return False
                self.pop_to(t.name)
                self.clear_formatting()
                self.mode = "in_row"
                return True
            if t.name in "body caption col colgroup html".split():
                return False
            if t.name in TABLE_PARTS:
                if not self.in_table_scope(t.name):
                    return False
                self.close_cell()
                return self.process(t)
        elif isinstance(t, Start) and t.name in "caption col colgroup tbody td tfoot th thead tr".split():
            if not (self.in_table_scope("td") or self.in_table_scope("th")):
                return False
            self.close_cell()
            return self.process(t)
        return self.on_in_body(t)

    def close_cell(self) -> None:
        self.end("td" if self.in_table_scope("td") else "th")

    # -- select, after the body, frames --------------------------------------

    def on_in_select(self, t) -> bool:
        if isinstance(t, Text):
            if t.data == "\x00":
                return False
            self.insert_text(t.data)
            return True
        if isinstance(t, Comment):
            self.insert_comment(t)
            return True
        if isinstance(t, Start):
            if t.name == "html":
                return self.on_in_body(t)
            if t.name in ("option", "optgroup"):
                if self.at == "option":
                    self.end("option")
                if self.at == "optgroup" and t.name == "optgroup":
                    self.end("optgroup")
                self.insert(t)
                return True
            if t.name == "select":
                return self.end("select")
            if t.name in ("input", "keygen", "textarea"):
                if not self.in_select_scope("select"):
                    return False
                self.end("select")
                return self.process(t)
            return self.on_in_head(t) if t.name == "script" else False
        if isinstance(t, End):
            if t.name == "optgroup":
                if self.at == "option" and len(self.stack) > 1 and self.stack[-2].norm == "optgroup":
                    self.end("option")
                if self.at == "optgroup":
                    self.stack.pop()
                return True
            if t.name == "option":
                if self.at == "option":
                    self.stack.pop()
                return True
            if t.name == "select":
                if not self.in_select_scope("select"):
                    return False
                self.pop_to("select")
                self.reset_mode()
                return True
            return False
        return t is None

    def on_in_select_in_table(self, t) -> bool:
        parts = ("caption", "table", *SECTIONS, "tr", *CELLS)
        if isinstance(t, Start) and t.name in parts:
            self.end("select")
            return self.process(t)
        if isinstance(t, End) and t.name in parts:
            if not self.in_table_scope(t.name):
                return False
            self.end("select")
            return self.process(t)
        return self.on_in_select(t)

    def on_after_body(self, t) -> bool:
        if isinstance(t, Text) and blank(t.data):
            return self.on_in_body(t)
        if isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Doctype):
            return False
        elif isinstance(t, Start) and t.name == "html":
            return self.on_in_body(t)
        elif isinstance(t, End) and t.name == "html":
            if self.fragment:
                return False
            self.mode = "after_after_body"
        elif t is not None:
            self.mode = "in_body"
            return self.process(t)
        return True

    def on_in_frameset(self, t) -> bool:
        if isinstance(t, Text) and blank(t.data):
            self.insert_text(t.data)
        elif isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Start) and t.name == "html":
            return self.on_in_body(t)
        elif isinstance(t, Start) and t.name == "frameset":
            self.insert(t)
        elif isinstance(t, Start) and t.name == "frame":
            self.insert_empty(t)
        elif isinstance(t, Start) and t.name == "noframes":
            return self.on_in_head(t)
        elif isinstance(t, End) and t.name == "frameset":
            if self.at == "html":
                return False
            self.stack.pop()
            if not self.fragment and self.at != "frameset":
                self.mode = "after_frameset"
        elif t is not None:
            return False
        return True

    def on_after_frameset(self, t) -> bool:
        if isinstance(t, Text) and blank(t.data):
            self.insert_text(t.data)
        elif isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Start) and t.name == "html":
            return self.on_in_body(t)
        elif isinstance(t, End) and t.name == "html":
            self.mode = "after_after_frameset"
        elif isinstance(t, Start) and t.name == "noframes":
            return self.on_in_head(t)
        elif t is not None:
            return False
        return True

    def on_after_after_body(self, t) -> bool:
        if isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Doctype) or (isinstance(t, Text) and blank(t.data)) or (isinstance(t, Start) and t.name == "html"):
            return self.on_in_body(t)
        elif t is not None:
            self.mode = "in_body"
            return self.process(t)
        return True

    def on_after_after_frameset(self, t) -> bool:
        if isinstance(t, Comment):
            self.insert_comment(t)
        elif isinstance(t, Doctype) or (isinstance(t, Text) and blank(t.data)) or (isinstance(t, Start) and t.name == "html"):
            return self.on_in_body(t)
        elif isinstance(t, Start) and t.name == "noframes":
            return self.on_in_head(t)
        elif t is not None:
            return False
        return True

    def reset_mode(self) -> None:
        """The mode that fits the open elements, or a fragment's context."""
        last = False
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].norm
            if i == 0 and self.fragment:
                last, name = True, self.context or name
            mode = {"select": "in_select", "tr": "in_row", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "head": "in_body", "body": "in_body", "frameset": "in_frameset", "html": "before_head"} | dict.fromkeys(SECTIONS, "in_table_body") | dict.fromkeys(() if last else CELLS, "in_cell")
            if name in mode:
                self.mode = mode[name]
                return
            if last:
                self.mode = "in_body"
                return


def source(t: Start) -> str:
    return f"<{t.name}" + "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in t.attrs.items()) + ">"


def comment(t: Comment) -> Node:
    return Node("comment", content=t.data)


def doctype(t: Doctype) -> Node:
    return Node("doctype", t.name, {"name": t.name, "pubSysKey": t.public_key, "publicId": t.public_id, "systemId": t.system_id})


def parse_html(html: str, base_uri: str = "", keep_tag_case: bool = False, keep_attr_case: bool = False) -> Document:
    return HtmlBuilder(html, base_uri, keep_tag_case, keep_attr_case).run()


def parse_fragment(html: str, context: str = "body", base_uri: str = "", keep_tag_case: bool = False, keep_attr_case: bool = False) -> list[Node]:
    """The nodes that html gives inside an element so named."""
    b = HtmlBuilder(html, base_uri, keep_tag_case, keep_attr_case)
    b.fragment = True
    root = b.doc.root.add(Node("element", "html"))
    b.stack.append(root)
    context = context.lower()
    b.tokens.last_start = context
    b.tokens.mode = {"title": "rcdata", "textarea": "rcdata", "script": "script", "plaintext": "plaintext"}.get(context, "rawtext" if context in ("iframe", "noembed", "noframes", "style", "xmp") else "data")
    b.context = context
    b.reset_mode()
    b.run()
    nodes = list(root.kids)
    for n in nodes:
        n.detach()
    return nodes


def shell(base_uri: str = "") -> Document:
    doc = Document(base_uri)
    html = doc.root.add(Node("element", "html"))
    html.add(Node("element", "head"))
    html.add(Node("element", "body"))
    return doc


def parse_body_fragment(html: str, base_uri: str = "", **options) -> Document:
    doc = shell(base_uri)
    body = doc.root.kids[0].kids[1]
    for n in parse_fragment(html, "body", base_uri, **options):
        body.add(n)
    return doc


def parse_xml(xml: str, base_uri: str = "", keep_tag_case: bool = True, keep_attr_case: bool = True) -> Document:
    """No tags are implied; an end tag closes the nearest open element so named, or nothing."""
    doc = Document(base_uri, "xml")
    stack = [doc.root]
    tokens = Tokenizer(xml, keep_tag_case, keep_attr_case)
    while (t := tokens.next()) is not None:
        if isinstance(t, Text):
            add_text(stack[-1], t.data)
        elif isinstance(t, Comment):
            stack[-1].add(declaration(t) or comment(t))
        elif isinstance(t, Doctype):
            stack[-1].add(doctype(t))
        elif isinstance(t, Start):
            node = stack[-1].add(element(t))
            if t.self_closing:
                node.closed = not is_known(node.norm)
            else:
                stack.append(node)
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == t.name:
                    del stack[i:]
                    break
    return doc


def declaration(t: Comment) -> Node | None:
    """<?...?> and <!...> with a name."""
    data = t.data
    if not (t.bogus and len(data) > 1 and data[0] in "!?"):
        return None
    inner = data[1:-1] if data[0] == "?" and data.endswith("?") else data[1:]
    tag = next((k for k in parse_xml_tag(inner)), None)
    if tag is None:
        return None
    return Node("xmldecl", tag.name, dict(tag.attrs), data[0])


def parse_xml_tag(inner: str):
    tokens = Tokenizer(f"<{inner}>", True, True)
    t = tokens.next()
    return [t] if isinstance(t, Start) else []


def looks_like_xml(text: str) -> bool:
    return text.lstrip().startswith("<?xml")


def parse(text: str, base_uri: str = "", mode: str = "auto", **options) -> Document:
    """mode: auto, html, xml, fragment (of a body), xml_fragment or fragment:<context tag>.

    options: keep_tag_case and keep_attr_case, in every mode; what isn't given or None is False, but True for XML.
    """
    options = {k: v for k, v in options.items() if v is not None}
    if mode == "auto":
        mode = "xml" if looks_like_xml(text) else "html"
    if mode in ("xml", "xml_fragment"):
        return parse_xml(text, base_uri, **options)
    if mode == "fragment":
        return parse_body_fragment(text, base_uri, **options)
    if mode.startswith("fragment:"):
        doc = Document(base_uri)
        for n in parse_fragment(text, mode.partition(":")[2], base_uri, **options):
            doc.root.add(n)
        return doc
    if mode != "html":
        raise ValueError(f"no such mode: {mode}")
    return parse_html(text, base_uri, **options)
