"""Tokens of HTML and XML text, found by compiled patterns rather than character by character."""

from __future__ import annotations

import re
from typing import NamedTuple

from .tags import ALL_ENTITIES, BASE_ENTITIES


class Start(NamedTuple):
    name: str
    attrs: dict[str, str | None]  # None: no value was given
    self_closing: bool = False


class End(NamedTuple):
    name: str


class Text(NamedTuple):
    data: str


class Comment(NamedTuple):
    data: str
    bogus: bool = False


class Doctype(NamedTuple):
    name: str
    public_key: str
    public_id: str
    system_id: str
    force_quirks: bool


SPACE = "\t\n\r\f "
TAG_NAME = re.compile(r"[^\t\n\r\f />\x00]*")
ATTRIBUTE = re.compile(r"[\t\n\r\f ]*(?:(/)(?!>)|(/?>)|(=?[^\t\n\r\f />=\x00]*)(?:[\t\n\r\f ]*(=)[\t\n\r\f ]*(?:\"([^\"]*)(\"|\Z)|'([^']*)('|\Z)|([^\t\n\r\f >]*)))?)")
REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?|([^\W\d_]+[0-9]*)(;?))")
QUERY_PART = re.compile(r"[^=;&\"'<>`\x00\t\n\r\f ]*([=&])")
DOCTYPE = re.compile(r"[\t\n\r\f ]*([^\t\n\r\f ]*)[\t\n\r\f ]*(?:(PUBLIC|SYSTEM)[\t\n\r\f ]*)?(.*)", re.I | re.S)
QUOTED = re.compile(r"[\t\n\r\f ]*(?:\"([^\"]*)(\"|\Z)|'([^']*)('|\Z))")
SCRIPT_MARK = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\r\f />])", re.I)


def decode(text: str, in_attribute: bool = False, query_guard: bool = False) -> str:
    """Character references decoded. Names of the base set stand without a semicolon too.

    in_attribute: a reference before =, -, _, a letter or a digit stays.
    query_guard: one of which the run reaches = or & before it ends stays.
    """
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        hexadecimal, decimal, name, end = m.groups()
        if name is None:
            value = int(hexadecimal, 16) if hexadecimal else int(decimal)
            return "�" if value > 0x10FFFF or 0xD800 <= value <= 0xDFFF else chr(value)
        if query_guard and QUERY_PART.match(text, m.start() + 1):
            return m[0]
        found = ALL_ENTITIES.get(name) if end else BASE_ENTITIES.get(name)
        if found is None:
            return m[0]
        if in_attribute and not end and (after := text[m.end() : m.end() + 1]) and (after.isalnum() or after in "=-_"):
            return m[0]
        return found

    return REFERENCE.sub(one, text)


def is_letter(c: str) -> bool:
    return c.isalpha()


class Tokenizer:
    """next() gives tokens, None at the end. mode: data, rcdata, rawtext, script or plaintext; the tree builder sets it."""

    def __init__(self, text: str, keep_tag_case: bool = False, keep_attr_case: bool = False):
        self.text, self.at, self.mode = text, 0, "data"
        self.keep_tag_case, self.keep_attr_case = keep_tag_case, keep_attr_case
        self.last_start = ""
        self.waiting: list = []

    def next(self):
        if self.waiting:
            return self.waiting.pop(0)
        if self.at >= len(self.text):
            return None
        return getattr(self, f"in_{self.mode}")()

    def in_data(self):
        text, parts, at = self.text, [], self.at
        while True:
            lt = text.find("<", at)
            if lt < 0:
                parts.append(decode(text[at:], query_guard=True))
                self.at = len(text)
                break
            if lt > at:
                parts.append(decode(text[at:lt], query_guard=True))
            token, self.at = self.markup(lt)
            if token is None:  # nothing but text, or nothing at all
                if self.at == lt:
                    parts.append("<")
                    self.at = lt + 1
                at = self.at
                continue
            if isinstance(token, str):  # CDATA
                parts.append(token)
                at = self.at
                continue
            if data := "".join(parts):
                self.waiting.append(token)
                return Text(data)
            return token
        data = "".join(parts)
        return Text(data) if data else None

    def markup(self, lt: int):
        """(token, the place after it); None at lt: the < is text, None elsewhere: skipped."""
        text = self.text
        c = text[lt + 1 : lt + 2]
        if c == "!":
            return self.declaration(lt)
        if c == "/":
            d = text[lt + 2 : lt + 3]
            if not d:
                return None, lt
            if is_letter(d):
                name, attrs, _, at = self.tag(lt + 2)
                return (None, at) if name is None else (End(name), at)
            if d == ">":
                return None, lt + 3
            return self.bogus(lt + 2)
        if c == "?":
            return self.bogus(lt + 1)
        if c and is_letter(c):
            name, attrs, closed, at = self.tag(lt + 1)
            if name is None:
                return None, at
            self.last_start = name
            return Start(name, attrs, closed), at
        return None, lt

    def tag(self, at: int):
        """(name, attributes, whether it closes itself, the place after >); no name if the text ends before."""
        text = self.text
        m = TAG_NAME.match(text, at)
        name, at = m[0], m.end()
        if text[at : at + 1] == "\x00":
            at += 1
        name = name.strip() if self.keep_tag_case else name.strip().lower()
        attrs: dict[str, str | None] = {}
        while at < len(text):
            m = ATTRIBUTE.match(text, at)
            slash, close, key, equals, double, double_end, single, single_end, bare = m.groups()
            if m.end() == at:  # a character that no attribute takes
                at += 1
                continue
            at = m.end()
            if close:
                return name, attrs, close == "/>", at
            if slash or not key:
                continue
            key = key if self.keep_attr_case else key.lower()
            if not equals:
                attrs[key] = None
            elif double is not None or single is not None:
                if not (double_end or single_end):
                    break
                attrs[key] = decode(double if double is not None else single, True)
            else:
                attrs[key] = decode(bare, True) if bare else None
        return None, attrs, False, len(text)

    def bogus(self, at: int):
        end = self.text.find(">", at)
        end = len(self.text) if end < 0 else end
        return Comment(self.text[at:end], True), min(end + 1, len(self.text))

    def declaration(self, lt: int):
        text, at = self.text, lt + 2
        if text.startswith("--", at):
            at += 2
            for short in (">", "->"):
                if text.startswith(short, at):
                    return Comment(""), at + len(short)
            m = re.compile(r"--!?>").search(text, at)
            if m:
                return Comment(text[at : m.start()]), m.end()
            return Comment(re.sub(r"--?!?\Z", "", text[at:])), len(text)
        if text[at : at + 7].lower() == "doctype":
            end = text.find(">", at)
            whole = end >= 0
            return self.doctype(text[at + 7 : end if whole else len(text)], not whole), end + 1 if whole else len(text)
        if text.startswith("[CDATA[", at):
            end = text.find("]]>", at + 7)
            return (text[at + 7 :], len(text)) if end < 0 else (text[at + 7 : end], end + 3)
        return self.bogus(at)

    def doctype(self, body: str, quirks: bool) -> Doctype:
        name, key, rest = DOCTYPE.match(body).groups()
        if not name:
            return Doctype("", "", "", "", True)
        ids = ["", ""]
        key = (key or "").upper()
        if key:
            at = 0
            for i in (0, 1) if key == "PUBLIC" else (1,):
                m = QUOTED.match(rest, at)
                if not m:
                    quirks |= i == 0 or key == "SYSTEM"
                    break
                ids[i] = m[1] if m[1] is not None else m[3]
                quirks |= not (m[2] or m[4])
                at = m.end()
        elif rest.strip():
            quirks = True
        return Doctype(name if self.keep_tag_case else name.lower(), key, ids[0], ids[1], quirks)

    def end_of(self, name: str, at: int):
        """The next end tag of an element that holds text: (its place, the place after its name)."""
        m = re.compile(rf"</{re.escape(name)}(?=[\t\n\r\f />])", re.I).search(self.text, at)
        return (m.start(), m.end()) if m else None

    def close(self, start: int, data: str):
        """Gives the text before an end tag, then the tag."""
        self.mode = "data"
        name, _, _, self.at = self.tag(start + 2)
        end = End(name) if name is not None else None
        if data:
            if end:
                self.waiting.append(end)
            return Text(data)
        return end

    def in_rcdata(self):
        found = self.end_of(self.last_start, self.at)
        if found:
            return self.close(found[0], decode(self.text[self.at : found[0]], query_guard=True))
        # Without an end tag the element ends where the next tag starts.
        m = re.compile(r"<(?=[^\W\d_])").search(self.text, self.at)
        if not m:
            data, self.at = decode(self.text[self.at :], query_guard=True), len(self.text)
            return Text(data) if data else None
        data, self.at, self.mode = decode(self.text[self.at : m.start()], query_guard=True), m.start(), "data"
        end = End(self.last_start)
        if not data:
            return end
        self.waiting.append(end)
        return Text(data)

    def in_rawtext(self):
        found = self.end_of(self.last_start, self.at)
        if found:
            return self.close(found[0], self.text[self.at : found[0]])
        data, self.at = self.text[self.at :], len(self.text)
        return Text(data)

    def in_script(self):
        """A script within <!-- --> ends the inner one only."""
        escaped = inner = False
        for m in SCRIPT_MARK.finditer(self.text, self.at):
            if m[0] == "<!--":
                escaped = True
            elif m[0] == "-->":
                escaped = inner = False
            elif not m[1]:
                inner = escaped
            elif inner:
                inner = False
            else:
                return self.close(m.start(), self.text[self.at : m.start()])
        data, self.at = self.text[self.at :], len(self.text)
        return Text(data)

    def in_plaintext(self):
        data, self.at = self.text[self.at :], len(self.text)
        return Text(data)
