"""Allow-list sanitising."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from .serialize import Output, inner_html
from .tree import Document, Node, parse_body_fragment, shell

ALL = ":all"


def merged(table: dict, key: str, more) -> dict:
    return table | {key: table.get(key, frozenset()) | frozenset(more)}


@dataclass(frozen=True)
class Policy:
    """What stays. Every method gives a new policy."""

    tags: frozenset = frozenset()
    attributes: dict = field(default_factory=dict)
    css: dict = field(default_factory=dict)
    enforced: dict = field(default_factory=dict)
    protocols: dict = field(default_factory=dict)
    keep_relative: bool = False
    url_space: str = "allow"  # strict, trim or allow

    def add_tags(self, *tags: str) -> Policy:
        return replace(self, tags=self.tags | {t.lower() for t in tags})

    def remove_tags(self, *tags: str) -> Policy:
        gone = {t.lower() for t in tags}
        without = lambda d: {k: v for k, v in d.items() if k not in gone}
        return replace(self, tags=self.tags - gone, attributes=without(self.attributes), enforced=without(self.enforced), protocols=without(self.protocols), css=without(self.css))

    def add_attributes(self, tag: str, *keys: str) -> Policy:
        """tag :all stands for every tag; another tag is allowed along with its attributes."""
        if not keys:
            raise ValueError("no attributes")
        tag = tag.lower()
        return replace(self, tags=self.tags | ({tag} if tag != ALL else set()), attributes=merged(self.attributes, tag, (k.lower() for k in keys)))

    def remove_attributes(self, tag: str, *keys: str) -> Policy:
        tag, gone = tag.lower(), {k.lower() for k in keys}
        return replace(self, attributes={t: v - gone if tag in (t, ALL) else v for t, v in self.attributes.items()})

    def add_css(self, tag: str, *properties: str) -> Policy:
        tag = tag.lower()
        return replace(self.add_attributes(tag, "style"), css=merged(self.css, tag, (p.lower() for p in properties)))

    def remove_css(self, tag: str, *properties: str) -> Policy:
        tag, gone = tag.lower(), {p.lower() for p in properties}
        css = {t: v - gone if tag in (t, ALL) else v for t, v in self.css.items()}
        return replace(self, css={t: v for t, v in css.items() if v})

    def enforce(self, tag: str, key: str, value: str) -> Policy:
        tag = tag.lower()
        return replace(self, tags=self.tags | {tag}, enforced=self.enforced | {tag: self.enforced.get(tag, {}) | {key.lower(): value}})

    def remove_enforced(self, tag: str, key: str) -> Policy:
        tag = tag.lower()
        left = {k: v for k, v in self.enforced.get(tag, {}).items() if k != key.lower()}
        return replace(self, enforced={t: v for t, v in (self.enforced | {tag: left}).items() if v})

    def add_protocols(self, tag: str, key: str, *protocols: str) -> Policy:
        tag, key = tag.lower(), key.lower()
        return replace(self, protocols=self.protocols | {tag: merged(self.protocols.get(tag, {}), key, (p.lower() for p in protocols))})

    def remove_protocols(self, tag: str, key: str, *protocols: str) -> Policy:
        tag, key = tag.lower(), key.lower()
        left = self.protocols.get(tag, {}).get(key, frozenset()) - {p.lower() for p in protocols}
        keys = {k: v for k, v in (self.protocols.get(tag, {}) | {key: left}).items() if v}
        return replace(self, protocols={t: v for t, v in (self.protocols | {tag: keys}).items() if v})

    def preserve_relative_links(self, on: bool = True) -> Policy:
        return replace(self, keep_relative=on)

    def url_whitespace(self, mode: str) -> Policy:
        if mode not in ("strict", "trim", "allow"):
            raise ValueError(f"no such mode: {mode}")
        return replace(self, url_space=mode)

    # -- decisions ------------------------------------------------------------

    def safe_value(self, tag: str, key: str, value: str, base_uri: str) -> str | None:
        """The value to keep, None to drop the attribute."""
        for owner in (tag, ALL):
            if key not in self.attributes.get(owner, ()):
                continue
            if key == "style" and (self.css.get(tag) or self.css.get(ALL)):
                return safe_style(value, self.css.get(tag, frozenset()) | self.css.get(ALL, frozenset())) or None
            allowed = self.protocols.get(owner, {}).get(key)
            return value if allowed is None else self.safe_url(value, allowed, base_uri)
        return None

    def safe_url(self, value: str, allowed: frozenset, base_uri: str) -> str | None:
        from ..functions.urls import resolve

        if self.url_space == "strict" and re.search(r"\s", value):
            return None
        if self.url_space == "trim":
            value = value.strip()
        whole = resolve(base_uri, value) or value
        for p in allowed:
            if p == "#":
                if value.startswith("#") and not re.search(r"\s", value):
                    return value
            elif whole.lower().startswith(f"{p}:"):
                return value if self.keep_relative else whole
        return None


# The ready-made policies.
NONE = Policy()
SIMPLE_TEXT = NONE.add_tags("b", "em", "i", "strong", "u")
BASIC = (
    NONE.add_tags(*"a b blockquote br cite code dd dl dt em i li ol p pre q small span strike strong sub sup u ul".split())
    .add_attributes("a", "href").add_attributes("blockquote", "cite").add_attributes("q", "cite")
    .add_protocols("a", "href", "ftp", "http", "https", "mailto").add_protocols("blockquote", "cite", "http", "https").add_protocols("cite", "cite", "http", "https")
    .enforce("a", "rel", "nofollow")
)
BASIC_WITH_IMAGES = BASIC.add_tags("img").add_attributes("img", "align", "alt", "height", "src", "title", "width").add_protocols("img", "src", "http", "https")
RELAXED = (
    NONE.add_tags(*"a b blockquote br caption cite code col colgroup dd div dl dt em h1 h2 h3 h4 h5 h6 i img li ol p pre q small span strike strong sub sup table tbody td tfoot th thead tr u ul".split())
    .add_attributes("a", "href", "title").add_attributes("blockquote", "cite").add_attributes("col", "span", "width").add_attributes("colgroup", "span", "width")
    .add_attributes("img", "align", "alt", "height", "src", "title", "width").add_attributes("ol", "start", "type").add_attributes("q", "cite")
    .add_attributes("table", "summary", "width").add_attributes("td", "abbr", "axis", "colspan", "rowspan", "width")
    .add_attributes("th", "abbr", "axis", "colspan", "rowspan", "scope", "width").add_attributes("ul", "type")
    .add_protocols("a", "href", "ftp", "http", "https", "mailto").add_protocols("blockquote", "cite", "http", "https").add_protocols("cite", "cite", "http", "https")
    .add_protocols("img", "src", "http", "https").add_protocols("q", "cite", "http", "https")
)
# End of fixed values.
POLICIES = {"none": NONE, "simple_text": SIMPLE_TEXT, "basic": BASIC, "basic_with_images": BASIC_WITH_IMAGES, "relaxed": RELAXED}

UNSAFE_STYLE = re.compile(r"expression\s*\(|@import|url\s*\(|javascript:|\\", re.I)


def safe_style(style: str, allowed: frozenset) -> str:
    """The allowed declarations, joined by '; '. Comments go; quotes and brackets hold semicolons."""
    style = re.sub(r"/\*.*?(\*/|\Z)", "", style, flags=re.S)
    out = []
    for part in re.findall(r"(?:[^;\"'(]|\"[^\"]*\"?|'[^']*'?|\([^)]*\)?)+", style):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip()
        if colon and value and name in allowed and name not in ("behavior", "-moz-binding") and not UNSAFE_STYLE.search(value):
            out.append(f"{name}: {value}")
    return "; ".join(out)


def copy_safe(source: Node, target: Node, policy: Policy, base_uri: str) -> int:
    """Copies what may stay; children of what may not stay are kept. Gives the number of things dropped."""
    dropped = 0
    todo = [(k, target) for k in reversed(source.kids)]
    while todo:
        n, to = todo.pop()
        if n.kind == "element":
            if n.norm in policy.tags:
                node, lost = safe_element(n, policy, base_uri)
                dropped += lost
                to = to.add(node)
            else:
                dropped += 1
            todo += [(k, to) for k in reversed(n.kids)]
        elif n.kind == "text":
            to.add(Node("text", content=n.content))
        elif n.kind == "data" and n.parent is not None and n.parent.norm in policy.tags:
            to.add(Node("data", content=n.content))
        else:
            dropped += 1
    return dropped


def safe_element(n: Node, policy: Policy, base_uri: str) -> tuple[Node, int]:
    attrs, dropped = {}, 0
    for k, v in n.attrs.items():
        kept = policy.safe_value(n.norm, k.lower(), v or "", base_uri)
        if kept is None:
            dropped += 1
        else:
            attrs[k] = None if v is None and not kept else kept
    attrs.update(policy.enforced.get(n.norm, {}))
    node = Node("element", n.name, attrs)
    node.closed = n.closed
    return node, dropped


def clean_document(dirty: Document, policy: Policy, head_policy: Policy | None = None) -> Document:
    clean = shell(dirty.base_uri)
    parts = {k.norm: k for k in (dirty.root.kids[-1].kids if dirty.root.kids else [])}
    for place, own in ((clean.root.kids[0].kids[0], head_policy), (clean.root.kids[0].kids[1], policy)):
        if own is not None and place.norm in parts:
            copy_safe(parts[place.norm], place, own, dirty.base_uri)
    return clean


def clean(html: str, policy: Policy, base_uri: str = "", out: Output = Output()) -> str:
    body = clean_document(parse_body_fragment(html, base_uri), policy).root.kids[0].kids[1]
    text = inner_html(body, out)
    if not policy.tags:
        text = re.sub("&nbsp;|&#160;|&#xa0;", " ", text)
    return text


def is_valid(html: str, policy: Policy) -> bool:
    body = parse_body_fragment(html).root.kids[0].kids[1]
    return copy_safe(body, Node("element", "body"), policy, "") == 0
