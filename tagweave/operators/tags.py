"""What is known of HTML tags, and characters by name."""

from __future__ import annotations

from html.entities import html5

# Tag sets of HTML 4 and 5 as the engine's results need them.
BLOCK = frozenset(
    "html head body frameset script noscript style meta link title frame noframes noembed section nav aside hgroup header footer p h1 h2 h3 h4 h5 h6 ul ol pre listing div blockquote hr address figure figcaption form fieldset center dir applet marquee ins del s dl dt dd li table caption thead tfoot tbody colgroup col tr th td video audio canvas details menu plaintext template article main svg math".split()
)
INLINE = frozenset(
    "object base font tt i b u big small em strong dfn code samp kbd var cite abbr time acronym mark ruby rt rp rb a img br wbr map q sub sup bdo iframe embed span input select textarea label button optgroup option legend datalist keygen output progress meter area param source track summary command device basefont bgsound menuitem data bdi".split()
)
EMPTY = frozenset("meta link base frame img br wbr embed hr input keygen col command device area basefont bgsound menuitem param source track".split())
FORMAT_AS_INLINE = frozenset("title a p h1 h2 h3 h4 h5 h6 pre address li th td script style ins del s".split())
PRESERVE_SPACE = frozenset("pre plaintext title textarea".split())
FORM_LISTED = frozenset("button fieldset input keygen object output select textarea".split())
FORM_SUBMITTABLE = frozenset("input keygen object select textarea".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup command dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input isindex li link listing marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script section select style summary table tbody td textarea tfoot th thead title tr ul wbr xmp".split()
)
BOOLEAN_ATTRIBUTES = frozenset(
    "allowfullscreen async autofocus checked compact declare default defer disabled formnovalidate hidden inert ismap itemscope multiple muted nohref noresize noshade novalidate nowrap open readonly required reversed seamless selected sortable truespeed typemustmatch".split()
)
# End of fixed values.

#: Names with which a reference may stand without a semicolon, and all that need one.
BASE_ENTITIES = {k: v for k, v in html5.items() if not k.endswith(";")}
ALL_ENTITIES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
XHTML_ENTITIES = {k: ALL_ENTITIES[k] for k in ("quot", "amp", "lt", "gt")}


def is_known(norm: str) -> bool:
    return norm in BLOCK or norm in INLINE


def is_block(norm: str) -> bool:
    return norm in BLOCK


def is_inline(norm: str) -> bool:
    return norm not in BLOCK


def formats_as_block(norm: str) -> bool:
    """Unknown tags are inline but stand on lines of their own."""
    return (norm in BLOCK and norm not in FORMAT_AS_INLINE) or not is_known(norm)


def can_contain_block(norm: str) -> bool:
    return norm in BLOCK and norm not in EMPTY


def is_empty(norm: str) -> bool:
    return norm in EMPTY


def is_data(norm: str, self_closed: bool = False) -> bool:
    return not can_contain_inline(norm) and not is_self_closing(norm, self_closed)


def can_contain_inline(norm: str) -> bool:
    return norm not in EMPTY


def is_self_closing(norm: str, self_closed: bool = False) -> bool:
    return norm in EMPTY or self_closed


def names_by_character(mode: str) -> dict[str, str]:
    """Names for escaping: of several, base mode takes the shortest and then first, extended mode prefers names that aren't base ones."""
    table = {"xhtml": XHTML_ENTITIES, "base": BASE_ENTITIES, "extended": ALL_ENTITIES}[mode]
    out: dict[str, str] = {}
    for name in sorted(table, key=lambda n: (mode == "extended" and n in BASE_ENTITIES, len(n), n.lower() != n, n)):
        if len(table[name]) == 1:
            out.setdefault(table[name], name)
    if mode == "base":
        for name in ("amp", "lt", "gt", "quot"):
            out[table[name]] = name
    else:
        for name in ("amp", "lt", "gt", "quot"):
            out[ALL_ENTITIES[name]] = name
        if mode == "extended":
            out["\xa0"] = "nbsp"
    return out
