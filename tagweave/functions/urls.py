"""URL resolution after RFC 3986."""

from __future__ import annotations

import re
from urllib.parse import urljoin

SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def resolve(base: str, relative: str) -> str:
    """relative against base. A base without a scheme leaves only what is absolute; what can't be resolved gives the base.

    Characters outside ASCII are kept as they are written.
    """
    base, relative = base or "", relative or ""
    if not SCHEME.match(base):
        return relative if SCHEME.match(relative) else ""
    try:
        if relative.startswith("?"):  # keeps the last segment of the path
            base = re.split(r"[?#]", base, maxsplit=1)[0]
            return base + relative
        return urljoin(base, relative.strip()) or base
    except ValueError:
        return base
