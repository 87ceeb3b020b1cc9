"""One pass over an HTML page: text, tags and the content of elements that hold no markup. Linear in the page's length.

Quotes count only where an attribute's value begins, as in browsers. A tag, comment or declaration that the page ends in
is dropped with all that follows; a `<` that begins none of them is text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache as once

TEXT, OPEN, CLOSE, INNER = range(4)
# Possessive, so that a tag without an end is given up after one look at the rest of the page.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")


@once
def end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def scan(page: str, raw: frozenset[str]) -> Iterator[tuple[int, str, str]]:
    """(TEXT, "", text), (OPEN, name, attributes), (CLOSE, name, "") and, after the opening tag of one of raw, (INNER, name, content). Names in lower case."""
    begin = at = 0  # of text that isn't given out yet; of what isn't looked at
    while True:
        i = page.find("<", at)
        if i < 0:
            if begin < len(page):
                yield TEXT, "", page[begin:]
            return
        ahead = page[i + 1 : i + 2]
        closing = ahead == "/" and page[i + 2 : i + 3].isascii() and page[i + 2 : i + 3].isalpha()
        if closing or ahead.isascii() and ahead.isalpha():
            m = TAG.match(page, i)
            end = m.end() if m else -1
        elif page.startswith("<!--", i):
            m, stop = None, i + 2 if page.startswith("<!-->", i) else page.find("-->", i + 4)
            end = stop + 3 if stop >= 0 else -1
        elif ahead and ahead in "!?/":
            m, end = None, page.find(">", i) + 1 or -1
        else:
            at = i + 1
            continue
        if i > begin:
            yield TEXT, "", page[begin:i]
        if end < 0:
            return
        begin = at = end
        if m is None:
            continue
        tag = m[2].lower()
        if closing:
            yield CLOSE, tag, ""
            continue
        yield OPEN, tag, m[3]
        if tag in raw:
            stop = end_of(tag).search(page, at)
            stop_at = stop.start() if stop else len(page)
            yield INNER, tag, page[at:stop_at]
            begin = at = stop_at


def attributes(text: str) -> list[tuple[str, str | None]]:
    """Names in lower case and values, None where there is none."""
    return [(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), None)) for m in ATTRIBUTE.finditer(text)]
