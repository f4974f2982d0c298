"""A forgiving reader of HTML: one pass of a pattern over the page, block by block."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Elements whose content is no text, and elements that end a block of text.
SILENT = frozenset("script style noscript template iframe svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html img li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
PART = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-z][a-z0-9:_-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def parts(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): text pieces, opening and closing tags, in order. Text is unescaped, its white space kept."""
    at = 0
    for m in PART.finditer(html):
        if m.start() > at:
            yield "text", "", unescape(html[at : m.start()])
        at = m.end()
        if m[3]:
            yield "close" if m[2] else "open", m[3].lower(), m[4]
    if at < len(html):
        yield "text", "", unescape(html[at:])


def tidy(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def blocks(html: str) -> list[str]:
    """The visible text, one string a block, white space collapsed, empty blocks left out; the title is no body text."""
    out: list[str] = []
    line: list[str] = []
    in_title = False
    for kind, name, content in parts(html):
        if kind == "text":
            if not in_title:
                line.append(content)
            continue
        if name == "title":
            in_title = kind == "open"
        if name in BLOCKS:
            if text := tidy(line):
                out.append(text)
            line = []
    if text := tidy(line):
        out.append(text)
    return out
