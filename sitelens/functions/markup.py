"""Elements of a stored page, in one pass over its text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

# A quoted value may hold ">". What never ends goes on to the end of the page, so no sign is read twice.
TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)"""
    r"""|<(script|style)(?=[\s>/])(?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+(?:>(?:.*?</\1\s*+>|.*)|\Z)"""
    r"""|<(/?)([a-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""")


def attributes(inside: str) -> dict[str, str]:
    """Names in lower case; of repeated names the first counts."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(inside):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def closed_elements(page: str, names: Iterable[str]) -> list[tuple[str, str, tuple[list[str], int, int]]]:
    """(name, text inside the opening tag, slice of the page's text) of elements that are closed, in order of opening.

    A closing tag ends the latest open element of its name; each tag inside an
    element parts its text. The pieces of all elements are slices of one list.
    """
    pieces: list[str] = []
    open_: dict[str, list[tuple[int, str, int]]] = {n: [] for n in names}
    found: list[tuple[int, str, str, int, int]] = []
    at = order = 0
    for m in TOKEN.finditer(page):
        pieces.append(page[at : m.start()])
        at = m.end()
        if not m.group(3):
            continue
        name = m.group(3).lower()
        if name not in open_:
            continue
        if not m.group(2):
            open_[name].append((order, m.group(4), len(pieces)))
            order += 1
        elif open_[name]:
            number, inside, start = open_[name].pop()
            found.append((number, name, inside, start, len(pieces)))
    return [(name, inside, (pieces, start, end)) for _, name, inside, start, end in sorted(found)]


def shown(part: tuple[list[str], int, int]) -> str:
    """The text of a slice, references decoded, white space as single spaces."""
    pieces, start, end = part
    return " ".join(html.unescape(" ".join(pieces[start:end])).split())
