"""Plain text of wiki pages.

One pass over a page's marks.  Templates, tables, references and comments are left out however deeply
they are nested; a link gives what is shown for it.  A mark that is never closed is text.  Tables begin and end at the start
of a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

_MARK = re.compile(r"<!--|\{\{|\}\}|(?<![^\n])\{\||(?<![^\n])\|\}|\[\[|\]\]|\[(?=https?://)|\]|</?[A-Za-z][^<>]*>|''+")
#: Closing marks and what they close.
_CLOSES = {"}}": "{{", "|}": "{|", "]]": "[[", "]": "["}
#: Pages whose texts are held at a time.
PIECE = 256
_DROPPED = ("{{", "{|", "<ref")


def _shown(kind: str, held: list) -> list:
    """What a closed mark leaves of its pieces; pieces are strings, or lists of what closed marks within left."""
    if kind in _DROPPED:
        return []
    if kind == "[[":  # what follows the last bar
        for i in range(len(held) - 1, -1, -1):
            if isinstance(held[i], str) and "|" in held[i]:
                return [held[i].rpartition("|")[2], *held[i + 1 :]]
        return held
    for i, piece in enumerate(held):  # an address, and behind a space what is shown for it
        if isinstance(piece, str) and " " in piece:
            return [piece.partition(" ")[2], *held[i + 1 :]]
    return []


def _flat(pieces: list) -> str:
    out, stack = [], [iter(pieces)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list):
                stack.append(iter(x))
                break
            out.append(x)
        else:
            stack.pop()
    return "".join(out)


def plain_wikitext(text: str) -> str:
    """Text of a page's markup: see the module; headings and list items are lines of their own."""
    # Open marks: (kind, the mark itself, its pieces so far); the first frame is the page.
    frames: list[tuple[str, str, list]] = [("", "", [])]
    places: dict[str, list[int]] = {}  # of each kind's open frames
    at = 0

    def cut(depth: int) -> list:
        """Take the frames from a depth on; those above it that nothing closed are text with their marks."""
        held = frames[depth][2]
        for kind, mark, pieces in frames[depth + 1 :]:
            held.append(mark)
            held.append(pieces)
            places[kind].pop()
        del frames[depth + 1 :]
        return held

    while found := _MARK.search(text, at):
        frames[-1][2].append(text[at : found.start()])
        mark, at = found.group(), found.end()
        kind = _CLOSES.get(mark)
        if mark == "<!--":
            end = text.find("-->", at)
            if end < 0:
                frames[-1][2].append(text[found.start() :])
                at = len(text)
            else:
                at = end + 3
        elif kind or mark == "</ref>":
            kind = kind or "<ref"
            if places.get(kind):
                depth = places[kind].pop()
                held = cut(depth)
                frames.pop()
                frames[-1][2].append(_shown(kind, held))
            elif kind != "<ref":
                frames[-1][2].append(mark)
        elif mark in ("{{", "{|", "[[", "[") or re.match(r"<ref\b[^>]*(?<!/)>", mark):
            kind = "<ref" if mark[0] == "<" else mark
            places.setdefault(kind, []).append(len(frames))
            frames.append((kind, "" if kind == "<ref" else mark, []))
        # Other tags and emphasis leave nothing.
    frames[-1][2].append(text[at:])
    lines = []
    for line in _flat(cut(0)).split("\n"):
        if line[:1] == "=" and line.rstrip()[-1:] == "=":
            line = line.strip("= \t") or line
        elif line[:1] in ("*", "#", ":", ";") and line:
            line = line.lstrip("*#:;").lstrip(" \t")
        lines.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _plain(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for x in pages:
        for a in range(0, len(x), PIECE):
            yield pa.array([None if p is None else plain_wikitext(p) for p in (y.as_py() for y in x.slice(a, PIECE))], pa.string())


def strip_wikitext(page: Column) -> Column:
    """``plain_wikitext`` of a column; null stays null."""
    return arrow_udf(_plain, StringType())(page)
