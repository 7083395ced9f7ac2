"""A tolerant reading of style sheets: blocks with their parents, declarations, literals. Pure Python, for Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

DEPTH, BLOCKS, DECLARATIONS = 12, 3000, 300
#: Scans one piece at a time: quoted text, comment, or one sign that matters.
PIECE = re.compile(r""""(?:\\[\s\S]|[^"\\])*"|'(?:\\[\s\S]|[^'\\])*'|/\*[\s\S]*?\*/|[{};()\[\],"']|/\*""")
DECLARATION = re.compile(r"\s*([A-Za-z_-][\w-]{0,79})\s*:\s*([\s\S]*?)\s*\Z")


class SheetError(ValueError):
    """What cannot be read as a style sheet."""


def without_comments(text: str, instead: str = " ", strict: bool = False) -> str:
    """Comments become ``instead``, quoted text stays; an open comment leaves nothing, or is an error if ``strict``."""
    out, at = [], 0
    for m in PIECE.finditer(text):
        piece = m.group()
        if piece == "/*":
            if strict:
                raise SheetError("an open comment")
            return ""
        if piece.startswith("/*"):
            out += [text[at : m.start()], instead]
            at = m.end()
    return "".join(out) + text[at:]


def split_top(text: str, sign: str) -> list[str]:
    """The parts between signs (a comma or semicolon) that stand outside of quotes and of all brackets."""
    out, depth, start = [], 0, 0
    for m in PIECE.finditer(text):
        piece = m.group()
        if piece in ("(", "["):
            depth += 1
        elif piece in (")", "]"):
            depth = max(0, depth - 1)
        elif piece == sign and not depth:
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def statements(text: str) -> Iterator[tuple[int, tuple[str, ...], str]]:
    """(block, headers around, statement) of everything that ends in a semicolon or with its block, in order; an error if not balanced.

    Blocks are numbered as they open; 0 is outside of all.
    """
    around: list[tuple[int, str]] = []
    opened = depth = edge = 0
    for m in PIECE.finditer(text):
        piece = m.group()
        if piece in ("\"", "'"):
            raise SheetError("an open quote")
        if piece in "([":
            depth += 1
        elif piece in ")]":
            depth -= 1
        elif piece in "{};" and not (piece == ";" and depth):
            if depth or (piece == "}" and not around):
                raise SheetError("not balanced")
            said = text[edge : m.start()].strip()
            if piece == "{":
                opened += 1
                around.append((opened, said))
            elif said:
                yield around[-1][0] if around else 0, tuple(h for _, h in around), said
            if piece == "}":
                around.pop()
            edge = m.end()
    if around or depth:
        raise SheetError("not balanced")
    if said := text[edge:].strip():
        yield 0, (), said


def blocks(text: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """(header, body, parents' headers) of every balanced block, inner ones first; none if the text is not balanced."""
    open_: list[tuple[str, int]] = []
    out, edge = [], 0
    for m in PIECE.finditer(text):
        sign = m.group()
        if sign in "\"'":
            return []
        if sign == "{":
            open_.append((text[edge : m.start()].strip(), m.end()))
            if len(open_) > DEPTH or len(out) > BLOCKS:
                return []
        elif sign == "}":
            if not open_:
                return []
            header, start = open_.pop()
            out.append((header, text[start : m.start()], tuple(h for h, _ in open_)))
        if sign in "{};":
            edge = m.end()
    return [] if open_ else out


def declarations(body: str) -> list[tuple[str, str]]:
    """(property without vendor prefix, value) pairs."""
    out = []
    for part in split_top(body, ";")[:DECLARATIONS]:
        m = DECLARATION.match(part)
        if m and len(m[2]) <= 4000:
            out.append((unprefixed(m[1].lower()), m[2]))
    return out


def unprefixed(name: str) -> str:
    """A property without its vendor's prefix."""
    return re.sub(r"^-(?:webkit|moz|ms|o)-", "", name)


def literal(value: str) -> str:
    """The text that quoted parts of a value show, escapes resolved."""
    text = "".join(a or b for a, b in re.findall(r""""((?:\\[\s\S]|[^"\\])*)"|'((?:\\[\s\S]|[^'\\])*)'""", value))
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|([\s\S]))", lambda m: (chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else "\ufffd") if m[1] else m[2], text)


def says_something(text) -> bool:
    return isinstance(text, str) and any(c.isalnum() for c in text)
