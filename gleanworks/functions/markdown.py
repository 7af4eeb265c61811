"""Blocks of Markdown, as a grammar over the shapes of lines."""

from __future__ import annotations

import re

#: Where str.splitlines breaks a line; kept with the line before it.
_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
LINES = re.compile(f"[^{_ENDS}]*(?:\r\n|[{_ENDS}]|$)")
#: One letter for what a line is; capitals are for lines that begin with four spaces or a tab.
SHAPES = (
    ("q", re.compile(r"```")),
    ("w", re.compile(r"~~~")),
    ("t", re.compile(r"\|.*\|", re.S)),
    ("p", re.compile(r"\|")),
    ("h", re.compile(r"#{1,6} ")),
    ("l", re.compile(r"(?:[-*+]|\d+[.)]) ")),
    ("b", re.compile(r"$")),
)
#: Blocks as a grammar over those letters. A fence runs to the next fence of its kind; a list goes on over indented
#: lines, and over a blank line if an item follows it; a paragraph ends at a blank line, which it swallows.
GRAMMAR = re.compile(
    r"(?P<code_block>[qQ][^qQ]*[qQ]?|[wW][^wW]*[wW]?)"
    r"|(?P<table>[tT]+)"
    r"|(?P<heading>[hH])"
    r"|(?P<list>[lL](?:[lL]|[A-Z]|b(?=[lL]))*)"
    r"|(?P<blank>[bB])"
    r"|(?P<paragraph>[pPxX][xX]*)[bB]?"
)


def markdown_blocks(text: str | None) -> list[tuple[str, int, int]]:
    """The blocks of a Markdown text: kind (heading, code_block, table, list, paragraph), from where and to where."""
    if not text:
        return []
    lines = [m.span() for m in LINES.finditer(text) if m.end() > m.start()]
    letters = []
    for start, end in lines:
        bare = text[start:end].strip()
        letter = next((k for k, shape in SHAPES if shape.match(bare)), "x")
        letters.append(letter.upper() if text.startswith(("    ", "\t"), start, end) else letter)
    out = []
    for m in GRAMMAR.finditer("".join(letters)):
        kind = m.lastgroup
        if kind != "blank":
            first, last = m.span(kind)
            out.append((kind, lines[first][0], lines[last - 1][1]))
    return out
