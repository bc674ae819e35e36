"""Enclosing scopes in a source file, for descriptors that several things share.

A descriptor names the classes around a thing but not always the functions, so closures of two functions can share
one. What lies around a place is the nearest scope before it that is indented less. Scopes with one symbol inside one
scope are the same, however often they are written again.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby
from pathlib import Path

import pandas as pd

#: What nested() reads and gives, as tables.
PLACES = "path string, symbol string, descriptor string, line int, column int, end_line int, end_column int, indent int, opens boolean, defines boolean"
NESTED = "path string, symbol string, qualifier string, line int, column int, end_line int, end_column int"
_DECLARES = re.compile(r"(^|\s)(async\s+def|def|class)\s*$")


class Source:
    """Lines of a file below root; unreadable files, and paths that lead out of root, have none."""

    def __init__(self, root: str | Path | None, path: str):
        self.lines: list[str] | None = None
        if root is None:
            return
        file = (Path(root) / path).resolve()
        try:
            if file.is_relative_to(Path(root).resolve()):
                self.lines = file.read_text(encoding="utf-8").splitlines()
        except (OSError, UnicodeDecodeError):
            pass

    def indent(self, line: int, column: int) -> int:
        """Blanks before the text of a line; the column of the name where the line is unknown."""
        if self.lines is None or line >= len(self.lines):
            return column
        text = self.lines[line]
        return len(text) - len(text.lstrip(" \t"))

    def declares(self, line: int, column: int) -> bool:
        """Whether the name at a place is the one that a def or class statement declares; False where unknown."""
        if self.lines is None or line >= len(self.lines) or column > len(self.lines[line]):
            return False
        return bool(_DECLARES.search(self.lines[line][:column]))


def joined(outer: str, descriptor: str) -> str:
    """A descriptor inside a function: the module stands once, in front."""
    return f"{outer.rstrip('.')}.<locals>.{descriptor.rsplit('/', 1)[-1]}"


def _sweep(places: pd.DataFrame) -> tuple[list[tuple], dict]:
    """Scopes (symbol, number of the scope around, descriptor), and by symbol the scope of each definition's last place."""
    numbers: dict[tuple, int] = {}
    scopes: list[tuple] = []
    defined: dict[tuple, dict] = {}
    around: list[tuple[int, int]] = []  # (indent, scope), ever deeper: the scopes that a later place can lie in
    ordered = places.sort_values(["line", "column", "end_line", "end_column"], kind="stable")
    for _, here in groupby(ordered.itertuples(index=False), key=lambda p: (p.line, p.column)):
        opened = []
        for p in here:
            parent = next((scope for indent, scope in reversed(around) if indent < p.indent), None)
            if p.opens:
                key = (p.symbol, parent)
                if key not in numbers:
                    numbers[key] = len(scopes)
                    scopes.append((p.symbol, parent, p.symbol if p.descriptor is None else p.descriptor))
                opened.append((p.indent, numbers[key]))
            if p.defines:
                defined.setdefault((p.symbol, p.descriptor), {})[parent] = (p.line, p.column, p.end_line, p.end_column)
        for indent, scope in opened:
            while around and around[-1][0] >= indent:
                around.pop()
            around.append((indent, scope))
    return scopes, defined


def nested(places: pd.DataFrame) -> pd.DataFrame:
    """NESTED rows of one file's PLACES: one for each scope of a symbol that two or more scopes define.

    The qualifier is what joined() puts before the descriptor, null where the scope is told by the descriptor itself
    (a class). Definitions outside every scope get no row.
    """
    scopes, defined = _sweep(places)
    shared = Counter(symbol for symbol, _, _ in scopes)
    prefixes: list[str | None] = []

    def qualifier(descriptor: str, scope: int) -> str | None:
        prefix, outer = prefixes[scope], scopes[scope][2]
        if descriptor != outer and descriptor.startswith(outer):
            return prefix  # the descriptor names that scope already
        return outer if prefix is None else joined(prefix, outer)

    for symbol, parent, descriptor in scopes:  # a scope comes after the one around it
        prefixes.append(None if parent is None or shared[symbol] == 1 else qualifier(descriptor, parent))
    rows = []
    for (symbol, descriptor), lasts in defined.items():
        lasts.pop(None, None)
        if len(lasts) > 1 and descriptor is not None:
            rows += [(places["path"].iloc[0], symbol, qualifier(descriptor, scope), *at) for scope, at in lasts.items()]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NESTED.split(", ")])
