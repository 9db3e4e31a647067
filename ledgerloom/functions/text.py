"""Pieces of SQL text.

Wide projections and aggregates are written as SQL text: one text per column is
parsed once in the JVM, where building the same tree from Python takes a call per node.
"""

from __future__ import annotations

import math


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value) -> str:
    """A constant as SQL text."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"not a finite constant: {value}")
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def as_double(name: str) -> str:
    return f"cast({quoted(name)} as double)"


def named(expression: str, name: str) -> str:
    return f"{expression} as {quoted(name)}"
