"""Column names that clash with none of the caller's."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], wanted: str) -> str:
    """`wanted`, with underscores behind it until no column has it (names differ by more than case)."""
    taken = {name.lower() for name in taken}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    """A name for F.col that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"
