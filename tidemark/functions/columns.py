"""Names for helper columns that no caller's column has."""

from __future__ import annotations

from collections.abc import Iterable


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added while a column of that name (in any case) is there."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
