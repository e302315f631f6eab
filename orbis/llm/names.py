"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each lengthened until no column is called so; Spark doesn't tell case apart."""
    have, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
