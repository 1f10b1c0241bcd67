"""Names for helper columns."""

from __future__ import annotations

from collections.abc import Iterable


def free_prefix(columns: Iterable[str]) -> str:
    """A prefix that no column starts with, so helper columns never meet an input column."""
    prefix = "_of_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix
