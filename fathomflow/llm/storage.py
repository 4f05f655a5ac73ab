"""Where operators keep intermediate tables, and names that clash with no column."""

from __future__ import annotations

from fathomflow.sources.shared import BATCH_BYTES, SMALL_ROWS, bounded_batches, broadcast_if_small, new_path, shared_folder, written

__all__ = ["BATCH_BYTES", "SMALL_ROWS", "bounded_batches", "broadcast_if_small", "new_path", "shared_folder", "unused", "written"]


def unused(columns: list[str], name: str) -> str:
    """The name, with as many underscores as keep it apart from the given columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
