"""Import every query module so the registry is complete."""

from __future__ import annotations

_loaded = False


def load() -> None:
    global _loaded
    if _loaded:
        return
    from . import q_entries, q_io, q_jobs, q_prep, q_rank, q_stream, queries  # noqa: F401
    _loaded = True
