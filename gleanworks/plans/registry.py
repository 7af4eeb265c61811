"""All queries of the core, by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from gleanworks.plans import extra, files, intervals, outlines, planning, small, streams, texts, timeline

_MODULES = (intervals, files, timeline, outlines, texts, planning, streams, small, extra)


def queries() -> dict[str, Callable]:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
