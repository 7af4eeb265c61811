"""All queries of the subpackage, by name, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from gleanworks.llm import queries as q


def queries() -> dict[str, Callable]:
    return dict(q.QUERIES)


def sql() -> dict[str, str]:
    return dict(q.SQL)
