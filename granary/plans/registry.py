"""The named queries of the core library and their SQL oracles.

Each module of queries adds its own by the decorator; importing this one gives all of them. The supplied tables
stand in for the record sets: documents for a corpus with source as project, benchmark for targets of another corpus,
events for votes of three members and their reasons, conversations for histories, labels for ground truth.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def put(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return put


from granary.plans import aggregates, code, commands, files, joined, retrievals, rows, texts, votes  # noqa: E402, F401
