"""Explicit transactions: a staged copy of the graph's tables, kept or dropped as a whole."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

from arbora.sources.graph import Graph


@contextmanager
def transaction(graph: Graph):
    """Statements inside see their own writes; an error, or ``rollback``, leaves the graph as it was."""
    inside = replace(graph, nodes=list(graph.nodes), rels=list(graph.rels), indexes=list(graph.indexes), constraints=list(graph.constraints), triggers=dict(graph.triggers))
    inside.rolled_back = False
    yield inside
    if not inside.rolled_back:
        for kept in ("nodes", "rels", "indexes", "constraints", "triggers"):
            setattr(graph, kept, getattr(inside, kept))


def rollback(inside: Graph) -> None:
    inside.rolled_back = True
