"""Errors of graph operators, each with the offending items."""

from __future__ import annotations


class GraphTopologyError(ValueError):
    """A graph violates a topological requirement."""


class FlowCycleError(GraphTopologyError):
    def __init__(self, cells: list[tuple]):
        super().__init__(f"flow directions form a cycle: {cells[:10]}")
        self.cells = cells


class IncompleteFlowGraphError(GraphTopologyError):
    def __init__(self, edges: list[tuple]):
        super().__init__(f"flow edges are in no arc: {edges[:10]}")
        self.missing_edges = edges


class ArcRangeError(GraphTopologyError):
    """An arc's vertex range is empty, reversed or out of bounds."""


class ConstraintError(GraphTopologyError):
    """A constraint edge can't be recovered, or constraints contradict each other."""
