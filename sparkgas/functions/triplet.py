"""The view of an edge that user functions get.

A user function receives a :class:`Triplet` and returns a Column.  The view
only builds column references and remembers which ones were asked for, so the
planner knows which vertex columns (and which ends) an expression needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class End:
    """One end of an edge: ``end.id`` and ``end["attribute"]``."""

    def __init__(self, read: Callable[[str], Column]):
        self._read = read

    @property
    def id(self) -> Column:
        return self._read("id")

    def __getitem__(self, name: str) -> Column:
        return self._read(name)


class EdgeData:
    """The data columns of an edge: ``edge["attribute"]``."""

    def __init__(self, read: Callable[[str], Column]):
        self._read = read

    def __getitem__(self, name: str) -> Column:
        return self._read(name)


class Triplet:
    """An edge with both ends, seen from one of them.

    ``center`` is the vertex the function runs for and ``other`` the opposite
    end; ``src``, ``dst`` and ``edge`` do not depend on the point of view.
    ``center_prefix``/``other_prefix`` say which columns hold the two ends;
    ``src_is_center`` is True, False or a boolean Column.
    """

    def __init__(
        self,
        center_prefix: str,
        other_prefix: str,
        src_is_center: bool | Column,
        edge_prefix: str = "e_",
        edge_columns: dict[str, Column] | None = None,
    ):
        self.used: set[tuple[str, str]] = set()
        self.used_edge: set[str] = set()
        center = lambda name: self._vertex(center_prefix, name)
        other = lambda name: self._vertex(other_prefix, name)
        if isinstance(src_is_center, Column):
            src = lambda name: F.when(src_is_center, center(name)).otherwise(other(name))
            dst = lambda name: F.when(src_is_center, other(name)).otherwise(center(name))
        else:
            src, dst = (center, other) if src_is_center else (other, center)
        self.center, self.other = End(center), End(other)
        self.src, self.dst = End(src), End(dst)
        self._edge_prefix = edge_prefix
        self._edge_columns = edge_columns
        self.edge = EdgeData(self._edge)

    def _vertex(self, prefix: str, name: str) -> Column:
        self.used.add((prefix, name))
        return F.col(f"`{prefix}{name}`")

    def _edge(self, name: str) -> Column:
        self.used_edge.add(name)
        if self._edge_columns is not None and name in self._edge_columns:
            return self._edge_columns[name]
        return F.col(f"`{self._edge_prefix}{name}`")

    def vertex_columns(self, prefix: str) -> set[str]:
        """Vertex data columns read at one end (the id is always at hand)."""
        return {n for p, n in self.used if p == prefix and n != "id"}
