"""Joins of edges with their ends, and what is built directly on them.

These run once, with adaptive planning on, which splits the rows of hot ends;
nothing is counted beforehand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.functions.triplet import Triplet
from sparkgas.graph import PropertyGraph


def _ends(vertices: DataFrame, prefix: str, columns: list[str] | None = None) -> DataFrame:
    columns = [c for c in vertices.columns if c != "id"] if columns is None else columns
    return vertices.select(F.col("id").alias(f"{prefix}id"), *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns])


def _edge_rows(edges: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = [c for c in edges.columns if c not in ("src", "dst")] if columns is None else columns
    return edges.select(
        F.col("src").alias("s_id"), F.col("dst").alias("d_id"), *[F.col(f"`{c}`").alias(f"e_{c}") for c in columns]
    )


def triplets(graph: PropertyGraph) -> DataFrame:
    """Every edge with the data of both ends.

    Columns: ``s_id, s_<data>…, d_id, d_<data>…, e_<data>…``.
    """
    rows = _edge_rows(graph.edges).join(_ends(graph.vertices, "s_"), "s_id")
    return rows.join(_ends(graph.vertices, "d_"), "d_id")


def source_pairs(graph: PropertyGraph) -> DataFrame:
    """Every edge with the data of its source, keyed by target: the one-join form.

    Columns: ``id`` (the target), ``s_id``, ``s_<data>…``, ``e_<data>…``.
    """
    rows = _edge_rows(graph.inner_edges()).join(_ends(graph.vertices, "s_"), "s_id")
    return rows.withColumnRenamed("d_id", "id")


def view_triplets(
    graph: PropertyGraph, centers: tuple[str, ...], exprs: Callable[[Triplet], dict[str, Column]],
    extra: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Evaluate ``exprs`` on every edge for each end named in ``centers`` ("src", "dst").

    Only the ends, and only the columns, that the expressions read are joined.
    ``extra`` names vertex columns to carry along per end.  Columns: ``s_id``,
    ``d_id``, the extras, and ``src_<name>`` / ``dst_<name>`` per center.
    """
    extra = extra or {}
    out, used, used_edge = [], set(), set()
    for center in centers:
        t = Triplet("s_", "d_", True) if center == "src" else Triplet("d_", "s_", False)
        out += [c.alias(f"{center}_{n}") for n, c in exprs(t).items()]
        used |= t.used
        used_edge |= t.used_edge
    rows = _edge_rows(graph.edges, sorted(used_edge))
    for prefix, end in (("s_", "src"), ("d_", "dst")):
        columns = sorted({n for p, n in used if p == prefix and n != "id"} | set(extra.get(end, [])))
        if columns or not graph.complete:
            ends = _ends(graph.vertices, prefix, columns)
            how = "inner" if columns else "left_semi"
            rows = rows.join(ends, f"{prefix}id", how)
    carried = [f"`{p}{c}`" for p, e in (("s_", "src"), ("d_", "dst")) for c in extra.get(e, [])]
    return rows.select("s_id", "d_id", *carried, *out)


def by_direction(graph: PropertyGraph, direction: str) -> DataFrame:
    """``(center, other)`` of every edge visit along ``direction``."""
    if direction == "none":
        ways = None
    elif direction == "in":
        ways = [("dst", "src")]
    elif direction == "out":
        ways = [("src", "dst")]
    elif direction == "both":
        ways = [("dst", "src"), ("src", "dst")]
    else:
        raise ValueError(f"unknown direction {direction!r}")
    e = graph.inner_edges()
    if ways is None:
        return e.select(F.col("dst").alias("center"), F.col("src").alias("other")).where(F.lit(False))
    visits = F.array(*[F.struct(F.col(c).alias("center"), F.col(o).alias("other")) for c, o in ways])
    return e.select(F.explode(visits).alias("v")).select("v.center", "v.other")


def active_only(graph: PropertyGraph, active: Column, direction: str = "in") -> DataFrame:
    """Edge visits whose center is active, as ``(center, other)``."""
    ids = graph.vertices.where(active).select(F.col("id").alias("center"))
    return by_direction(graph, direction).join(ids, "center").select("center", "other")


def active_triplets(graph: PropertyGraph, active: Column) -> DataFrame:
    """Triplets with at least one active end (``s_active``, ``d_active`` show which)."""
    flagged = graph.with_vertices(graph.vertices.withColumn("active", active))
    return triplets(flagged).where(F.col("s_active") | F.col("d_active"))


def transform_edges(graph: PropertyGraph, data: Callable[[Triplet], dict[str, Column]]) -> PropertyGraph:
    """New edge data from a function of the triplet; unread ends are not joined.

    The edges of the result are those between vertices, whatever the function reads.
    """
    t = Triplet("s_", "d_", True)
    news = data(t)
    rows = _edge_rows(graph.edges)
    for prefix in ("s_", "d_"):
        columns = sorted(t.vertex_columns(prefix))
        if columns or not graph.complete:
            ends = _ends(graph.vertices, prefix, columns)
            rows = rows.join(ends, f"{prefix}id", "inner" if columns else "left_semi")
    keep = [c for c in graph.edge_columns if c not in news]
    return graph.with_edges(
        rows.select(
            F.col("s_id").alias("src"),
            F.col("d_id").alias("dst"),
            *[F.col(f"`e_{c}`").alias(c) for c in keep],
            *[c.alias(n) for n, c in news.items()],
        )
    )


def transform_vertices(graph: PropertyGraph, data: dict[str, Column]) -> PropertyGraph:
    """New vertex data from expressions over the vertex columns."""
    return graph.with_vertices(graph.vertices.withColumns(data))
