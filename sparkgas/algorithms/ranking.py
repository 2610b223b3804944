"""Rank-like queries: PageRank, its block-ordered form, linear propagation, top vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.graph import PropertyGraph
from sparkgas.operators.derive import attach_vertex_data, degrees
from sparkgas.plans.cluster import cut
from sparkgas.plans.gas import GasResult, Program, run_gas
from sparkgas.plans.layout import ArcLayout
from sparkgas.plans.rounds import iterate_blocked, iterate_fixed

# fixed values of the ranking programs
RESET = 0.15
DAMPING = 0.85


def pagerank(
    graph: PropertyGraph,
    tol: float = 0.001,
    max_iter: int | None = None,
    initial: tuple[float, float] = (1.0, 5.0),
    on_limit: str = "error",
) -> GasResult:
    """Un-normalised PageRank; vertices gain ``rank`` and ``prev``.

    A vertex signals its out-neighbours while its rank still moves by more
    than ``tol``.  ``initial`` is the starting rank and previous rank.
    """
    layout = ArcLayout(graph, "in", [])
    out_degree = layout.sent().select("id", F.col("n").alias("out_degree"))
    vertices = attach_vertex_data(graph.vertices.select("id"), out_degree, "left").select(
        "id",
        F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
        F.lit(float(initial[0])).alias("rank"),
        F.lit(float(initial[1])).alias("prev"),
    )
    program = Program(
        gather=lambda t: F.when(t.src["out_degree"] > 0, DAMPING * t.src["rank"] / t.src["out_degree"]),
        reducer=F.sum,
        default=0.0,
        apply=lambda v, acc: {"rank": acc + RESET, "prev": v["rank"]},
        signal=lambda t: F.abs(t.center["rank"] - t.center["prev"]) > tol,
    )
    try:
        return run_gas(graph.with_vertices(vertices), program, max_iter, on_limit, layout)
    finally:
        layout.release()


def rank_total(graph: PropertyGraph, column: str = "rank") -> DataFrame:
    """One row: the sum of ``column`` over all vertices."""
    return graph.vertices.agg(F.sum(column).alias("total"))


def top_vertices(graph: PropertyGraph, by: str | Column, n: int = 12) -> DataFrame:
    """The ``n`` vertices with the highest value, ties by id."""
    value = F.col(by) if isinstance(by, str) else by
    return graph.vertices.select("id", value.alias("value")).orderBy(F.desc("value"), "id").limit(n)


def pagerank_blocked(
    graph: PropertyGraph, rounds: int, block_size: int = 50_000
) -> PropertyGraph:
    """PageRank from 0 in id blocks that see each other's newest values.

    ``share`` is what a vertex passes along each out-edge.
    """
    vertices = degrees(graph).select(
        "id", "out_degree", F.lit(0.0).alias("rank"), F.lit(0.0).alias("share")
    )

    def apply(v, acc):
        rank = acc + RESET
        return {"rank": rank, "share": F.when(v["out_degree"] > 0, rank / v["out_degree"]).otherwise(0.0)}

    program = Program(gather=lambda t: DAMPING * t.src["share"], reducer=F.sum, default=0.0, apply=apply)
    return iterate_blocked(graph.with_vertices(cut(vertices)), program, rounds, block_size)


def linear_propagation(graph: PropertyGraph, rounds: int = 5) -> DataFrame:
    """``(id, value)`` after rounds of x_v = 0.15 + 0.85 * sum over in-edges of (x_u + x_v / 2).

    All values start at 1; a vertex without an in-edge from a vertex that is
    still there leaves.  The sum splits into the senders' sum and an edge
    count, so edges need to be joined with their source only.
    """
    program = Program(
        gather=lambda t: t.src["value"],
        reducer=lambda m: F.struct(F.sum(m).alias("total"), F.count(m).alias("n")),
        apply=lambda v, acc: {"value": RESET + DAMPING * (acc["total"] + acc["n"] * v["value"] / 2)},
    )
    vertices = graph.vertices.select("id", F.lit(1.0).alias("value"))
    return iterate_fixed(
        graph.with_vertices(vertices), program, rounds, drop_unreached=True
    ).vertices
