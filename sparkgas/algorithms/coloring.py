"""Greedy colouring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkgas.functions.columns import changed
from sparkgas.functions.reducers import Mex
from sparkgas.graph import PropertyGraph
from sparkgas.plans.gas import GasResult, Program, run_gas
from sparkgas.plans.layout import ArcLayout


def greedy_color(
    graph: PropertyGraph, max_iter: int | None = None, on_limit: str = "error"
) -> GasResult:
    """``color``: the smallest number no neighbour with a higher id has.

    Self-loops are left out.  Colours only ever travel from higher to lower
    ids, so each pair of neighbours is kept once, pointing that way.
    """
    pairs = graph.inner_edges().where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    ).distinct()
    oriented = PropertyGraph(
        graph.vertices.select("id"), pairs, complete=graph.complete, rows_per_piece=graph.rows_per_piece
    )
    layout = ArcLayout(oriented, "in", [])
    program = Program(
        gather=lambda t: t.src["color"],
        reducer=Mex(layout.most_received),
        default=0,
        apply=lambda v, acc: {"color": acc, "prev": v["color"]},
        signal=lambda t: changed(t.center["color"], t.center["prev"]),
    )
    vertices = oriented.vertices.select("id", F.col("id").alias("color"), F.col("id").alias("prev"))
    try:
        result = run_gas(oriented.with_vertices(vertices), program, max_iter, on_limit, layout=layout)
    finally:
        layout.release()
    result.graph = graph.with_vertices(result.graph.vertices)
    return result
