"""Distances from one vertex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.functions.columns import changed
from sparkgas.graph import PropertyGraph
from sparkgas.plans.cluster import Scratch, cut
from sparkgas.plans.gas import GasResult, Program, run_gas
from sparkgas.plans.layout import arcs_of
from sparkgas.plans.regions import least_sums

# Rounds of one edge each; longer ways go on by regions.
NEAR = 32


def shortest_paths(
    graph: PropertyGraph,
    source: int,
    weight: str = "w",
    max_iter: int | None = None,
    on_limit: str = "error",
) -> GasResult:
    """Distance from ``source`` along edges in either direction, as ``dist``.

    A weight below 0 is an error, found when the edges are laid out.  Unreached vertices have NULL while the
    program runs; :func:`distances` shows them as -1.
    """
    program = Program(
        gather=lambda t: t.other["dist"] + t.edge[weight],
        reducer=F.min,
        apply=lambda v, acc: {"dist": F.least(v["dist"], acc), "prev": v["dist"]},
        signal=lambda t: changed(t.center["dist"], t.center["prev"]),
        gather_dir="both",
        scatter_dir="both",
        changes_only=True,
    )
    checked = F.when(F.col(weight) >= 0, F.col(weight)).when(
        F.col(weight) < 0, F.raise_error(F.concat(F.lit("negative weight: "), F.col(weight).cast("string"))).cast("double")
    )
    graph = graph.with_edges(graph.edges.withColumn(weight, checked))
    vertices = graph.vertices.select(
        "id", F.when(F.col("id") == source, 0.0).alias("dist"), F.lit(None).cast("double").alias("prev")
    )
    return _run(graph.with_vertices(vertices), program, "dist", F.col(weight), max_iter, on_limit)


def distances(result: GasResult) -> DataFrame:
    """``(id, dist)`` with -1 for vertices that were not reached."""
    return result.graph.vertices.select("id", F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def hop_counts(graph: PropertyGraph, source: int, max_iter: int | None = None) -> GasResult:
    """Number of edges on the shortest directed way from ``source``, as ``hops`` (NULL: none)."""
    program = Program(
        gather=lambda t: t.src["hops"] + 1,
        reducer=F.min,
        apply=lambda v, acc: {"hops": F.least(v["hops"], acc), "prev": v["hops"]},
        signal=lambda t: changed(t.center["hops"], t.center["prev"]),
        changes_only=True,
    )
    vertices = graph.vertices.select(
        "id", F.when(F.col("id") == source, 0).cast("bigint").alias("hops"), F.lit(None).cast("bigint").alias("prev")
    )
    return _run(graph.with_vertices(vertices), program, "hops", F.lit(1), max_iter)


def _run(graph: PropertyGraph, program: Program, column: str, weight: Column, max_iter: int | None, on_limit: str = "error") -> GasResult:
    """The program's result; without a cap, what is further than ``NEAR`` rounds is reached region by region."""
    ids = graph.vertices.schema["id"].dataType.simpleString()
    if max_iter is not None or ids not in ("bigint", "int", "smallint", "tinyint"):
        return run_gas(graph, program, max_iter, on_limit)
    with Scratch() as scratch:
        near = run_gas(graph, program, NEAR, "return")
        if near.converged:
            scratch.keep(*scratch.written)
            return near
        state = near.graph.vertices
        # only vertices of the table pass anything on
        edges = PropertyGraph(state.select("id"), graph.edges.withColumn("_w", weight)).inner_edges()
        arcs = arcs_of(edges, program.gather_dir, ["_w"])
        far = least_sums(
            arcs.select(F.col("snd_id").cast("bigint").alias("snd"), F.col("rcv_id").cast("bigint").alias("rcv"), F.col("e__w").alias("w")),
            state.select(F.col("id").cast("bigint").alias("id"), F.col(column).alias("far")).distinct(),
        )
        if far is None:
            rest = run_gas(near.graph, program, None, on_limit)
            scratch.keep(*scratch.written)
            return GasResult(rest.graph, near.iterations + rest.iterations, near.active_history + rest.active_history, rest.converged)
        found, more = far
        value = F.coalesce(F.col("far").cast(state.schema[column].dataType), F.col(column))
        joined = state.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
        whole = cut(joined.select("id", value.alias(column), value.alias("prev")))
        scratch.keep(whole)
    return GasResult(graph.with_vertices(whole), near.iterations + len(more), near.active_history + more, True)
