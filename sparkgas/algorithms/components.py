"""Connected components and their one-hop relative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgas.algorithms.contraction import star_labels
from sparkgas.graph import PropertyGraph
from sparkgas.operators.messages import aggregate_messages
from sparkgas.plans.skew import spread_join
from sparkgas.plans.gas import GasResult, Program, run_gas


def _labelled(graph: PropertyGraph, *more) -> PropertyGraph:
    return graph.with_vertices(graph.vertices.select("id", F.col("id").alias("label"), *more))


def connected_components(
    graph: PropertyGraph,
    max_iter: int | None = None,
    edge_visits: bool = False,
    on_limit: str = "error",
) -> GasResult:
    """Smallest vertex id of each weakly connected component, as ``label``.

    Labels alone come from star contraction, in a number of rounds that grows
    with the logarithm of the largest component.  With a limit on rounds or with
    ``edge_visits`` the label program runs, one round per hop:

    An active vertex signals the neighbours with a larger label.  Because a
    label only ever falls, the messages of signalling neighbours are all a
    vertex needs, and it becomes active exactly if the smallest of them is
    below its own label.

    With ``edge_visits`` every edge also gets ``visits``, the number of times
    an active end looked along it; that is how often its two ends were active.
    """

    if max_iter is None and not edge_visits:
        return _contracted(graph)

    def apply(v, acc):
        data = {"label": F.least(v["label"], acc)}
        if edge_visits:
            data["rounds"] = v["rounds"] + 1
        return data

    program = Program(
        gather=lambda t: t.other["label"],
        reducer=F.min,
        apply=apply,
        signal=lambda t: F.lit(True),
        gather_dir="both",
        scatter_dir="both",
        changes_only=True,
        accept=lambda v, acc: acc < v["label"],
    )
    rounds = [F.lit(0).cast("bigint").alias("rounds")] if edge_visits else []
    result = run_gas(_labelled(graph, *rounds), program, max_iter, on_limit)
    if edge_visits:
        result.graph = _with_visits(graph, result.graph.vertices)
    return result


def _contracted(graph: PropertyGraph) -> GasResult:
    labels, rounds = star_labels(graph.inner_edges(), rows_per_piece=graph.rows_per_piece)
    vertices = graph.vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return GasResult(graph.with_vertices(vertices), rounds, converged=True)


def _with_visits(graph: PropertyGraph, vertices: DataFrame) -> PropertyGraph:
    edges = graph.inner_edges()
    for end in ("src", "dst"):
        ends = vertices.select(F.col("id").alias(end), F.col("rounds").alias(f"_{end}_rounds"))
        edges = spread_join(edges, ends, [end], hot=graph.stats().hot(end))
    edges = edges.select(
        *graph.edges.columns, (F.col("_src_rounds") + F.col("_dst_rounds")).alias("visits")
    )
    return graph.with_edges(edges).with_vertices(vertices.drop("rounds"))


def component_visits(
    graph: PropertyGraph, edge_mode: str = "chained", max_iter: int | None = None, on_limit: str = "error"
) -> GasResult:
    """Component labels by a program that counts, in the edge data, both its gather visits.

    The plain form of a program that rewrites edges while it runs: every gather
    along an edge adds one to ``visits``.  "chained" counts both ends of a
    round, "independent" at most one.
    """
    edges = graph.inner_edges().withColumn("visits", F.lit(0).cast("bigint"))
    program = Program(
        gather=lambda t: t.other["label"],
        reducer=F.min,
        apply=lambda v, acc: {"label": F.least(v["label"], acc)},
        signal=lambda t: t.other["label"] > t.center["label"],
        gather_dir="both",
        scatter_dir="both",
        gather_edge_update=lambda t: {"visits": t.edge["visits"] + 1},
        edge_mode=edge_mode,
    )
    return run_gas(_labelled(graph.with_edges(edges)), program, max_iter, on_limit)


def neighborhood_min_id(graph: PropertyGraph) -> DataFrame:
    """``(id, label)``: smallest id among each vertex and its direct neighbours."""
    smallest = aggregate_messages(graph, lambda t: t.other.id, F.min, "both")
    return graph.vertices.select("id").join(smallest, "id", "left").select(
        "id", F.least("id", "acc").alias("label")
    )
