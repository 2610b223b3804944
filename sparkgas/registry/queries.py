"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgas.algorithms import coloring, components, paths, ranking, triangles
from sparkgas.functions.columns import any_true, min_nonneg, other_end, own_end
from sparkgas.functions.reducers import Fold, MemberBlocks, Members, VectorFold
from sparkgas.graph import PropertyGraph
from sparkgas.operators import derive, messages, triplets
from sparkgas.plans.cluster import Scratch, cut, delete_path, scratch_path
from sparkgas.plans.gas import ACTIVE, Program, active_count, merge_accumulators, merge_signals, run_gas
from sparkgas.plans.gas import signal_frontier as frontier
from sparkgas.plans.gas import superstep as one_superstep
from sparkgas.plans.rounds import iterate_blocked as blocked
from sparkgas.plans.rounds import iterate_fixed as fixed
from sparkgas.plans.rounds import sync_values as sync
from sparkgas.registry.graphs import order_succession, table, turn_chains
from sparkgas.sources import edge_list, text_dump

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name, less a trailing "_query"."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def _building():
    return F.col("seg") == "BUILDING"


def _r6(name: str):
    return F.round(name, 6).alias(name)


# ---------------------------------------------------------------- sources and sinks


def _through_text(spark, sf_dir, read: Callable[[str], DataFrame], with_weight: bool = True, ordered: bool = False) -> DataFrame:
    """What ``read`` makes of the edges written as text, which is deleted then.  Only line numbers need an order."""
    g = order_succession(spark, sf_dir)
    path = scratch_path(spark, "edges")
    payload = F.col("w").cast("bigint") if with_weight else None
    try:
        edge_list.write_edge_list(g.edges, path, payload, order_by="eid" if ordered else None)
        with Scratch() as scratch:
            result = cut(read(path))
            scratch.keep(result)
        return result
    finally:
        delete_path(spark, path)


@query
def read_edge_list(spark, sf_dir):
    data = {"w": F.col("payload").cast("double")}
    return _through_text(spark, sf_dir, lambda path: edge_list.read_edge_list(spark, path, data).edges)


@query
def read_edge_list_vertices(spark, sf_dir):
    return _through_text(spark, sf_dir, lambda path: edge_list.read_edge_list(spark, path).vertices)


@query
def read_edge_list_strict(spark, sf_dir):
    data = {"w": F.col("payload").cast("double")}
    read = lambda path: edge_list.read_edge_list_strict(spark, path, data).edges.select("eid", "src", "dst", "w")
    return _through_text(spark, sf_dir, read, ordered=True)


@query
def read_edge_list_strict_vertices(spark, sf_dir):
    data = {"data": F.col("id") * 2}
    read = lambda path: edge_list.read_edge_list_strict(spark, path, init=data).vertices
    return _through_text(spark, sf_dir, read, ordered=True)


@query
def from_edges_only(spark, sf_dir):
    read = lambda path: edge_list.from_edges_only(edge_list.parse_edges(spark.read.text(path))).vertices
    return _through_text(spark, sf_dir, read, with_weight=False)


@query
def property_graph(spark, sf_dir):
    g = PropertyGraph(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")),
        order_succession(spark, sf_dir).edges,
        validate=True,
    )
    return g.vertices


@query
def graph_lines(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return text_dump.graph_lines(g, F.col("seg"), F.col("w").cast("bigint"))


@query
def write_graph_lines(spark, sf_dir):
    path = scratch_path(spark, "lines")
    g = order_succession(spark, sf_dir)
    try:
        text_dump.write_graph_lines(g, path, vertex_text=F.col("seg"), edge_text=F.col("w").cast("bigint"))
        return cut(spark.read.text(path).select(F.col("value").alias("line")))
    finally:
        delete_path(spark, path)


@query
def graph_counts(spark, sf_dir):
    return order_succession(spark, sf_dir).counts()


@query
def preview(spark, sf_dir):
    return order_succession(spark, sf_dir).preview(10).select("id", "seg")


# ------------------------------------------------------------------- derived tables


@query
def vertices_from_edges(spark, sf_dir):
    return derive.vertices_from_edges(order_succession(spark, sf_dir).edges)


@query
def densify_vertices(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return derive.densify_vertices(g.edges, g.vertices.select("id", "seg"))


@query
def init_vertices(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return derive.init_vertices(g, lambda i: {"label": i, "start": F.when(i == 1, 0.0).otherwise(-1.0)}).vertices


@query
def init_edges(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    text = g.with_edges(g.edges.select("src", "dst", "eid", F.col("w").cast("bigint").cast("string").alias("payload")))
    return derive.init_edges(text, lambda p: {"w": p.cast("double"), "one": F.lit(1)}).edges


@query
def number_edges(spark, sf_dir):
    edges = order_succession(spark, sf_dir).edges.withColumnRenamed("eid", "orderkey")
    return derive.number_edges(edges, ["orderkey"]).select("eid", "orderkey", "src", "dst")


@query
def degrees(spark, sf_dir):
    return derive.degrees(order_succession(spark, sf_dir)).select("id", "in_degree", "out_degree")


@query
def out_degrees(spark, sf_dir):
    return derive.out_degrees(order_succession(spark, sf_dir).edges)


@query
def attach_vertex_data(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return derive.attach_vertex_data(g.vertices, derive.out_degrees(g.edges)).select("id", "seg", "out_degree")


@query
def vertex_replication(spark, sf_dir):
    return derive.vertex_replication(order_succession(spark, sf_dir).edges, 4)


@query
def vertex_replication_by_edge(spark, sf_dir):
    return derive.vertex_replication(order_succession(spark, sf_dir).edges, 4, by="edge")


@query
def replication_factor(spark, sf_dir):
    return derive.replication_factor(order_succession(spark, sf_dir).edges, 4).select(_r6("factor"))


# ------------------------------------------------------------------------------ joins


@query
def triplets_query(spark, sf_dir):
    t = triplets.triplets(order_succession(spark, sf_dir))
    return t.select("e_eid", "s_id", "s_bal", "s_seg", "d_id", "d_bal", "d_seg", "e_w")


@query
def source_pairs(spark, sf_dir):
    return triplets.source_pairs(order_succession(spark, sf_dir)).select("e_eid", "id", "s_id", "s_bal")


def _heavy_sums(g: PropertyGraph) -> DataFrame:
    """Light edges are read like all others, and send nothing."""
    return messages.aggregate_messages(g, lambda t: F.when(t.edge["w"] > 40, t.edge["w"]), F.sum, "in")


@query
def merge_accumulators_query(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    merged = merge_accumulators(
        g.vertices, _heavy_sums(g), lambda v, acc: {"bal": acc + F.round(v["bal"])}, _building(), default=-1.0
    )
    return merged.select("id", _r6("bal"), F.col(ACTIVE).alias("active"))


@query
def merge_signals_query(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    heavy = messages.messages(g, lambda t: F.when(t.edge["w"] > 40, t.edge["w"]), "in")
    state = g.vertices.withColumn(ACTIVE, F.lit(True))
    return merge_signals(state, heavy.select("id").distinct()).select("id", F.col(ACTIVE).alias("active"))


@query
def sync_values(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    program = Program(gather=lambda t: t.edge["w"], reducer=F.sum, apply=lambda v, acc: {"bal": acc})
    return sync(g.vertices, _heavy_sums(g), program).select("id", "bal", "seg")


@query
def other_end_query(spark, sf_dir):
    e = order_succession(spark, sf_dir).edges
    center = F.greatest("src", "dst")
    return e.select(
        "eid",
        own_end(center, F.col("src"), F.col("dst")).alias("own"),
        other_end(center, F.col("src"), F.col("dst")).alias("other"),
    )


# --------------------------------------------------------------- filters and transforms


@query
def by_direction(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    parts = [
        triplets.by_direction(g, d).select(F.lit(d).alias("direction"), "center", "other")
        for d in ("none", "in", "out", "both")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def active_only(spark, sf_dir):
    return triplets.active_only(order_succession(spark, sf_dir), _building(), "in").select("center", "other")


@query
def active_triplets(spark, sf_dir):
    t = triplets.active_triplets(order_succession(spark, sf_dir), _building())
    return t.select("e_eid", "s_id", "d_id", "s_active", "d_active")


@query
def drop_empty_contributions(spark, sf_dir):
    sent = messages.messages(
        order_succession(spark, sf_dir), lambda t: F.when(t.edge["w"] > 40, t.edge["w"]), "both"
    )
    return sent.select("id", "msg")


@query
def transform_edges(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    new = triplets.transform_edges(
        g, lambda t: {"w": t.edge["w"] + t.src.id, "same": t.src["seg"] == t.dst["seg"]}
    )
    return new.edges.select("eid", "src", "dst", "w", "same")


@query
def transform_vertices(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return triplets.transform_vertices(g, {"bal": F.abs(F.round("bal")), "tag": F.upper("seg")}).vertices


def _rewriting(mode: str) -> Program:
    return Program(
        gather=lambda t: t.edge["w"],
        reducer=F.max,
        default=0.0,
        apply=lambda v, acc: {"bal": acc},
        signal=lambda t: t.edge["w"] > 100,
        gather_dir="both",
        scatter_dir="both",
        gather_edge_update=lambda t: {"w": t.edge["w"] * 2 + F.pmod(t.center.id, F.lit(10))},
        scatter_edge_update=lambda t: {"w": t.edge["w"] + 1},
        edge_mode=mode,
    )


@query
def update_edge_data(spark, sf_dir):
    g, _ = one_superstep(order_succession(spark, sf_dir), _rewriting("chained"), _building())
    return g.edges.select("eid", "src", "dst", "w")


@query
def update_edge_data_independent(spark, sf_dir):
    g, _ = one_superstep(order_succession(spark, sf_dir), _rewriting("independent"), _building())
    return g.edges.select("eid", "src", "dst", "w")


# ------------------------------------------------------------------------ aggregations


@query
def aggregate_messages(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    acc = messages.aggregate_messages(g, lambda t: F.round(t.other["bal"]) * t.edge["w"], F.sum, "both")
    return acc.select("id", _r6("acc"))


@query
def reducer_min(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return messages.aggregate_messages(g, lambda t: t.other.id, F.min, "both")


@query
def reducer_any(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return messages.aggregate_messages(g, lambda t: t.src["seg"] == t.dst["seg"], any_true, "in")


@query
def reducer_union_size(spark, sf_dir):
    """Set union, kept as a table of members; its size per vertex."""
    pairs = messages.neighbor_pairs(order_succession(spark, sf_dir))
    return pairs.groupBy("id").agg(F.count("*").alias("members"))


@query
def min_nonneg_query(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return messages.aggregate_messages(g, lambda t: F.round(t.src["bal"]), min_nonneg, "in")


@query
def reduce_edges(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    total = lambda t: F.when(t.src["seg"] == t.dst["seg"], t.edge["w"]).otherwise(0.0)
    return messages.reduce_edges(g, total, F.sum, "total")


@query
def reduce_vertices(spark, sf_dir):
    return messages.reduce_vertices(order_succession(spark, sf_dir), F.round("bal"), F.sum, "total")


@query
def reduce_vertices_fold(spark, sf_dir):
    keep_larger = Fold(lambda a, b: F.when(a >= b, a).otherwise(b))
    return messages.reduce_vertices(order_succession(spark, sf_dir), F.col("bal"), keep_larger, "largest")


@query
def reducer_fold(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    plus = Fold(lambda a, b: a + b)
    return messages.aggregate_messages(g, lambda t: t.edge["w"], plus, "in")


@query
def reducer_vector_fold(spark, sf_dir):
    """A fold in Python that is combined before its exchange: the heaviest edge along both directions."""
    g = order_succession(spark, sf_dir)
    heavier = VectorFold(lambda a, b: a.where(a >= b, b))
    return messages.aggregate_messages(g, lambda t: t.edge["w"], heavier, "both")


@query
def run_gas_vector_fold(spark, sf_dir):
    """The same kind of fold inside a program: the largest id that reaches each customer."""
    g = order_succession(spark, sf_dir)
    program = Program(
        gather=lambda t: t.src["top"],
        reducer=VectorFold(lambda a, b: a.where(a >= b, b)),
        apply=lambda v, acc: {"top": F.greatest(v["top"], acc)},
        signal=lambda t: t.center["top"] > t.other["top"],
    )
    start = g.with_vertices(g.vertices.select("id", F.col("id").alias("top")))
    return run_gas(start, program, max_iter=3, on_limit="return").graph.vertices


@query
def group_then_reduce(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    sums = messages.group_then_reduce(g, lambda t: F.round(t.dst["bal"]) + F.round(t.src["bal"]) / 2)
    return sums.select("id", _r6("acc"))


@query
def partial_then_final(spark, sf_dir):
    e = order_succession(spark, sf_dir).edges.select(F.col("dst").alias("id"), "w", "eid")
    return messages.partial_then_final(
        e, ["id"], {"s": F.sum("w"), "n": F.count("*")}, {"total": F.sum("s"), "n": F.sum("n")}, pieces=8
    )


@query
def partial_then_final_distinct(spark, sf_dir):
    """Distinct senders per segment: a set does not shrink before its exchange, so few keys are cut into pieces."""
    t = triplets.triplets(order_succession(spark, sf_dir)).select(F.col("d_seg").alias("seg"), "s_id")
    return messages.partial_then_final(
        t, ["seg"], {"n": F.count_distinct("s_id")}, {"senders": F.sum("n")}, pieces=16, by=["s_id"]
    )


@query
def reducer_members(spark, sf_dir):
    """Set union inside a program: the segments around each customer."""
    g = order_succession(spark, sf_dir)
    program = Program(
        gather=lambda t: t.other["seg"],
        reducer=Members(16),
        apply=lambda v, acc: {"around": F.array_join(acc, ",")},
        gather_dir="both",
    )
    start = g.with_vertices(g.vertices.select("id", "seg", F.lit("").alias("around")))
    return run_gas(start, program).graph.vertices.select("id", "around")


@query
def active_count_query(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return active_count(g.vertices.withColumn("active", _building()), "active")


@query
def mex(spark, sf_dir):
    e = order_succession(spark, sf_dir).edges
    return messages.mex(e.select(F.col("src").alias("id"), (F.col("dst") % 10).alias("v")), "id", "v")


@query
def neighbor_sets(spark, sf_dir):
    sets = messages.neighbor_sets(order_succession(spark, sf_dir))
    return sets.select("id", "block", F.array_join("nbrs", ",").alias("nbrs"))


@query
def distinct_pairs(spark, sf_dir):
    return derive.distinct_pairs(order_succession(spark, sf_dir).edges.select("src", "dst"))


@query
def apply_by_block(spark, sf_dir):
    """For each vertex, how many distinct neighbours of higher id agree with it modulo 5, and their sum."""
    mine = lambda v, members: F.filter(members, lambda m: (m > v["id"]) & (m % 5 == v["id"] % 5))
    sums = lambda ids: F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x)
    found = messages.apply_by_block(
        order_succession(spark, sf_dir),
        lambda t: t.other["id"],
        lambda v, members: F.struct(F.size(mine(v, members)).alias("n"), sums(mine(v, members)).alias("s")),
        lambda part: F.struct(F.sum(part["n"]).alias("n"), F.sum(part["s"]).alias("s")),
        "both",
        block_ids=256,
    )
    return found.select("id", F.col("acc.n").alias("n"), F.col("acc.s").alias("s"))


# --------------------------------------------------------------------------- iteration


def _first_source(g: PropertyGraph) -> int:
    return g.edges.agg(F.min("src")).first()[0]


@query
def run_gas_query(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    result = paths.hop_counts(g, _first_source(g))
    return result.graph.vertices.select("id", "hops")


@query
def run_gas_chained(spark, sf_dir):
    result = components.component_visits(order_succession(spark, sf_dir), "chained")
    return result.graph.edges.select("eid", "src", "dst", "visits")


@query
def run_gas_independent(spark, sf_dir):
    result = components.component_visits(order_succession(spark, sf_dir), "independent")
    return result.graph.edges.select("eid", "src", "dst", "visits")


@query
def run_gas_one_sided(spark, sf_dir):
    """Gather and scatter along in-edges only: signals run against the messages."""
    g = order_succession(spark, sf_dir)
    program = Program(
        gather=lambda t: t.other["top"],
        reducer=F.max,
        apply=lambda v, acc: {"top": F.greatest(v["top"], acc)},
        signal=lambda t: t.center["top"] < t.other["top"],
        gather_dir="in",
        scatter_dir="in",
    )
    result = run_gas(g.with_vertices(g.vertices.select("id", F.col("id").alias("top"))), program)
    return result.graph.vertices


@query
def run_gas_pandas(spark, sf_dir):
    """Any vectorised Python function fits where a Column does."""

    @F.pandas_udf("double")
    def damped(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for value, weight in batches:
            yield (value * 0.5 + weight).floordiv(1)

    g = order_succession(spark, sf_dir)
    program = Program(
        gather=lambda t: damped(t.src["value"], t.edge["w"]),
        reducer=F.max,
        default=0.0,
        apply=lambda v, acc: {"value": F.greatest(v["value"], acc), "prev": v["value"]},
        signal=lambda t: t.center["value"] > t.center["prev"],
    )
    start = g.with_vertices(g.vertices.select("id", F.lit(1.0).alias("value"), F.lit(0.0).alias("prev")))
    return run_gas(start, program).graph.vertices.select("id", _r6("value"))


@query
def run_gas_pandas_slots(spark, sf_dir):
    """Vectorised Python functions in the other slots: apply, signal and edge updates, for two rounds."""

    @F.pandas_udf("double")
    def larger(value: pd.Series, heard: pd.Series) -> pd.Series:
        return value.where(value >= heard, heard)

    @F.pandas_udf("boolean")
    def above(a: pd.Series, b: pd.Series) -> pd.Series:
        return a > b

    @F.pandas_udf("double")
    def aged(weight: pd.Series, value: pd.Series) -> pd.Series:
        return weight + 1 + value % 2

    g = order_succession(spark, sf_dir)
    program = Program(
        gather=lambda t: F.floor(t.src["value"] * 0.5 + t.edge["w"]).cast("double"),
        reducer=F.max,
        default=0.0,
        apply=lambda v, acc: {"value": larger(v["value"], acc)},
        signal=lambda t: above(t.center["value"], t.other["value"]),
        gather_edge_update=lambda t: {"w": aged(t.edge["w"], t.center["value"])},
    )
    start = g.with_vertices(g.vertices.select("id", F.lit(1.0).alias("value")))
    after = run_gas(start, program, max_iter=2, on_limit="return").graph
    ends = after.vertices.select(F.col("id").alias("dst"), _r6("value"))
    return after.edges.join(ends, "dst").select("eid", _r6("w"), "value")


@query
def run_gas_set_blocks(spark, sf_dir):
    """Two rounds on whole sets of neighbours' values: a value is the size and the sum of the set."""
    sums = lambda members: F.aggregate(members, F.lit(0).cast("bigint"), lambda a, x: a + x)
    program = Program(
        gather=lambda t: t.other["value"],
        reducer=MemberBlocks(
            lambda members: F.struct(F.size(members).alias("n"), sums(members).alias("s")),
            lambda part: F.struct(F.sum(part["n"]).alias("n"), F.sum(part["s"]).alias("s")),
            block_ids=256,
        ),
        apply=lambda v, acc: {"value": F.coalesce(acc["n"] + acc["s"] % 1000, F.lit(0))},
        signal=lambda t: F.lit(True),
        gather_dir="both",
        scatter_dir="both",
    )
    g = order_succession(spark, sf_dir)
    start = g.with_vertices(g.vertices.select("id", F.col("id").alias("value")))
    return run_gas(start, program, max_iter=2, on_limit="return").graph.vertices


@query
def iterate_fixed(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    ranked = g.with_vertices(derive.degrees(g).select("id", "out_degree", F.lit(1.0).alias("rank")))
    program = Program(
        gather=lambda t: F.when(t.src["out_degree"] > 0, t.src["rank"] / t.src["out_degree"]),
        reducer=F.sum,
        default=0.0,
        apply=lambda v, acc: {"rank": 0.15 + 0.85 * acc},
    )
    return fixed(ranked, program, rounds=5).vertices.select("id", _r6("rank"))


def _half_range(g: PropertyGraph) -> int:
    return g.vertices.agg(F.max("id")).first()[0] // 2 + 1


@query
def iterate_blocked(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    g = g.with_vertices(g.vertices.select("id", F.col("id").alias("label")))
    program = Program(
        gather=lambda t: t.src["label"], reducer=F.min, apply=lambda v, acc: {"label": F.least(v["label"], acc)}
    )
    return blocked(g, program, rounds=2, block_size=_half_range(g)).vertices


@query
def signal_frontier(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return frontier(g, _building(), lambda t: t.src.id < t.dst.id, "out")


@query
def superstep(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    start = g.with_vertices(
        derive.degrees(g).select("id", "out_degree", F.lit(1.0).alias("rank"), F.lit(5.0).alias("prev"))
    )
    program = Program(
        gather=lambda t: F.when(t.src["out_degree"] > 0, 0.85 * t.src["rank"] / t.src["out_degree"]),
        reducer=F.sum,
        default=0.0,
        apply=lambda v, acc: {"rank": acc + 0.15, "prev": v["rank"]},
        signal=lambda t: F.abs(t.center["rank"] - t.center["prev"]) > 0.5,
    )
    return one_superstep(start, program)[1].select("id", _r6("rank"), "active")


# --------------------------------------------------------------------------- algorithms


@query
def pagerank(spark, sf_dir):
    return ranking.pagerank(order_succession(spark, sf_dir)).graph.vertices.select("id", _r6("rank"))


@query
def pagerank_capped(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    ranks = ranking.pagerank(g, tol=0.01, max_iter=10, initial=(1.0, 1.0), on_limit="return").graph.vertices
    return ranks.select("id", _r6("rank"))


@query
def pagerank_blocked(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return ranking.pagerank_blocked(g, rounds=3, block_size=_half_range(g)).vertices.select("id", _r6("rank"))


@query
def linear_propagation(spark, sf_dir):
    return ranking.linear_propagation(order_succession(spark, sf_dir)).select("id", _r6("value"))


@query
def connected_components(spark, sf_dir):
    return components.connected_components(order_succession(spark, sf_dir)).graph.vertices


@query
def connected_components_turns(spark, sf_dir):
    return components.connected_components(turn_chains(spark, sf_dir)).graph.vertices


@query
def connected_components_visits(spark, sf_dir):
    result = components.connected_components(order_succession(spark, sf_dir), edge_visits=True)
    return result.graph.edges.select("eid", "src", "dst", "visits")


@query
def degrees_of_some(spark, sf_dir):
    """Vertices are some of the customers, so many edges lead nowhere."""
    g = order_succession(spark, sf_dir)
    some = PropertyGraph(g.vertices.where("seg in ('BUILDING', 'MACHINERY')"), g.edges)
    return derive.degrees(some).select("id", "in_degree", "out_degree")


@query
def neighborhood_min_id(spark, sf_dir):
    return components.neighborhood_min_id(order_succession(spark, sf_dir))


@query
def greedy_color(spark, sf_dir):
    return coloring.greedy_color(order_succession(spark, sf_dir)).graph.vertices.select("id", "color")


@query
def shortest_paths(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    return paths.distances(paths.shortest_paths(g, _first_source(g)))


@query
def triangle_count(spark, sf_dir):
    return triangles.triangle_count(order_succession(spark, sf_dir))


@query
def edge_common_neighbors(spark, sf_dir):
    e = triangles.edge_common_neighbors(order_succession(spark, sf_dir))
    return e.select("eid", "src", "dst", "common")


@query
def edge_sum_to_vertices(spark, sf_dir):
    g = order_succession(spark, sf_dir)
    g = g.with_edges(g.edges.withColumn("w", F.col("w").cast("bigint")))
    return triangles.edge_sum_to_vertices(g, "w")


def _ranked(spark, sf_dir) -> PropertyGraph:
    return ranking.pagerank(order_succession(spark, sf_dir)).graph


@query
def top_vertices(spark, sf_dir):
    return ranking.top_vertices(_ranked(spark, sf_dir), F.round("rank", 6))


@query
def rank_total(spark, sf_dir):
    return ranking.rank_total(_ranked(spark, sf_dir)).select(F.round("total", 6).alias("total"))
