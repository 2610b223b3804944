"""Messages along edges and their reduction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.functions.reducers import MemberBlocks, Mex, Reducer, as_reducer
from sparkgas.functions.triplet import End, Triplet
from sparkgas.graph import PropertyGraph
from sparkgas.operators.triplets import by_direction, view_triplets

# Ids per row of a stored neighbour set; bounds the size of any one row.
BLOCK_IDS = 65_536


def messages(
    graph: PropertyGraph,
    gather: Callable[[Triplet], Column],
    direction: str = "in",
) -> DataFrame:
    """``(id, msg)``: what every edge sends along ``direction``; NULL sends nothing."""
    centers = {"in": ("dst",), "out": ("src",), "both": ("dst", "src")}[direction]
    rows = view_triplets(graph, centers, lambda t: {"msg": gather(t)})
    pairs = [F.struct(F.col(f"{c[0]}_id").alias("id"), F.col(f"{c}_msg").alias("msg")) for c in centers]
    if len(pairs) == 1:
        sent = rows.select(F.col(f"{centers[0][0]}_id").alias("id"), F.col(f"{centers[0]}_msg").alias("msg"))
    else:
        sent = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.id", "p.msg")
    return sent.where("msg is not null")


def aggregate_messages(
    graph: PropertyGraph,
    gather: Callable[[Triplet], Column],
    reducer: Reducer | Callable[[Column], Column],
    direction: str = "in",
) -> DataFrame:
    """``(id, acc)``: messages of each vertex reduced to one value.

    Built-in aggregates and all reducers combine before the exchange by id, so
    a vertex with very many messages costs its exchange one row per task.
    """
    return as_reducer(reducer).reduce(
        messages(graph, gather, direction), ["id"], "msg", "acc"
    )


def _single(df: DataFrame, value: Column, reducer, out: str) -> DataFrame:
    how = as_reducer(reducer)
    if not isinstance(reducer, Reducer):
        return df.agg(how.aggregate(value).alias(out))
    rows = df.select(F.lit(0).alias("_all"), value.alias("_v")).where("_v is not null")
    return how.reduce(rows, ["_all"], "_v", out).select(out)


def reduce_edges(
    graph: PropertyGraph,
    value: Callable[[Triplet], Column],
    reducer: Reducer | Callable[[Column], Column],
    out: str = "value",
) -> DataFrame:
    """One row: a function of every edge, folded to one value (NULL without edges)."""
    return _single(view_triplets(graph, ("src",), lambda t: {"v": value(t)}), F.col("src_v"), reducer, out)


def reduce_vertices(
    graph: PropertyGraph, value: Column, reducer: Reducer | Callable[[Column], Column], out: str = "value"
) -> DataFrame:
    """One row: a function of every vertex, folded to one value (NULL without vertices)."""
    return _single(graph.vertices, value, reducer, out)


def group_then_reduce(
    graph: PropertyGraph,
    value: Callable[[Triplet], Column],
) -> DataFrame:
    """Sum over each target's in-edges of a value of both ends, without building groups."""
    return aggregate_messages(graph, value, F.sum, "in")


def partial_then_final(
    rows: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], pieces: int, by: list[str] | None = None
) -> DataFrame:
    """Aggregate in two exchanges: per piece of a key first, then per key.

    For aggregates whose state does not shrink before the exchange (sets, for
    example); sums and the like are combined by Spark's own partial step.  Rows
    that agree in the columns ``by`` fall into one piece, so that distinct values
    of these can be counted per piece and added up.
    """
    salt = by or [*rows.columns, F.spark_partition_id()]
    piece = F.pmod(F.xxhash64(*salt), F.lit(pieces))
    parts = rows.withColumn("_piece", piece).groupBy(*keys, "_piece").agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def mex(rows: DataFrame, key: str, value: str, out: str = "mex", limit: int | None = None) -> DataFrame:
    """Per key, the smallest whole number >= 0 that is not among the values.

    ``limit`` bounds the number of values of a key; it is counted if not given.
    """
    if limit is None:
        sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
        limit = sizes.agg(F.max("n")).first()[0] or 0
    return Mex(limit).reduce(rows, [key], value, out)


def neighbor_pairs(graph: PropertyGraph) -> DataFrame:
    """``(id, nbr)``: each neighbour of each vertex once, direction ignored.

    This is the set itself as a table: membership, union and intersection are
    joins, and no vertex needs to fit its neighbours into one row.
    """
    pairs = by_direction(graph, "both")
    return pairs.select(F.col("center").alias("id"), F.col("other").alias("nbr")).distinct()


def neighbor_sets(graph: PropertyGraph, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Sorted arrays of the neighbours of each vertex, in blocks of ids.

    Block ``b`` holds the neighbours in ``[b * block_ids, (b + 1) * block_ids)``,
    so no array is longer than ``block_ids``, whatever the degree.
    """
    block = F.floor(F.col("nbr") / block_ids)
    return (
        neighbor_pairs(graph)
        .groupBy("id", block.alias("block"))
        .agg(F.sort_array(F.collect_list("nbr")).alias("nbrs"))
    )


def apply_by_block(
    graph: PropertyGraph,
    gather: Callable[[Triplet], Column],
    per_block: Callable[[End, Column], Column],
    combine: Callable[[Column], Column],
    direction: str = "in",
    block_ids: int = BLOCK_IDS,
    out: str = "acc",
) -> DataFrame:
    """``(id, out)``: a function of each vertex and the set of its messages, without a bound on the set.

    The set is a table of blocks (see :class:`MemberBlocks`); each block meets the data of
    its vertex, ``per_block(v, members)`` is evaluated there, and ``combine`` aggregates the
    values of a vertex.  Vertices without messages are in no row.
    """
    sets = MemberBlocks(None, None, block_ids).blocks(messages(graph, gather, direction), ["id"], "msg")
    view = End(lambda name: F.col(f"`{name}`"))
    joined = sets.join(graph.vertices, "id")
    return joined.select("id", per_block(view, F.col("_members")).alias("_part")).groupBy("id").agg(combine(F.col("_part")).alias(out))
