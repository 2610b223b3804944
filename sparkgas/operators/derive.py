"""Tables derived from the tables of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgas.graph import PropertyGraph
from sparkgas.plans.cluster import cut

# mixing of both ends of an edge into a partition number
MIX_MODULUS = 2_147_483_647
MIX_FACTOR = 31


def vertices_from_edges(edges: DataFrame) -> DataFrame:
    """Every id that occurs in an edge, with its total degree (a loop counts twice)."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("id"))
        .groupBy("id")
        .agg(F.count("*").alias("degree"))
    )


def densify_vertices(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Every id from 0 to the largest one in the edges, isolated ones included.  Ids below 0 are an error."""
    low, top = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
    if low is not None and low < 0:
        raise ValueError(f"ids must not be negative: {low}")
    ids = edges.sparkSession.range(0 if top is None else top + 1)
    return ids if vertices is None else ids.join(vertices, "id", "left")


def init_vertices(graph: PropertyGraph, data: Callable[[Column], dict[str, Column]]) -> PropertyGraph:
    """Vertex data computed from the id."""
    return graph.with_vertices(
        graph.vertices.select("id", *[c.alias(n) for n, c in data(F.col("id")).items()])
    )


def init_edges(graph: PropertyGraph, data: Callable[[Column], dict[str, Column]], payload: str = "payload") -> PropertyGraph:
    """Typed edge data computed from the text of the payload column."""
    keep = [c for c in graph.edges.columns if c != payload]
    return graph.with_edges(
        graph.edges.select(*keep, *[c.alias(n) for n, c in data(F.col(payload)).items()])
    )


def number_edges(edges: DataFrame, order_by: list[str], name: str = "eid") -> DataFrame:
    """Sequential edge numbers from 0 in the given order.

    Rows are range-partitioned and written once in order; only the row count of
    each written partition is then summed up to give the offsets.
    """
    ordered = cut(
        edges.withColumn("_tie", F.xxhash64(*edges.columns))
        .repartitionByRange(*order_by, "_tie", F.spark_partition_id())
        .sortWithinPartitions(*order_by, "_tie")
        .drop("_tie")
    ).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset")
    )
    # one row per written partition
    return ordered.join(F.broadcast(offsets), "_part").select(
        *edges.columns, (F.col("_at") + F.col("_offset")).alias(name)
    )


def degrees(graph: PropertyGraph) -> DataFrame:
    """Vertices with ``in_degree`` and ``out_degree``: one pass over the edges."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    counted = (
        graph.inner_edges().select(F.explode(ends).alias("e"))
        .groupBy(F.col("e.id").alias("id"))
        .agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    )
    return attach_vertex_data(graph.vertices, counted, "left").fillna(0, ["in_degree", "out_degree"])


def out_degrees(edges: DataFrame) -> DataFrame:
    """Out-degree of every vertex that has an out-edge."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))


def attach_vertex_data(vertices: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Vertices joined with a table that has one row per id."""
    return vertices.join(table, "id", how)


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each row once."""
    return pairs.dropDuplicates()


def vertex_partitions(edges: DataFrame, n: int, by: str = "source") -> DataFrame:
    """Partitions each vertex would be copied to if edges were placed in ``n`` partitions.

    Edges go by their source id or by a mix of both ends.
    """
    if by == "source":
        place = F.pmod("src", F.lit(n))
    elif by == "edge":
        # reduced first, so that the product of large ids stays in range
        src, dst = (F.pmod(c, F.lit(MIX_MODULUS)) for c in ("src", "dst"))
        place = F.pmod(src * MIX_FACTOR + dst, F.lit(n))
    else:
        raise ValueError("by must be 'source' or 'edge'")
    placed = edges.select(F.explode(F.array("src", "dst")).alias("id"), place.cast("int").alias("pid"))
    return distinct_pairs(placed)


def vertex_replication(edges: DataFrame, n: int, by: str = "source") -> DataFrame:
    """Number of partitions each vertex would be copied to."""
    return vertex_partitions(edges, n, by).groupBy("id").agg(F.count("*").alias("copies"))


def replication_factor(edges: DataFrame, n: int, by: str = "source") -> DataFrame:
    """One row: mean number of copies per vertex."""
    return vertex_replication(edges, n, by).agg(F.avg("copies").alias("factor"))
