"""A graph as readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgas.graph import PropertyGraph


def _text(columns: list[str], show: Column | None) -> Column:
    if show is not None:
        return F.coalesce(show.cast("string"), F.lit("null"))
    return F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns])


def graph_lines(
    graph: PropertyGraph, vertex_text: Column | None = None, edge_text: Column | None = None
) -> DataFrame:
    """``(section, first, second, line)``: header, vertices, blank, header, edges.

    Sorting by the first three columns gives the order of the text; edges go by
    ``eid`` where they have one, else by their ends.
    """
    spark = graph.spark
    heads = spark.createDataFrame(
        [(0, 0, 0, "Vertices"), (2, 0, 0, ""), (3, 0, 0, "Edges")],
        "section int, first bigint, second bigint, line string",
    )
    vertices = graph.vertices.select(
        F.lit(1).alias("section"),
        F.col("id").alias("first"),
        F.lit(0).cast("bigint").alias("second"),
        F.concat(F.col("id").cast("string"), F.lit(" : "), _text(graph.vertex_columns, vertex_text)).alias("line"),
    )
    order = ("eid", F.lit(0).cast("bigint")) if "eid" in graph.edge_columns else ("src", F.col("dst"))
    edges = graph.edges.select(
        F.lit(4).alias("section"),
        F.col(order[0]).alias("first"),
        order[1].alias("second"),
        F.concat(
            F.col("src").cast("string"),
            F.lit("->"),
            F.col("dst").cast("string"),
            F.lit(" : "),
            _text([c for c in graph.edge_columns if c != "eid"], edge_text),
        ).alias("line"),
    )
    return heads.unionByName(vertices).unionByName(edges)


def write_graph_lines(graph: PropertyGraph, path: str, **texts: Column) -> None:
    """Write the lines in order; part files in name order give the whole text."""
    lines = graph_lines(graph, **texts)
    lines.orderBy("section", "first", "second", "line").select(F.col("line").alias("value")).write.text(path)
