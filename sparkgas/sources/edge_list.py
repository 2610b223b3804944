"""Edge lists in tab-separated text, one edge per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgas.graph import PropertyGraph
from sparkgas.operators.derive import degrees, densify_vertices, vertices_from_edges
from sparkgas.plans.cluster import cut

MODES = ("failfast", "dropmalformed", "permissive")


def parse_edges(lines: DataFrame, mode: str = "failfast", max_columns: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(src, dst, payload)`` from text lines ``src <tab> dst [<tab> payload…]``.

    Ids are trimmed.  Further columns are joined by tab again; without any the
    payload is empty.  A line with fewer than two columns, more than
    ``max_columns``, or ids that are not whole numbers is malformed: an error
    ("failfast"), left out ("dropmalformed"), or kept with NULL ids
    ("permissive").
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    # empty columns at the end of a line do not count
    parts = F.split(F.regexp_replace("value", r"\t+$", ""), "\t")
    rows = lines.select("value", *keep, parts.alias("p"), F.size(parts).alias("n"))
    src = F.trim(F.get("p", F.lit(0))).try_cast("bigint")
    dst = F.trim(F.get("p", F.lit(1))).try_cast("bigint")
    ok = src.isNotNull() & dst.isNotNull()
    if max_columns is not None:
        ok = ok & (F.col("n") <= max_columns)
    payload = F.array_join(F.slice("p", 3, F.greatest(F.col("n") - 2, F.lit(0))), "\t")
    if mode == "dropmalformed":
        rows = rows.where(ok)
        return rows.select(src.alias("src"), dst.alias("dst"), payload.alias("payload"), *keep)
    if mode == "failfast":
        # a filter, as no choice of columns can leave that out
        wrong = F.raise_error(F.concat(F.lit("malformed input: "), F.col("value"))).cast("boolean")
        rows = rows.where(F.when(ok, True).otherwise(wrong))
        return rows.select(src.alias("src"), dst.alias("dst"), payload.alias("payload"), *keep)
    return rows.select(
        F.when(ok, src).alias("src"),
        F.when(ok, dst).alias("dst"),
        F.when(ok, payload).otherwise(F.col("value")).alias("payload"),
        *keep,
    )


def read_edge_list(
    spark: SparkSession, path: str, parser: dict[str, Column] | None = None, mode: str = "failfast"
) -> PropertyGraph:
    """A graph from an edge list; vertices are the ids seen, with total degree.

    ``parser`` maps data column names to expressions over ``payload``; without
    it the payload text itself is the edge data.
    """
    edges = _typed(parse_edges(spark.read.text(path), mode), parser)
    return PropertyGraph(vertices_from_edges(edges), edges)


def read_edge_list_strict(
    spark: SparkSession,
    path: str,
    parser: dict[str, Column] | None = None,
    init: dict[str, Column] | None = None,
) -> PropertyGraph:
    """A graph from lines of exactly two or three columns.

    Edges get ``eid``, their line number from 0; vertices are all ids from 0 to
    the largest, with degrees and the ``init`` data (expressions over ``id``).
    The text is read once, while the graph is built; its rows are then kept with
    their split and place, and the numbers of lines before a split are joined to them.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    edges = parse_edges(lines, "failfast", max_columns=3, keep=("_file", "_start", "_at"))
    # the only pass over the text; a malformed line is an error, so every line has its row
    edges = cut(edges.withColumn("payload", F.trim("payload")))
    # one row per input split: its first line and how many lines came before it
    sizes = edges.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        sizes.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    )
    numbered = edges.join(offsets, ["_file", "_start"]).select(
        "src", "dst", "payload", (F.col("_at") + F.col("_offset")).alias("eid")
    )
    numbered = _typed(numbered, parser)
    graph = PropertyGraph(densify_vertices(numbered), numbered, complete=True)
    vertices = degrees(graph)
    return graph.with_vertices(vertices.withColumns(init) if init else vertices)


def _typed(edges: DataFrame, parser: dict[str, Column] | None) -> DataFrame:
    if parser is None:
        return edges
    rest = [c for c in edges.columns if c != "payload"]
    return edges.select(*rest, *[c.alias(n) for n, c in parser.items()])


def from_edges_only(
    edges: DataFrame, value: Column | None = None, fraction: float = 1.0, seed: int = 1
) -> PropertyGraph:
    """A graph from bare ``(src, dst)`` rows, all vertices with the same start value.

    ``fraction`` below 1 keeps a random sample of the rows.
    """
    rows = edges.select("src", "dst")
    if fraction < 1.0:
        rows = rows.sample(False, fraction, seed)
    value = F.lit(1.0) if value is None else value
    return PropertyGraph(vertices_from_edges(rows).select("id", value.alias("value")), rows)


def write_edge_list(edges: DataFrame, path: str, payload: Column | None = None, order_by: str | None = None) -> None:
    """Write edges as tab-separated lines, in order if ``order_by`` is given."""
    parts = [F.col("src").cast("string"), F.col("dst").cast("string")]
    if payload is not None:
        parts.append(payload.cast("string"))
    rows = edges.orderBy(order_by) if order_by else edges
    rows.select(F.concat_ws("\t", *parts).alias("value")).write.text(path)
