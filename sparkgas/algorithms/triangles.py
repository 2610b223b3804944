"""Triangles and shared neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkgas.functions.columns import half
from sparkgas.graph import PropertyGraph
from sparkgas.operators.messages import aggregate_messages
from sparkgas.plans.cluster import cut
from sparkgas.plans.skew import ROWS_PER_PIECE, HotKeys, piece_rows, spread_join


def canonical_pairs(edges: DataFrame) -> DataFrame:
    """Each pair of distinct neighbours once, as ``lo < hi``."""
    return (
        edges.where("src <> dst")
        .select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
        .distinct()
    )


def triangles(graph: PropertyGraph, pairs: DataFrame | None = None) -> DataFrame:
    """Every triangle once, as ``(a, b, c)``.

    Pairs point from the end with fewer neighbours to the one with more, so no
    vertex has more than about sqrt(2 * pairs) outgoing ones.  Two-step paths
    a -> b -> c are then closed by a -> c.  A middle vertex is cut into pieces by
    the number of paths through it, its incoming times its outgoing pairs.
    ``pairs`` are the :func:`canonical_pairs` of the graph, if they are at hand.
    """
    pairs = cut(canonical_pairs(graph.inner_edges())) if pairs is None else pairs
    counted = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    sizes, (rows, most) = _observed(counted, F.sum("n"), F.max("n"))
    hot = _heavy(sizes, "n", rows, most, graph.rows_per_piece)
    sized = pairs
    for end in ("lo", "hi"):
        sized = spread_join(sized, sizes.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n")), [end], hot=hot)
    lo_first = (F.col("lo_n") < F.col("hi_n")) | ((F.col("lo_n") == F.col("hi_n")) & (F.col("lo") < F.col("hi")))
    oriented = cut(
        sized.select(
            F.when(lo_first, F.col("lo")).otherwise(F.col("hi")).alias("a"),
            F.when(lo_first, F.col("hi")).otherwise(F.col("lo")).alias("b"),
        )
    )
    onward = oriented.select(F.col("a").alias("b"), F.col("b").alias("c"))
    closing = oriented.select("a", F.col("b").alias("c"))
    return _paths(oriented, onward, graph.rows_per_piece).join(closing, ["a", "c"]).select("a", "b", "c")


def _observed(df: DataFrame, *values) -> tuple[DataFrame, list[int]]:
    """``df`` written, and some aggregates of it (0 for none) seen while it is."""
    seen = Observation()
    written = cut(df.observe(seen, *(v.alias(f"v{i}") for i, v in enumerate(values))))
    return written, [seen.get[f"v{i}"] or 0 for i in range(len(values))]


def _heavy(sizes: DataFrame, column: str, rows: int, most: int, rows_per_piece: int | None) -> HotKeys:
    """The ids of a written table whose size is above that of a piece: a bounded list, fetched only if there are any."""
    piece = piece_rows(rows, rows_per_piece)
    if most <= piece:
        return HotKeys(["_k0"], None)
    top = sizes.where(F.col(column) > piece).select(F.col("id").alias("_k0"), F.ceil(F.col(column) / piece).cast("int").alias("_pieces"))
    return HotKeys(["_k0"], sizes.sparkSession.createDataFrame(top.collect(), top.schema))


def _paths(into: DataFrame, out: DataFrame, rows_per_piece: int | None) -> DataFrame:
    """``(a, b, c)`` of all two-step paths.

    Where a middle vertex has many of them, its incoming pairs are dealt over
    pieces, and its outgoing ones copied to each, so that a piece makes about
    ``rows_per_piece`` paths, or those of one incoming pair if that has more.  The
    piece numbers reach the rows of vertices with very many pairs by broadcast.
    """
    ends = into.select(F.col("b").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        out.select(F.col("b").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    counted = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i > 0 and o > 0")
    made = F.col("i") * F.col("o").cast("double")
    degrees, (rows, most, paths) = _observed(counted, F.sum("i"), F.max("i"), F.max(made))
    piece = rows_per_piece or ROWS_PER_PIECE
    if paths <= piece:
        return into.join(out, "b").select("a", "b", "c")
    pieces = F.least(F.ceil(made / piece), F.col("i")).cast("bigint")
    middle = degrees.select(F.col("id").alias("b"), pieces.alias("pieces"))
    hot = _heavy(degrees, "i", rows, most, rows_per_piece)
    dealt = spread_join(into, middle, ["b"], hot=hot).withColumn("piece", F.pmod(F.xxhash64("a"), F.col("pieces")))
    copied = out.join(middle, "b").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    return dealt.select("a", "b", "piece").join(copied.select("b", "c", "piece"), ["b", "piece"]).select("a", "b", "c")


def triangle_count(graph: PropertyGraph) -> DataFrame:
    """``(id, triangles)`` for every vertex."""
    corners = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id"))
    counts = corners.groupBy("id").agg(F.count("*").alias("triangles"))
    return graph.vertices.select("id").join(counts, "id", "left").fillna(0, ["triangles"])


def edge_common_neighbors(graph: PropertyGraph) -> DataFrame:
    """Every edge between vertices with ``common``, the number of neighbours its two ends share.

    A self-loop makes a vertex its own neighbour.
    """
    edges = graph.inner_edges()
    canonical = cut(canonical_pairs(edges))
    sides = F.array(*[
        F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
        for x, y in (("a", "b"), ("a", "c"), ("b", "c"))
    ])
    shared = (
        triangles(graph, canonical)
        .select(F.explode(sides).alias("p"))
        .groupBy("p.lo", "p.hi")
        .agg(F.count("*").alias("n"))
    )
    loops = cut(edges.where("src = dst").select(F.col("src").alias("id")).distinct())
    # a looped end is itself shared by both ends of every edge it has
    pairs = canonical.join(shared, ["lo", "hi"], "left")
    for end in ("lo", "hi"):
        pairs = pairs.join(loops.select(F.col("id").alias(end), F.lit(1).alias(f"{end}_loop")), end, "left")
    zero = F.lit(0).cast("bigint")
    common = F.coalesce("n", zero) + F.coalesce("lo_loop", zero) + F.coalesce("hi_loop", zero)
    # the neighbours of the few vertices with a loop: themselves, and the other end of each of their pairs
    ends = F.explode(F.array("lo", "hi")).alias("id")
    own = canonical.select(ends).join(loops, "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    looped = loops.join(own, "id", "left").select(
        F.col("id").alias("lo"), F.col("id").alias("hi"), (F.coalesce("n", zero) + 1).alias("common")
    )
    table = pairs.select("lo", "hi", common.alias("common")).unionByName(looped)
    rows = edges.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
    return rows.join(table, ["lo", "hi"]).drop("lo", "hi")


def edge_sum_to_vertices(graph: PropertyGraph, column: str) -> DataFrame:
    """``(id, total)``: half the sum of ``column`` over the edges of each vertex."""
    sums = aggregate_messages(graph, lambda t: t.edge[column], F.sum, "both")
    return graph.vertices.select("id").join(sums, "id", "left").select(
        "id", half(F.coalesce("acc", F.lit(0))).alias("total")
    )
