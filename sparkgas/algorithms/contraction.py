"""Component labels by star contraction: a number of rounds that grows with the logarithm of a component's size.

Edges are rewired, not labels passed on.  A large star hangs the larger
neighbours of every vertex on the smallest id around it, a small star does so
with the smaller ones and the vertex itself.  In turns they end in one star per
component, with its smallest id in the middle, and never add edges.

Near the end all edges of a giant component share one centre.  The smallest ids
are counted out with map-side combine; those of centres with more edges than a
piece, of which there are few, go to the edges where these lie, and all others are
joined.  A centre's edges never come together in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkgas.plans.cluster import Scratch, cut, drop
from sparkgas.plans.skew import piece_rows


def _ordered(a, b):
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def with_smallest(rows: DataFrame, key: str, value: str, total: int, rows_per_piece: int | None = None):
    """``rows`` with ``m``, the smallest ``value`` of their ``key``; the table ``(key, m)``; what was written for it.

    ``total`` bounds the rows of any key.  If it is above the size of a piece, the
    smallest values are written, and those of keys above that size, fewer than
    ``HOT_KEYS``, are sent to all tasks.
    """
    piece = piece_rows(total, rows_per_piece)
    smallest = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("_n"))
    if total <= piece:
        smallest = smallest.select(key, "m")
        return rows.join(smallest, key), smallest, None
    written = cut(smallest)
    hot, others = (written.where(F.col("_n") > piece), written.where(F.col("_n") <= piece).select(key, "m"))
    # a key above the size of a piece has more than 1 / HOT_KEYS of all rows: the list is bounded
    spread = rows.join(F.broadcast(hot.select(key, "m")), key)
    joined = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key)
    return spread.unionByName(joined), written.select(key, "m"), written


def _large_star(edges: DataFrame, n: int, rows_per_piece: int | None) -> tuple[DataFrame, DataFrame | None]:
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
    joined, _, written = with_smallest(both, "u", "v", n, rows_per_piece)
    return joined.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct(), written


def _small_star(edges: DataFrame, n: int, rows_per_piece: int | None) -> tuple[DataFrame, DataFrame | None]:
    joined, smallest, written = with_smallest(edges, "a", "b", n, rows_per_piece)
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), written


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, with their count and checksum: equal before and after a round only at the end."""
    seen = Observation()
    digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    written = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")))
    return written, (seen.get["n"], seen.get["digest"])


def star_labels(
    edges: DataFrame, src: str = "src", dst: str = "dst", rows_per_piece: int | None = None
) -> tuple[DataFrame, int]:
    """``(id, label)`` of every id that has an edge to another one, and the rounds it took.

    ``label`` is the smallest id of the component.  Loops, repeated edges and
    edges with a null end change nothing.  A vertex's neighbours are never
    brought together, in a row or in a task; smallest ids are combined before
    their exchange.
    """
    with Scratch() as scratch:
        now, rounds = _contracted(edges, src, dst, rows_per_piece)
        scratch.keep(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    ), rounds


def _contracted(edges: DataFrame, src: str, dst: str, rows_per_piece: int | None) -> tuple[DataFrame, int]:
    known = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now, state = _written(known.select(*_ordered(F.col(src), F.col(dst))).distinct())
    rounds = 0
    while state[0]:
        rows, least = _large_star(now, state[0], rows_per_piece)
        # a large star makes no more edges than it has
        large = cut(rows)
        rows, leasts = _small_star(large, state[0], rows_per_piece)
        small, after = _written(rows)
        for table in (now, large, least, leasts):
            drop(table)
        now, before, state, rounds = small, state, after, rounds + 1
        if state == before:
            break
    return now, rounds
