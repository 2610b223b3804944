"""Joins that stay balanced when a few keys hold most of the rows.

A key with more than ``rows_per_piece`` rows on the many-rows side is cut into
pieces.  Its rows are spread over the pieces and the single row on the other
side is copied once per piece, so no task sees more than about one piece of a
hot key.  Results do not depend on the cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_PIECE = 1_000_000
# A piece is never smaller than this share of all rows, so no more than so many keys
# can hold more than a piece: the list of hot keys is complete, and small enough to broadcast.
HOT_KEYS = 50_000


@dataclass
class HotKeys:
    """Hot values of one key (one or more columns), with their piece counts."""

    cols: list[str]
    table: DataFrame | None

    def __bool__(self) -> bool:
        return self.table is not None

    def _on(self, df: DataFrame, names: list[str]) -> DataFrame:
        hot = self.table.select(
            *[F.col(c).alias(f"_hot{i}") for i, c in enumerate(self.cols)], "_pieces"
        )
        cond = None
        for i, name in enumerate(names):
            eq = F.col(name) == F.col(f"_hot{i}")
            cond = eq if cond is None else cond & eq
        # bounded: at most HOT_KEYS rows, see above
        return df.join(F.broadcast(hot), cond, "left").drop(*[f"_hot{i}" for i in range(len(names))])

    def spread(self, df: DataFrame, names: list[str], piece: str) -> DataFrame:
        """Number the piece of every row of the many-rows side."""
        if not self:
            return df
        salt = F.xxhash64(*df.columns, F.spark_partition_id())
        return self._on(df, names).withColumn(
            piece,
            F.when(F.col("_pieces").isNull(), F.lit(0))
            .otherwise(F.pmod(salt, F.col("_pieces")))
            .cast("int"),
        ).drop("_pieces")

    def copies(self, df: DataFrame, names: list[str], piece: str) -> DataFrame:
        """Copy every row of the one-row-per-key side to all pieces of its key."""
        if not self:
            return df
        last = F.coalesce(F.col("_pieces"), F.lit(1)) - 1
        return self._on(df, names).withColumn(
            piece, F.explode(F.sequence(F.lit(0), last.cast("int")))
        ).drop("_pieces")


def piece_rows(rows: int, asked: int | None = None) -> int:
    """Rows per piece: as asked for, or so many more that few keys can exceed it."""
    return max(asked or ROWS_PER_PIECE, -(-rows // HOT_KEYS))


def hot_keys(df: DataFrame, *keys: str | Column, rows_per_piece: int | None = None) -> HotKeys:
    """Find the hot values of ``keys``: counted with map-side combine.

    Only those above the size of a piece reach the driver.
    """
    spark = df.sparkSession
    rows_per_piece = piece_rows(df.count(), rows_per_piece)
    cols = [f"_k{i}" for i in range(len(keys))]
    named = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(c) for k, c in zip(keys, cols)])
    top = (
        named.groupBy(*cols)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > rows_per_piece)
        .select(*cols, F.ceil(F.col("_n") / rows_per_piece).cast("int").alias("_pieces"))
    )
    rows = top.collect()
    return HotKeys(cols, spark.createDataFrame(rows, top.schema) if rows else None)


class EdgeStats:
    """Size of an edge table and the ids that hold very many of its rows.

    One counting pass with map-side combine; the bounded list of hot ids is
    fetched only if there are any.
    """

    def __init__(self, edges: DataFrame, rows_per_piece: int | None = None):
        ends = F.array(
            F.struct(F.col("src").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("d")),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("s"), F.lit(1).alias("d")),
        )
        per_id = (
            edges.select(F.explode(ends).alias("e"))
            .groupBy(F.col("e.id").alias("_k0"))
            .agg(F.sum("e.s").alias("src"), F.sum("e.d").alias("dst"), F.count("*").alias("both"))
        )
        row = per_id.agg(
            F.sum("src").alias("n"), *[F.max(c).alias(f"most_{c}") for c in ("src", "dst", "both")]
        ).first()
        self.n_edges: int = row["n"] or 0
        self.most: dict[str, int] = {c: row[f"most_{c}"] or 0 for c in ("src", "dst", "both")}
        self.rows_per_piece = piece_rows(2 * self.n_edges, rows_per_piece)
        self._hot: DataFrame | None = None
        if self.most["both"] > self.rows_per_piece:
            top = per_id.where(F.col("both") > self.rows_per_piece)
            self._hot = edges.sparkSession.createDataFrame(top.collect(), top.schema)

    def hot(self, end: str) -> HotKeys:
        """Hot ids among the sources ("src"), the targets ("dst") or both ends together."""
        if self.most[end] <= self.rows_per_piece:
            return HotKeys(["_k0"], None)
        pieces = F.ceil(F.col(end) / self.rows_per_piece).cast("int").alias("_pieces")
        return HotKeys(["_k0"], self._hot.where(F.col(end) > self.rows_per_piece).select("_k0", pieces))


def spread_join(
    many: DataFrame,
    one: DataFrame,
    names: list[str],
    how: str = "inner",
    hot: HotKeys | None = None,
    rows_per_piece: int | None = None,
) -> DataFrame:
    """Join ``many`` to ``one``, cutting hot keys of ``many`` (counted if not given)."""
    if hot is None:
        hot = hot_keys(many, *names, rows_per_piece=rows_per_piece)
    if not hot:
        return many.join(one, names, how)
    return (
        hot.spread(many, names, "_piece")
        .join(hot.copies(one, names, "_piece"), [*names, "_piece"], how)
        .drop("_piece")
    )
