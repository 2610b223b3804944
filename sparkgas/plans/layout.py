"""How edges are laid out for a loop.

Edges are read once as arcs from a sender to a receiver (both ways for
direction "both"), exchanged once by sender, sorted and kept.  In every round
only vertex rows move: sender rows to their arcs, and partly reduced messages
to the receivers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from sparkgas.graph import PropertyGraph
from sparkgas.plans.cluster import partitions_for
from sparkgas.plans.skew import EdgeStats


def arcs_of(edges: DataFrame, direction: str, columns: list[str]) -> DataFrame:
    """Arcs ``(snd_id, rcv_id, _fwd, e_<column>…)`` along which a gather reads.

    ``in``: the target gathers, so the source sends; ``out``: the other way.
    ``_fwd`` is true where the sender is the source of the edge.
    """
    data = [F.col(c).alias(f"e_{c}") for c in columns]
    if direction == "in":
        return edges.select(F.col("src").alias("snd_id"), F.col("dst").alias("rcv_id"), F.lit(True).alias("_fwd"), *data)
    if direction == "out":
        return edges.select(F.col("dst").alias("snd_id"), F.col("src").alias("rcv_id"), F.lit(False).alias("_fwd"), *data)
    if direction == "both":
        ways = F.array(
            F.struct(F.col("src").alias("s"), F.col("dst").alias("r"), F.lit(True).alias("f")),
            F.struct(F.col("dst").alias("s"), F.col("src").alias("r"), F.lit(False).alias("f")),
        )
        return edges.select(F.explode(ways).alias("_w"), *data).select(
            F.col("_w.s").alias("snd_id"),
            F.col("_w.r").alias("rcv_id"),
            F.col("_w.f").alias("_fwd"),
            *[f"e_{c}" for c in columns],
        )
    raise ValueError(f"no arcs for direction {direction!r}")


class ArcLayout:
    """Arcs kept by sender; the arcs of hot senders are kept apart, as they come.

    There is a bounded number of hot senders, so their rows go to every task
    and their arcs can rest anywhere.  The arcs of all other senders rest where
    the sender's own row does.
    """

    def __init__(self, graph: PropertyGraph, direction: str, columns: list[str] | None = None):
        names = graph.edge_columns if columns is None else columns
        kept = graph.inner_edges().select("src", "dst", *[f"`{c}`" for c in names]).persist(StorageLevel.MEMORY_AND_DISK)
        stats = EdgeStats(kept, graph.rows_per_piece)
        sends, receives = {"in": ("src", "dst"), "out": ("dst", "src"), "both": ("both", "both")}[direction]
        self.direction = direction
        self.n_arcs = stats.n_edges * (2 if direction == "both" else 1)
        self.most_received = stats.most[receives]
        self.partitions = partitions_for(graph.spark, max(self.n_arcs, graph.n_vertices()))
        self.hot_receivers = stats.hot(receives)
        hot = stats.hot(sends)
        self.hub_ids = hot.table.select(F.col("_k0").alias("snd_id")) if hot else None
        raw = arcs_of(kept, direction, names)
        self.hub_arcs = None
        if self.hub_ids is not None:
            # bounded list of ids, see HOT_KEYS
            hubs = F.broadcast(self.hub_ids)
            self.hub_arcs = raw.join(hubs, "snd_id", "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
            raw = raw.join(hubs, "snd_id", "left_anti")
        self.arcs = (
            raw.repartition(self.partitions, "snd_id")
            .sortWithinPartitions("snd_id")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        self.all_arcs().count()
        kept.unpersist()

    def all_arcs(self) -> DataFrame:
        return self.arcs if self.hub_arcs is None else self.arcs.unionByName(self.hub_arcs)

    def sent(self) -> DataFrame:
        """``(id, n)``: number of arcs leaving each sender."""
        return self.all_arcs().groupBy(F.col("snd_id").alias("id")).agg(F.count("*").alias("n"))

    def from_senders(self, senders: DataFrame) -> DataFrame:
        """Arcs joined with ``senders`` (keyed by ``snd_id``); arcs stay where they are."""
        joined = self.arcs.join(senders, "snd_id")
        if self.hub_arcs is None:
            return joined
        hub_rows = senders.join(F.broadcast(self.hub_ids), "snd_id", "left_semi")
        return joined.unionByName(self.hub_arcs.join(F.broadcast(hub_rows), "snd_id"))

    def release(self) -> None:
        self.arcs.unpersist()
        if self.hub_arcs is not None:
            self.hub_arcs.unpersist()
