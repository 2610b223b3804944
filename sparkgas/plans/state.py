"""Vertex or edge data of a loop, as one written table and the rows that changed since.

Where only a few vertices change in a round, only these are written, as a layer
above the table.  A vertex has the data of the newest layer that holds it.  Edges that
carry data go by their number, and are found from their active ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgas.plans.cluster import cut, drop
from sparkgas.plans.skew import HotKeys

# A round whose senders are at most this share of the vertices writes a layer.
FEW = 0.25
# Layers that a look-up joins; beyond it the newest ones become one.
LAYERS = 4


class VertexState:
    """``base`` has a row for every vertex; ``layers`` are ``(rows, number of rows)``, the oldest first.

    All of them rest by ``id`` in the partitions of the loop, so that neither a
    look-up nor a new layer exchanges any of them.
    """

    def __init__(self, base: DataFrame, partitions: int):
        self.base = base
        self.partitions = partitions
        self.columns = base.columns
        self.layers: list[tuple[DataFrame, int]] = []

    def latest(self) -> DataFrame:
        """The rows written in the round before; among them are all active vertices."""
        return self.layers[-1][0] if self.layers else self.base

    def rows(self) -> DataFrame:
        """All vertices with their newest data."""
        return self._newest(self.base)

    def look_up(self, keyed: DataFrame) -> DataFrame:
        """Rows of ``keyed`` (with ``id``) joined with the newest data of their vertices."""
        return self._newest(keyed.join(self.base, "id"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        if not self.layers:
            return rows
        data = [c for c in self.columns if c != "id"]
        for i, (layer, _) in enumerate(self.layers):
            changed = layer.select("id", F.struct(*[F.col(f"`{c}`") for c in data]).alias(f"_layer{i}"))
            rows = rows.join(changed, "id", "left")
        names = [f"_layer{i}" for i in reversed(range(len(self.layers)))]

        def newest(c):
            value = F.when(F.col(names[0]).isNotNull(), F.col(f"{names[0]}.`{c}`"))
            for name in names[1:]:
                value = value.when(F.col(name).isNotNull(), F.col(f"{name}.`{c}`"))
            return value.otherwise(F.col(f"`{c}`"))

        kept = [f"`{c}`" for c in rows.columns if c not in data and c not in names]
        return rows.select(*kept, *[newest(c).alias(c) for c in data])

    def add(self, layer: DataFrame, n: int) -> None:
        """Put the rows of a round on top.  Layers below that are too many are merged first.

        The newest ones are merged, with every older one that is at most twice as
        large as these together, so a row is written again a logarithmic number of times.
        """
        if len(self.layers) >= LAYERS:
            first = len(self.layers) - 2
            size = sum(n for _, n in self.layers[first:])
            while first > 0 and self.layers[first - 1][1] <= 2 * size:
                first -= 1
                size += self.layers[first][1]
            merged = self.layers[first][0]
            for newer, _ in self.layers[first + 1 :]:
                merged = merged.join(newer.select("id"), "id", "left_anti").unionByName(newer)
            merged = cut(merged.repartition(self.partitions, "id").sortWithinPartitions("id"))
            for spent, _ in self.layers[first:]:
                drop(spent)
            self.layers[first:] = [(merged, size)]
        self.layers.append((layer, n))

    def replace(self, base: DataFrame) -> None:
        """Go on from a new table of all vertices."""
        for spent in (self.base, *[layer for layer, _ in self.layers]):
            drop(spent)
        self.base, self.layers = base, []

    def settle(self) -> DataFrame:
        """All vertices as one written table."""
        if self.layers:
            self.replace(cut(self.rows()))
        return self.base


class EdgePlaces:
    """Numbers of edges, resting by the ends they are visited from; edges keep their ends, so this is written once.

    Edges of hot ends rest anywhere: the bounded list of hot ids that are active goes to them.
    """

    def __init__(self, rows: DataFrame, ends: tuple[str, ...], hot: dict[str, HotKeys], partitions: int):
        self.partitions = partitions
        self.places: list[tuple[str, DataFrame, DataFrame | None, DataFrame | None]] = []
        for end in ends:
            key = f"{end[0]}_id"
            pairs = rows.select(key, F.col("_eno").alias("id"))
            hub_ids = hub_pairs = None
            if hot[end]:
                hub_ids = hot[end].table.select(F.col("_k0").alias(key))
                hub_pairs = cut(pairs.join(F.broadcast(hub_ids), key, "left_semi"))
                pairs = pairs.join(F.broadcast(hub_ids), key, "left_anti")
            pairs = cut(pairs.repartition(partitions, key).sortWithinPartitions(key))
            self.places.append((key, pairs, hub_ids, hub_pairs))

    def touching(self, active: DataFrame) -> DataFrame:
        """``(id)``: the number of each edge that has an end in ``active``, once."""
        found = []
        for key, pairs, hub_ids, hub_pairs in self.places:
            ends = active.select(F.col("id").alias(key))
            found.append(pairs.join(ends, key, "left_semi").select("id"))
            if hub_ids is not None:
                hubs = ends.join(F.broadcast(hub_ids), key, "left_semi")
                found.append(hub_pairs.join(F.broadcast(hubs), key, "left_semi").select("id"))
        return reduce(DataFrame.unionByName, found).distinct()
