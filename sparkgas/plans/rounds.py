"""Iteration without an active set: a fixed number of rounds over all vertices."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkgas.graph import PropertyGraph
from sparkgas.operators.derive import number_edges
from sparkgas.plans.cluster import Scratch, cut, delete_path, drop, fixed_layout, scratch_path
from sparkgas.plans.gas import ACTIVE, ArcPlan, Program, edge_columns_used, merge_accumulators, vertex_view
from sparkgas.plans.layout import ArcLayout, arcs_of
from sparkgas.plans.skew import HotKeys


def iterate_fixed(
    graph: PropertyGraph,
    program: Program,
    rounds: int,
    drop_unreached: bool = False,
    layout: ArcLayout | None = None,
) -> PropertyGraph:
    """Gather and apply on every vertex, ``rounds`` times.

    With ``drop_unreached`` a vertex that gathers nothing in a round leaves the
    graph, and with it all its edges.
    """
    if layout is None:
        layout = ArcLayout(graph, program.gather_dir, edge_columns_used(program))
        try:
            return iterate_fixed(graph, program, rounds, drop_unreached, layout)
        finally:
            layout.release()
    plan = ArcPlan(program, layout)
    with Scratch() as scratch, fixed_layout(graph.spark, layout.partitions):
        state = cut(graph.vertices.withColumn(ACTIVE, F.lit(True)))
        for _ in range(rounds):
            before = state
            if drop_unreached:
                acc = plan.reduce(plan.messages(state, True), True).where("acc is not null")
                state = cut(sync_values(state, acc, program))
            else:
                state = cut(plan.round(state, first=True))
            drop(before)
        scratch.keep(state)
    vertices = state.drop(ACTIVE)
    if drop_unreached:
        return PropertyGraph(vertices, graph.edges, rows_per_piece=graph.rows_per_piece)
    return graph.with_vertices(vertices)


def sync_values(state: DataFrame, acc: DataFrame, program: Program) -> DataFrame:
    """New values of the vertices that have an accumulator; the others disappear."""
    news = program.apply(vertex_view(), F.col("acc"))
    return state.join(acc, "id").select(
        *[
            news[c].cast(state.schema[c].dataType).alias(c) if c in news else F.col(f"`{c}`")
            for c in state.columns
        ]
    )


class _Blocks:
    """Arcs and sender values in files by block, so that a step reads what its own block needs.

    Arcs lie by the block of their receiver, in the order of their senders.  What a
    sender passes on lies by its own block and, once each, by every block it has
    arcs into; it is rewritten when its block has changed.
    """

    def __init__(self, plan: ArcPlan, edges: DataFrame, blocks: DataFrame, n_blocks: int, columns: list[str]):
        self.spark, self.plan = edges.sparkSession, plan
        self.path = scratch_path(self.spark, "blocks")
        places = lambda end, name: blocks.select(F.col("id").alias(end), F.col("_block").alias(name))
        arcs = arcs_of(edges, plan.program.gather_dir, columns)
        arcs = arcs.join(places("rcv_id", "_to"), "rcv_id").join(places("snd_id", "_from"), "snd_id")
        # about as many files as partitions, or one for each block if there are more blocks
        pieces = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // n_blocks)
        piece = lambda c: F.pmod(F.xxhash64(c), F.lit(pieces))
        arcs = arcs.repartition("_to", piece("snd_id")).sortWithinPartitions("_to", "snd_id")
        arcs.write.partitionBy("_to").parquet(f"{self.path}/arcs")
        self.kept = self.spark.read.parquet(f"{self.path}/arcs")
        targets = self.kept.select("_from", "_to", F.col("snd_id").alias("id")).distinct()
        targets.repartition("_from", piece("id")).write.partitionBy("_from").parquet(f"{self.path}/targets")
        self.targets = self.spark.read.parquet(f"{self.path}/targets")
        self.reached = {r[0] for r in self.kept.select("_to").distinct().collect()}  # one row per block
        self.sent = sorted({"id", ACTIVE, *plan.t.vertex_columns("snd_")})

    def arcs(self, block: int) -> DataFrame:
        return self.kept.where(F.col("_to") == block).drop("_to", "_from")

    def send(self, states: list[DataFrame], block: int | None = None) -> None:
        """Write what the senders of one block, or of all, pass on to each block they reach."""
        columns = [F.col(f"`{c}`") for c in self.sent]
        if block is None:
            rows = reduce(DataFrame.unionByName, states).select(*columns).join(self.targets, "id")
            rows.write.partitionBy("_from", "_to").parquet(f"{self.path}/sent")
        else:
            own = self.targets.where(F.col("_from") == block).drop("_from")
            rows = states[block].select(*columns).join(own, "id")
            rows.write.mode("overwrite").partitionBy("_to").parquet(f"{self.path}/sent/_from={block}")

    def senders(self, block: int, schema: StructType) -> DataFrame:
        kept = StructType([f for f in schema.fields if f.name in self.sent])
        return self.spark.read.schema(kept).parquet(f"{self.path}/sent/*/_to={block}")

    def gathered(self, block: int, state: DataFrame) -> DataFrame:
        """One accumulator row for every vertex of a block that any sender reaches."""
        plan = self.plan
        if block not in self.reached:
            return state.select("id", F.lit(None).alias("acc")).where(F.lit(False))
        senders = plan._senders(self.senders(block, state.schema), True)
        arcs = plan._with_receivers(self.arcs(block).join(senders, "snd_id"), state)
        return plan.reduce(arcs.select(*plan._message_columns(True)), True)

    def release(self) -> None:
        delete_path(self.spark, self.path)


def iterate_blocked(
    graph: PropertyGraph,
    program: Program,
    rounds: int,
    block_size: int = 50_000,
) -> PropertyGraph:
    """Rounds in which blocks of vertices are updated one after another.

    A block holds ``block_size`` vertices in the order of their ids, and reads
    the values that earlier blocks of the same round have already written.  One
    block is the synchronous case.

    A step reads the arcs into its block and the newest values of just the senders
    on them, and writes its own vertices and what these pass on: the work of a
    round is that of one pass over the arcs, whatever the number of blocks.  Files
    lie in the checkpoint folder and are deleted in the end.  Adaptive planning
    stays on and splits the arcs of hot senders.
    """
    if program.gather_dir not in ("in", "out"):
        raise ValueError("blocks need gather direction 'in' or 'out'")
    with Scratch() as scratch:
        ranked = number_edges(graph.vertices.select("id"), ["id"], "_rank")
        blocks = cut(ranked.select("id", F.expr(f"_rank div {int(block_size)}").alias("_block")))
        n_blocks = (blocks.agg(F.max("_block")).first()[0] or 0) + 1
        if rounds == 0 or blocks.isEmpty():
            return graph
        plan = ArcPlan(program, SimpleNamespace(hot_receivers=HotKeys(["_k0"], None)))
        kept = _Blocks(plan, graph.inner_edges(), blocks, n_blocks, edge_columns_used(program))
        try:
            own = cut(graph.vertices.withColumn(ACTIVE, F.lit(True)).join(blocks, "id"))
            states = [cut(own.where(F.col("_block") == b).drop("_block")) for b in range(n_blocks)]
            kept.send(states)
            for step in range(rounds * n_blocks):
                b = step % n_blocks
                before, acc = states[b], kept.gathered(b, states[b])
                states[b] = cut(merge_accumulators(before, acc, program.apply, F.lit(True), program.default))
                drop(before)
                if step + 1 < rounds * n_blocks:
                    kept.send(states, b)
        finally:
            kept.release()
        scratch.keep(*states)
    return graph.with_vertices(reduce(DataFrame.unionByName, states).drop(ACTIVE))
