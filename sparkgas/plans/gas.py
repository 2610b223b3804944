"""Gather-apply-scatter programs as rounds of joins and aggregations.

A program is a set of functions that return Columns.  Two plans run it:

* the *arc plan*, when the program leaves edge data alone and signals travel
  along the edges that messages use.  Signals of one round are evaluated
  together with the messages of the next, so a round is one join of vertex
  rows to resting arcs, one reduction and one join back;
* the *triplet plan* for everything else, with separate gather and scatter
  passes and edge data carried along as state.

Both write the new vertex state once per round, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from sparkgas.functions.reducers import Reducer, as_reducer
from sparkgas.functions.triplet import End, Triplet
from sparkgas.graph import DIRECTIONS, PropertyGraph
from sparkgas.plans.cluster import Scratch, cut, cut_counting, drop, fixed_layout, partitions_for
from sparkgas.plans.layout import ArcLayout
from sparkgas.plans.state import FEW, EdgePlaces, VertexState

ACTIVE = "_active"
NUMBER = "_eno"
ONE = "_one"


class NotConverged(RuntimeError):
    """The program was still active after the allowed number of rounds."""


@dataclass
class Program:
    """What a vertex program computes.

    gather(t)            message for ``t.center`` from one edge; NULL sends nothing.
                         Also evaluated for vertices without edges, where it must not fail
    reducer              Spark aggregate, or a :class:`Reducer`
    default              used in place of the sum where nothing was gathered
    apply(v, acc)        new vertex data, as a dict of Columns
    signal(t)            whether ``t.center`` activates ``t.other``; None: never
    *_edge_update(t)     new edge data, as a dict of Columns
    edge_mode            both ends of an edge may update it in one pass:
                         "chained": the source sees what the target wrote;
                         "independent": both see the old data, the target wins
    changes_only         promise that a neighbour which did not signal has nothing
                         new to say (min-like programs): only signalled edges carry
                         messages
    accept(v, acc)       with ``changes_only``: a further condition, on the
                         receiving vertex, to become active
    """

    gather: Callable[[Triplet], Column]
    reducer: Reducer | Callable[[Column], Column]
    apply: Callable[[End, Column], dict[str, Column]]
    default: object = None
    signal: Callable[[Triplet], Column] | None = None
    gather_dir: str = "in"
    scatter_dir: str = "out"
    gather_edge_update: Callable[[Triplet], dict[str, Column]] | None = None
    scatter_edge_update: Callable[[Triplet], dict[str, Column]] | None = None
    edge_mode: str = "chained"
    changes_only: bool = False
    accept: Callable[[End, Column], Column] | None = None

    def __post_init__(self):
        for d in (self.gather_dir, self.scatter_dir):
            if d not in DIRECTIONS:
                raise ValueError(f"direction must be one of {DIRECTIONS}, not {d!r}")
        if self.edge_mode not in ("chained", "independent"):
            raise ValueError("edge_mode must be 'chained' or 'independent'")
        if self.accept is not None and not self.changes_only:
            raise ValueError("accept needs changes_only=True")

    @property
    def updates_edges(self) -> bool:
        return self.gather_edge_update is not None or self.scatter_edge_update is not None

    @property
    def signals_follow_messages(self) -> bool:
        return self.signal is None or (self.gather_dir, self.scatter_dir) in (
            ("in", "out"),
            ("out", "in"),
            ("both", "both"),
        )

    @property
    def visited_ends(self) -> tuple[str, ...]:
        """The ends that edges are visited from, in a gather or a scatter."""
        visits = {self.gather_dir, self.scatter_dir}
        return tuple(end for end, way in (("src", "out"), ("dst", "in")) if visits & {way, "both"})

    def fits_arc_plan(self) -> bool:
        return not self.updates_edges and self.gather_dir != "none" and self.signals_follow_messages


@dataclass
class GasResult:
    """Outcome of a program; ``converged`` is None when the cap hid the answer."""

    graph: PropertyGraph
    iterations: int
    active_history: list[int] = field(default_factory=list)
    converged: bool | None = None


def vertex_view() -> End:
    return End(lambda name: F.col(f"`{name}`"))


def _default(acc: Column, default: object) -> Column:
    if default is None:
        return acc
    return F.coalesce(acc, default if isinstance(default, Column) else F.lit(default))


def merged_columns(
    state: DataFrame, apply: Callable[[End, Column], dict[str, Column]], active: Column, default: object = None
) -> list[Column]:
    """Vertex columns after an apply, over vertices joined with their accumulators."""
    active = F.coalesce(active, F.lit(False))
    news = apply(vertex_view(), _default(F.col("acc"), default))
    types = {f.name: f.dataType for f in state.schema.fields}
    columns = [
        F.when(active, news[c]).otherwise(F.col(f"`{c}`")).cast(types[c]).alias(c) if c in news else F.col(f"`{c}`")
        for c in types
        if c != ACTIVE
    ]
    return [*columns, active.alias(ACTIVE)]


def merge_accumulators(
    state: DataFrame,
    acc: DataFrame,
    apply: Callable[[End, Column], dict[str, Column]],
    active: Column,
    default: object = None,
) -> DataFrame:
    """Join vertices with their accumulators and apply where ``active``.

    Inactive vertices keep all their data; active ones without an accumulator
    get ``default``.
    """
    return state.join(acc, "id", "left").select(*merged_columns(state, apply, active, default))


def merge_signals(state: DataFrame, signalled: DataFrame) -> DataFrame:
    """Set the active flag of exactly the vertices in ``signalled``."""
    marks = signalled.select("id", F.lit(True).alias("_mark"))
    return state.drop(ACTIVE).join(marks, "id", "left").select(
        *[f"`{c}`" for c in state.columns if c != ACTIVE],
        F.coalesce("_mark", F.lit(False)).alias(ACTIVE),
    )


def active_count(state: DataFrame, flag: str = ACTIVE) -> DataFrame:
    return state.agg(F.count_if(F.col(flag)).alias("n_active"))


# --------------------------------------------------------------------------- arc plan


class ArcPlan:
    def __init__(self, program: Program, layout: ArcLayout):
        self.program = program
        self.layout = layout
        self._columns: dict = {}
        self.reducer = as_reducer(program.reducer)
        fwd = F.col("_fwd")
        center_is_src = {"in": False, "out": True, "both": ~fwd}[program.gather_dir]
        self.t = Triplet("rcv_", "snd_", center_is_src)
        self.msg = program.gather(self.t)
        # a scatter looks from the sender: the same arc, seen from its other end
        sender_is_src = {"in": True, "out": False, "both": fwd}[program.gather_dir]
        self.s = Triplet("snd_", "rcv_", sender_is_src)
        self.sig = program.signal(self.s) if program.signal is not None else None
        self.receiver_cols = sorted(self.t.vertex_columns("rcv_") | self.s.vertex_columns("rcv_"))
        self.msg_at_sender = self._sender_only(self.t, program.gather_dir)
        self.sig_at_sender = self.sig is not None and self._sender_only(self.s, program.gather_dir)

    @staticmethod
    def _sender_only(t: Triplet, direction: str) -> bool:
        return not t.used_edge and all(p == "snd_" for p, _ in t.used)

    def _once(self, key, build):
        """Column lists are the same in every round; build each only once."""
        if key not in self._columns:
            self._columns[key] = build()
        return self._columns[key]

    def _sender_columns(self, first: bool) -> tuple[list, Column | None]:
        wanted = set()
        if not self.msg_at_sender:
            wanted |= self.t.vertex_columns("snd_")
        if self.sig is not None and not first and not self.sig_at_sender:
            wanted |= self.s.vertex_columns("snd_")
        out = ["snd_id", *[f"`snd_{c}`" for c in sorted(wanted)]]
        if self.msg_at_sender:
            out.append(self.msg.alias("_msg"))
        if first or self.sig is None:
            return out, None
        sig = F.coalesce(self.sig, F.lit(False)) if self.sig_at_sender else F.lit(True)
        sends = F.col(ACTIVE) & sig
        return [*out, sends.alias("_sig")], sends

    def _senders(self, state: DataFrame, first: bool) -> DataFrame:
        """Sender rows with just the columns the arcs need."""
        renamed = self._once(
            "renamed",
            lambda: [*[F.col(f"`{c}`").alias(f"snd_{c}") for c in state.columns if c != ACTIVE], ACTIVE],
        )
        out, sends = self._once(("senders", first), lambda: self._sender_columns(first))
        rows = state.select(*renamed)
        if sends is not None and self.program.changes_only:
            rows = rows.where(sends)
        return rows.select(*out)

    def _with_receivers(self, arcs: DataFrame, state: DataFrame) -> DataFrame:
        if not self.receiver_cols:
            return arcs
        hot = self.layout.hot_receivers
        ends = state.select(
            F.col("id").alias("rcv_id"), *[F.col(f"`{c}`").alias(f"rcv_{c}") for c in self.receiver_cols]
        )
        key = ["rcv_id", "_rpiece"] if hot else ["rcv_id"]
        return hot.spread(arcs, ["rcv_id"], "_rpiece").join(hot.copies(ends, ["rcv_id"], "_rpiece"), key)

    def messages(self, state: DataFrame, first: bool, senders: DataFrame | None = None) -> DataFrame:
        arcs = self.layout.from_senders(self._senders(state if senders is None else senders, first))
        arcs = self._with_receivers(arcs, state)
        if not first and self.program.changes_only and self.sig is not None and not self.sig_at_sender:
            arcs = arcs.where(self.sig)
        return arcs.select(*self._once(("messages", first), lambda: self._message_columns(first)))

    def _message_columns(self, first: bool) -> list:
        msg = F.col("_msg") if self.msg_at_sender else self.msg
        out = [F.col("rcv_id").alias("id"), msg.alias("_msg")]
        if not first and self.sig is not None:
            sig = F.col("_sig")
            if not self.sig_at_sender:
                sig = sig & F.coalesce(self.sig, F.lit(False))
            out.append(sig.alias("_sig"))
        return out

    def reduce(self, messages: DataFrame, first: bool) -> DataFrame:
        flag = None if first or self.sig is None else "_sig"
        return self.reducer.reduce(messages, ["id"], "_msg", "acc", flag)

    def round(self, state: DataFrame, first: bool) -> DataFrame:
        acc = self.reduce(self.messages(state, first), first)
        return state.join(acc, "id", "left").select(*self._merge_columns(state, first))

    def _merge_columns(self, state: DataFrame, first: bool) -> list[Column]:
        return self._once(
            ("merge", first),
            lambda: merged_columns(state, self.program.apply, self._active(first), self.program.default),
        )

    def next_rows(self, state: VertexState) -> DataFrame:
        """All vertices after a round that is not the first."""
        if not state.layers:
            return self.round(state.base, False)
        acc = self.reduce(self.messages(state.rows(), False, state.latest()), False)
        return state.rows().join(acc, "id", "left").select(*self._merge_columns(state.base, False))

    def changed_rows(self, state: VertexState) -> DataFrame:
        """Only the vertices that such a round changes: those it makes active."""
        acc = self.reduce(self.messages(state.rows(), False, state.latest()), False)
        rows = state.look_up(acc.where("_sig")).where(self._active(False))
        return rows.select(*self._merge_columns(state.base, False))

    def _active(self, first: bool) -> Column:
        if first:
            return F.lit(True)
        if self.sig is None:
            return F.lit(False)
        if self.program.accept is None:
            return F.col("_sig")
        return F.col("_sig") & F.coalesce(self.program.accept(vertex_view(), F.col("acc")), F.lit(False))


def _run_arc_plan(graph, program, max_iter, on_limit, layout, scratch) -> GasResult:
    if layout is None:
        layout = ArcLayout(graph, program.gather_dir, edge_columns_used(program))
        try:
            return _run_arc_plan(graph, program, max_iter, on_limit, layout, scratch)
        finally:
            layout.release()
    spark = graph.spark
    plan = ArcPlan(program, layout)
    start = cut(graph.vertices.withColumn(ACTIVE, F.lit(True)))
    with fixed_layout(spark, layout.partitions):
        state = VertexState(start, layout.partitions)
        history: list[int] = []
        iterations, converged = 0, None
        if start.isEmpty():
            converged = True
        while converged is None and (max_iter is None or iterations < max_iter):
            # with ``changes_only`` nobody else sends, and nobody but the newly active changes
            few = iterations > 0 and program.changes_only and program.signal is not None
            few = few and history[-1] <= FEW * history[0]
            after = plan.changed_rows(state) if few else _round_of(plan, state, iterations)
            written, n_active = cut_counting(after, ACTIVE)
            if n_active == 0:
                converged = True
                drop(written)
                break
            if few:
                state.add(written, n_active)
            else:
                state.replace(written)
            iterations += 1
            history.append(n_active)
            if program.signal is None:
                converged = True
        if converged is None and on_limit == "error":
            if active_count(_round_of(plan, state, iterations)).first()[0]:
                raise NotConverged(f"still active after {max_iter} rounds")
            converged = True
        final = state.settle()
    scratch.keep(final)
    return GasResult(graph.with_vertices(final.drop(ACTIVE)), iterations, history, converged)


def _round_of(plan: ArcPlan, state: VertexState, iterations: int) -> DataFrame:
    return plan.round(state.base, True) if iterations == 0 else plan.next_rows(state)


def edge_columns_used(program: Program) -> list[str]:
    t = Triplet("rcv_", "snd_", False)
    program.gather(t)
    used = set(t.used_edge)
    if program.signal is not None:
        s = Triplet("snd_", "rcv_", True)
        program.signal(s)
        used |= s.used_edge
    return sorted(used)


# ----------------------------------------------------------------------- triplet plan


class _TripletPlan:
    """Separate gather and scatter passes over edges that carry data as state."""

    def __init__(self, graph: PropertyGraph, program: Program):
        self.program = program
        self.reducer = as_reducer(program.reducer)
        self.edge_columns = graph.edge_columns
        self.hot = {end: graph.stats().hot(end) for end in ("src", "dst")}
        self._edges_written: DataFrame | None = None
        self._spent: list[DataFrame] = []

    def cut_edges(self, rows: DataFrame) -> DataFrame:
        """Write the edges; what was written for them before is spent."""
        self.spend_edges()
        self._edges_written = cut(rows)
        return self._edges_written

    def spend_edges(self) -> None:
        """What was written last for the edges is spent too."""
        if self._edges_written is not None:
            self._spent.append(self._edges_written)
            self._edges_written = None

    def drop_spent(self) -> None:
        for df in self._spent:
            drop(df)
        self._spent = []

    def start(self, edges: DataFrame) -> DataFrame:
        rows = edges.select(
            F.col("src").alias("s_id"),
            F.col("dst").alias("d_id"),
            *[F.col(f"`{c}`").alias(f"e_{c}") for c in self.edge_columns],
        )
        return self.deal(rows)

    def deal(self, rows: DataFrame) -> DataFrame:
        """Give the edges of hot ends their pieces."""
        rows = self.hot["src"].spread(rows, ["s_id"], "_spiece")
        return self.hot["dst"].spread(rows, ["d_id"], "_dpiece")

    def finish(self, rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("s_id").alias("src"),
            F.col("d_id").alias("dst"),
            *[F.col(f"`e_{c}`").alias(c) for c in self.edge_columns],
        )

    def _join_end(self, rows: DataFrame, state: DataFrame, end: str) -> DataFrame:
        p, piece, hot = ("s_", "_spiece", self.hot["src"]) if end == "src" else ("d_", "_dpiece", self.hot["dst"])
        ends = state.select(*[F.col(f"`{c}`").alias(f"{p}{c}") for c in state.columns])
        key = [f"{p}id", piece] if hot else [f"{p}id"]
        return rows.join(hot.copies(ends, [f"{p}id"], piece), key)

    def triplets(self, rows: DataFrame, state: DataFrame, order: tuple[str, str]) -> DataFrame:
        """Edges with both ends.  ``order`` starts with the end the rows rest by."""
        for end in order:
            rows = self._join_end(rows, state, end)
        return rows

    def _visit(self, trip: DataFrame, direction: str, value_of, update_of, value_type: str) -> DataFrame:
        """Visit every edge from its active ends, in the fixed order target, source.

        Adds ``_at_d`` (visit from the target) and ``_at_s`` (from the source)
        and replaces the edge data columns.
        """
        none = F.lit(None).cast(value_type) if value_type else F.lit(None)
        kept = [c for c in trip.columns if not c.startswith("e_")]
        old = {c: f"e_{c}" for c in self.edge_columns}
        flag = lambda name: F.coalesce(F.col(name), F.lit(False))
        at_target = flag(f"d_{ACTIVE}") if direction in ("in", "both") else F.lit(False)
        at_source = flag(f"s_{ACTIVE}") if direction in ("out", "both") else F.lit(False)
        independent = self.program.edge_mode == "independent"

        def step(df, t, active, out, blocked, base):
            value = F.when(active, value_of(t)) if value_of is not None else none
            news = update_of(t) if update_of is not None else {}
            columns = []
            for c in self.edge_columns:
                now = F.col(f"`e_{c}`")
                if c in news:
                    now = F.when(active & ~blocked, news[c]).otherwise(now).cast(df.schema[f"e_{c}"].dataType)
                columns.append(now.alias(f"e_{c}"))
            rest = [f"`{c}`" for c in df.columns if not c.startswith("e_")]
            return df.select(*rest, *columns, value.alias(out), *base)

        keep_old = [F.col(f"`e_{c}`").alias(f"o_{c}") for c in old] if independent else []
        t = Triplet("d_", "s_", False)
        df = step(trip, t, at_target, "_at_d", F.lit(False), keep_old)
        seen = {c: F.col(f"`o_{c}`") for c in old} if independent else None
        t = Triplet("s_", "d_", True, edge_columns=seen)
        # independent: where the target has written, its value stands
        blocked = at_target if independent else F.lit(False)
        df = step(df, t, at_source, "_at_s", blocked, [])
        return df.select(*[f"`{c}`" for c in kept], *[f"`e_{c}`" for c in self.edge_columns], "_at_d", "_at_s")

    def _edge_rows(self, visited: DataFrame) -> list[str]:
        carried = [c for c in ("_spiece", "_dpiece", NUMBER) if c in visited.columns]
        return ["s_id", "d_id", *carried, *[f"`e_{c}`" for c in self.edge_columns]]

    @staticmethod
    def _both_ways(visited: DataFrame, to_d: str, to_s: str, direction: str, value: str) -> DataFrame:
        if direction == "in":
            pairs = visited.select(F.col("d_id").alias("id"), F.col(to_d).alias(value))
        elif direction == "out":
            pairs = visited.select(F.col("s_id").alias("id"), F.col(to_s).alias(value))
        else:
            ways = F.array(
                F.struct(F.col("d_id").alias("id"), F.col(to_d).alias(value)),
                F.struct(F.col("s_id").alias("id"), F.col(to_s).alias(value)),
            )
            pairs = visited.select(F.explode(ways).alias("_p")).select("_p.id", f"_p.{value}")
        return pairs.where(F.col(value).isNotNull())

    def gather(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges after the gather, and one accumulator row per vertex that got any."""
        p = self.program
        if p.gather_dir == "none":
            empty = state.select("id", F.lit(None).alias("acc")).where(F.lit(False))
            return rows, empty
        trip = self.triplets(rows, state, ("src", "dst"))
        if p.gather_edge_update is None and p.gather_dir in ("in", "out"):
            trip = trip.where(F.col(f"d_{ACTIVE}" if p.gather_dir == "in" else f"s_{ACTIVE}"))
        visited = self._visit(trip, p.gather_dir, p.gather, p.gather_edge_update, "")
        if p.gather_edge_update is not None:
            visited = self.cut_edges(visited.select(*self._edge_rows(visited), "_at_d", "_at_s"))
            rows = visited.select(*self._edge_rows(visited))
        msgs = self._both_ways(visited, "_at_d", "_at_s", p.gather_dir, "_msg")
        return rows, self.reducer.reduce(msgs, ["id"], "_msg", "acc")

    def scatter(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges after the scatter, and the ids of the signalled vertices."""
        p = self.program
        if p.scatter_dir == "none" or (p.signal is None and p.scatter_edge_update is None):
            return rows, state.select("id").where(F.lit(False))
        order = ("dst", "src") if p.gather_edge_update is not None else ("src", "dst")
        trip = self.triplets(rows, state, order)
        if p.scatter_edge_update is None and p.scatter_dir in ("in", "out"):
            trip = trip.where(F.col(f"d_{ACTIVE}" if p.scatter_dir == "in" else f"s_{ACTIVE}"))
        visited = self._visit(trip, p.scatter_dir, p.signal, p.scatter_edge_update, "boolean")
        if p.scatter_edge_update is not None:
            visited = self.cut_edges(visited.select(*self._edge_rows(visited), "_at_d", "_at_s"))
            rows = visited.select(*self._edge_rows(visited))
        # the visiting end signals the opposite one: the target's answer goes to the source
        flipped = {"in": "out", "out": "in", "both": "both"}[p.scatter_dir]
        signals = self._both_ways(visited, "_at_s", "_at_d", flipped, "_sig")
        return rows, signals.where("_sig").select("id").distinct()

    def superstep(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows, acc = self.gather(rows, state)
        p = self.program
        applied = cut(merge_accumulators(state, acc, p.apply, F.col(ACTIVE), p.default))
        self._spent.append(applied)
        rows, signalled = self.scatter(rows, applied)
        return rows, merge_signals(applied, signalled)


class _FewActive:
    """Supersteps of the triplet plan while few vertices are active.

    Only edges with an active end that is visited from are joined to their ends, and
    only these edges and the active vertices are written, as layers above the
    tables.  Both passes of a superstep visit from the same vertices, so they share their edges.
    """

    def __init__(self, plan: _TripletPlan, places: EdgePlaces, rows: DataFrame, state: DataFrame):
        self.plan, self.places, self.partitions = plan, places, places.partitions
        self.vertices = VertexState(state, self.partitions)
        self.active = state.where(ACTIVE).select("id")
        self.edges = VertexState(cut(self._by_number(rows)), self.partitions)
        self._active_written: DataFrame | None = None
        plan.spend_edges()
        plan.drop_spent()

    def _by_number(self, rows: DataFrame) -> DataFrame:
        data = ["s_id", "d_id", *[f"`e_{c}`" for c in self.plan.edge_columns]]
        rows = rows.select(F.col(NUMBER).alias("id"), *data)
        return rows.repartition(self.partitions, "id").sortWithinPartitions("id")

    def _rows(self, edges: DataFrame) -> DataFrame:
        return self.plan.deal(edges.withColumnRenamed("id", NUMBER))

    def _state(self) -> DataFrame:
        """All vertices with their newest data and flag."""
        return merge_signals(self.vertices.rows(), self.active)

    def superstep(self) -> int:
        """One superstep; returns how many vertices are active after it."""
        plan, p = self.plan, self.plan.program
        touched, _ = _written(self._rows(self.edges.look_up(self.places.touching(self.active))))
        rows, acc = plan.gather(touched.drop(ONE), self._state())
        changed = self.vertices.look_up(self.active).join(acc, "id", "left")
        self.vertices.add(*_written(changed.select(*merged_columns(self.vertices.base, p.apply, F.lit(True), p.default))))
        rows, signalled = plan.scatter(rows, self._state())
        self.edges.add(*_written(self._by_number(rows)))
        written, n_active = _written(signalled)
        drop(self._active_written)
        self._active_written, self.active = written, written.select("id")
        plan.spend_edges()
        drop(touched)
        plan.drop_spent()
        return n_active

    def leave(self) -> tuple[DataFrame, DataFrame]:
        """The edges and the vertices, as whole tables again."""
        edges, before = self.edges.settle(), self.vertices.settle()
        state, _ = cut_counting(merge_signals(before, self.active), ACTIVE)
        drop(before)
        drop(self._active_written)
        self.plan.spend_edges()
        self.plan._edges_written = edges
        return self._rows(edges), state


def _written(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` written, and their number."""
    return cut_counting(rows.withColumn(ONE, F.lit(True)), ONE)


def _run_triplet_plan(graph, program, max_iter, on_limit, scratch) -> GasResult:
    spark = graph.spark
    n = partitions_for(spark, max(graph.stats().n_edges, graph.n_vertices()))
    state = cut(graph.vertices.withColumn(ACTIVE, F.lit(True)))
    places: EdgePlaces | None = None
    few: _FewActive | None = None
    with fixed_layout(spark, n):
        plan = _TripletPlan(graph, program)
        rows = plan.start(graph.inner_edges())
        by_source = ["s_id", "_spiece"] if plan.hot["src"] else ["s_id"]
        rows = rows.repartition(n, *by_source).sortWithinPartitions(*by_source)
        if program.updates_edges:
            # edges are state; numbered as they are written, so that layers can name them
            rows = plan.cut_edges(rows.withColumn(NUMBER, F.monotonically_increasing_id()))
        else:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        resting = rows
        history: list[int] = []
        n_active = active_count(state).first()[0]
        iterations = 0
        while n_active and (max_iter is None or iterations < max_iter):
            history.append(n_active)
            if program.updates_edges and program.visited_ends and n_active <= FEW * history[0]:
                if few is None:
                    places = places or EdgePlaces(rows, program.visited_ends, plan.hot, n)
                    few = _FewActive(plan, places, rows, state)
                n_active = few.superstep()
            else:
                if few is not None:
                    rows, state = few.leave()
                    few = None
                before = state
                rows, state = plan.superstep(rows, state)
                state, n_active = cut_counting(state, ACTIVE)
                drop(before)
                plan.drop_spent()
            iterations += 1
        if few is not None:
            rows, state = few.leave()
            plan.drop_spent()
    if n_active and on_limit == "error":
        raise NotConverged(f"still active after {max_iter} rounds")
    edges = plan.finish(rows) if program.updates_edges else graph.inner_edges()
    if not program.updates_edges:
        resting.unpersist()
    scratch.keep(state)
    if program.updates_edges:
        scratch.keep(rows if plan._edges_written is None else plan._edges_written)
    result = PropertyGraph(state.drop(ACTIVE), edges, complete=True)
    return GasResult(result, iterations, history, n_active == 0)


# ----------------------------------------------------------------------------- surface


def run_gas(
    graph: PropertyGraph,
    program: Program,
    max_iter: int | None = None,
    on_limit: str = "error",
    layout: ArcLayout | None = None,
) -> GasResult:
    """Run ``program`` in synchronous rounds until no vertex is active.

    ``max_iter`` caps the rounds.  ``on_limit`` says what happens when the cap
    is met by a program that is still active: "error", or "return" for callers
    that ask for an unfinished result.  Without a cap the program must come to
    rest by itself.
    """
    if on_limit not in ("error", "return"):
        raise ValueError("on_limit must be 'error' or 'return'")
    if max_iter == 0:
        return GasResult(graph, 0, [], None)
    with Scratch() as scratch:
        if program.fits_arc_plan():
            return _run_arc_plan(graph, program, max_iter, on_limit, layout, scratch)
        return _run_triplet_plan(graph, program, max_iter, on_limit, scratch)


def superstep(
    graph: PropertyGraph, program: Program, active: Column | bool = True
) -> tuple[PropertyGraph, DataFrame]:
    """One gather, apply and scatter.

    Returns the graph after it and its vertices with the new flag ``active``.
    """
    flag = F.coalesce(active, F.lit(False)) if isinstance(active, Column) else F.lit(active)
    plan = _TripletPlan(graph, program)
    state = graph.vertices.withColumn(ACTIVE, flag)
    rows, state = plan.superstep(plan.start(graph.inner_edges()), state)
    edges = plan.finish(rows) if program.updates_edges else graph.inner_edges()
    after = PropertyGraph(state.drop(ACTIVE), edges, complete=True)
    return after, state.withColumnRenamed(ACTIVE, "active")


def signal_frontier(
    graph: PropertyGraph,
    active: Column,
    signal: Callable[[Triplet], Column],
    direction: str = "out",
) -> DataFrame:
    """Ids that ``active`` vertices signal along their edges, each once."""
    program = Program(
        gather=lambda t: F.lit(None), reducer=F.max, apply=lambda v, a: {}, signal=signal, scatter_dir=direction
    )
    plan = _TripletPlan(graph, program)
    state = graph.vertices.withColumn(ACTIVE, F.coalesce(active, F.lit(False)))
    return plan.scatter(plan.start(graph.inner_edges()), state)[1]
