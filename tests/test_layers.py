"""A round with few active vertices writes few rows, and loses none."""

import random

import pytest
from pyspark.sql import functions as F

from sparkgas import Program, PropertyGraph, run_gas
from sparkgas.algorithms import paths
from sparkgas.plans import gas, state


@pytest.fixture
def written(monkeypatch):
    """Rows of every table that a loop writes, in order."""
    sizes = []

    def noting(real, of):
        def write(df, *more):
            out = real(df, *more)
            sizes.append(of(out).count())
            return out

        return write

    monkeypatch.setattr(gas, "cut", noting(gas.cut, lambda out: out))
    monkeypatch.setattr(state, "cut", noting(state.cut, lambda out: out))
    monkeypatch.setattr(gas, "cut_counting", noting(gas.cut_counting, lambda out: out[0]))
    return sizes


def chain_with_bystanders(spark, length, bystanders):
    edges = spark.range(length - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return PropertyGraph(spark.range(length + bystanders), edges)


def test_rows_written_follow_the_active_vertices(spark, written):
    """Twenty rounds with one active vertex each, among 5,020."""
    g = chain_with_bystanders(spark, 20, 5_000)
    result = paths.hop_counts(g, 0)
    got = {r["id"]: r["hops"] for r in result.graph.vertices.collect()}
    assert got == {i: i if i < 20 else None for i in range(5_020)}
    whole = [n for n in written if n >= 5_020]
    # the start, the first round, the round after it, the result
    assert len(whole) <= 4
    assert sum(written) - sum(whole) <= 20 * 6


def test_layers_hold_what_whole_tables_hold(spark, monkeypatch):
    """Shortest paths on random graphs; layers for every share of active vertices and for none."""
    rng = random.Random(3)
    n = 30
    pairs = [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 9))) for _ in range(50)]
    g = PropertyGraph.from_rows(spark, [(i, 0) for i in range(n)], pairs, edge_schema="src bigint, dst bigint, w double")
    results = []
    for few in (0.0, 1.0):
        monkeypatch.setattr(gas, "FEW", few)
        run = paths.shortest_paths(g, 0)
        results.append((sorted(map(tuple, run.graph.vertices.collect()), key=repr), run.active_history))
    assert results[0] == results[1]


def test_layers_of_a_program_that_reads_its_receivers(spark, monkeypatch):
    """Messages and acceptance look at the receiver, whose newest data may lie in any layer; caps see it too."""
    rng = random.Random(5)
    n = 20
    pairs = [(rng.randrange(n), rng.randrange(n), 1) for _ in range(30)]
    g = PropertyGraph.from_rows(spark, [(i, i) for i in range(n)], pairs)
    program = Program(
        gather=lambda t: F.when(t.other["low"] < t.center["low"], t.other["low"]),
        reducer=F.min,
        apply=lambda v, acc: {"low": F.least(v["low"], acc)},
        signal=lambda t: t.center["low"] < t.other["low"],
        gather_dir="both",
        scatter_dir="both",
        changes_only=True,
        accept=lambda v, acc: acc < v["low"],
    )
    start = g.with_vertices(g.vertices.select("id", F.col("id").alias("low")))
    results = []
    for few in (0.0, 1.0):
        monkeypatch.setattr(gas, "FEW", few)
        whole = run_gas(start, program)
        capped = run_gas(start, program, max_iter=3, on_limit="return")
        results.append([sorted(map(tuple, r.graph.vertices.collect())) + r.active_history for r in (whole, capped)])
    assert results[0] == results[1]


def test_merged_layers_keep_the_newest_rows(spark):
    base = spark.range(20).select("id", F.lit(-1).alias("v"))
    s = state.VertexState(base, 4)
    want = {i: -1 for i in range(20)}
    for r in range(8):
        ids = [(7 * r + k) % 20 for k in range(1 + r % 4)]
        s.add(spark.createDataFrame([(i, r) for i in ids], "id bigint, v int"), len(ids))
        want.update({i: r for i in ids})
        assert len(s.layers) <= state.LAYERS
    assert {x["id"]: x["v"] for x in s.rows().collect()} == want
    keyed = spark.range(0, 40, 3).withColumn("acc", F.col("id") * 2)
    got = {(x["id"], x["acc"], x["v"]) for x in s.look_up(keyed).collect()}
    assert got == {(i, 2 * i, want[i]) for i in range(0, 20, 3)}


def visits_program(**more):
    """Smallest labels along edges; the edge counts its gather visits."""
    return Program(
        gather=lambda t: t.other["label"],
        reducer=F.min,
        apply=lambda v, acc: {"label": F.least(v["label"], acc)},
        signal=lambda t: t.other["label"] > t.center["label"],
        **{"gather_dir": "both", "scatter_dir": "both", **more},
    )


def test_edge_rows_written_follow_the_active_vertices(spark, written, monkeypatch):
    """A label walks along a chain of 9 among 1,000 pairs that rest after the first round."""
    chain = spark.range(8).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    pairs = spark.range(100, 2_100, 2).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = chain.unionByName(pairs).withColumn("visits", F.lit(0).cast("bigint"))
    ids = spark.range(9).unionByName(spark.range(100, 2_100))
    g = PropertyGraph(ids.select("id", F.col("id").alias("label")), edges)
    program = visits_program(gather_edge_update=lambda t: {"visits": t.edge["visits"] + 1})
    result = run_gas(g, program)
    got = sorted(map(tuple, result.graph.edges.collect()))
    labels = {r["id"]: r["label"] for r in result.graph.vertices.collect()}
    assert labels == {**{i: 0 for i in range(9)}, **{i: i - i % 2 for i in range(100, 2_100)}}
    sizes, rounds = list(written), len(result.active_history)
    assert rounds > 6
    # vertices and edges at the start and in the first round, places, the turn to layers, the result
    assert len([n for n in sizes if n >= 1_000]) <= 12
    assert sum(n for n in sizes if n < 1_000) <= rounds * 60
    monkeypatch.setattr(gas, "FEW", 0.0)
    assert got == sorted(map(tuple, run_gas(g, program).graph.edges.collect()))


@pytest.mark.parametrize("mode,pieces", [("chained", 1_000), ("independent", 4)])
def test_edge_layers_hold_what_whole_tables_hold(spark, monkeypatch, mode, pieces):
    """Both passes update edges, in several directions, with repeated edges, loops and hubs."""
    rng = random.Random(7)
    n = 16
    rows = [(rng.randrange(n) if rng.random() < 0.7 else 0, rng.randrange(n), k) for k in range(30)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, k int").select(
        "*", F.col("k").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")
    )
    g = PropertyGraph(spark.range(n).select("id", F.col("id").alias("label")), edges, rows_per_piece=pieces)
    for directions in (("both", "both"), ("in", "out")):
        program = visits_program(
            gather_dir=directions[0],
            scatter_dir=directions[1],
            gather_edge_update=lambda t: {"a": t.edge["a"] * 2 + t.center["label"]},
            scatter_edge_update=lambda t: {"b": t.edge["b"] + t.edge["a"] % 7 + t.other["label"]},
            edge_mode=mode,
        )
        results = []
        # never, from the first round on, and in and out again
        for few in (0.0, 1.0, 0.5):
            monkeypatch.setattr(gas, "FEW", few)
            run = run_gas(g, program, max_iter=4, on_limit="return")
            tables = [sorted(map(tuple, t.collect())) for t in (run.graph.vertices, run.graph.edges)]
            results.append((*tables, run.active_history, run.converged))
        assert results[0] == results[1] == results[2]
