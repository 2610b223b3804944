"""Edge cases of the data model, the file formats and the loops."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkgas import NotConverged, Program, PropertyGraph, run_gas, signal_frontier, superstep
from sparkgas.algorithms import components, ranking
from sparkgas.operators import derive, messages, triplets
from sparkgas.plans import cluster
from sparkgas.sources import edge_list, text_dump


def write(tmp_path, text, name="edges.tsv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


# ------------------------------------------------------------------------------ files


def test_payload_forms(spark, tmp_path):
    path = write(tmp_path, "1\t2\n 3 \t 4 \tx\n5\t6\ta\tb\n7\t8\tc\t\n")
    g = edge_list.read_edge_list(spark, path)
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, ""), (3, 4, "x"), (5, 6, "a\tb"), (7, 8, "c")]
    assert sorted(map(tuple, g.vertices.collect())) == [(i, 1) for i in range(1, 9)]


@pytest.mark.parametrize("line", ["1", "a\tb", "", "1.5\t2"])
def test_malformed_lines(spark, tmp_path, line):
    path = write(tmp_path, f"1\t2\n{line}\n3\t4\n")
    with pytest.raises(PySparkException, match="malformed input"):
        edge_list.read_edge_list(spark, path).edges.collect()
    kept = edge_list.read_edge_list(spark, path, mode="dropmalformed").edges.collect()
    assert sorted((r.src, r.dst) for r in kept) == [(1, 2), (3, 4)]
    shown = edge_list.read_edge_list(spark, path, mode="permissive").edges.where("src is null").collect()
    assert [r.payload for r in shown] == [line]


def test_strict_reader(spark, tmp_path):
    lines = [f"{i}\t{(i * 7) % 50 + 3}\t {i / 2} " for i in range(40)]
    path = write(tmp_path, "\n".join(lines) + "\n")
    g = edge_list.read_edge_list_strict(
        spark, path, {"w": F.col("payload").cast("double")}, {"label": F.col("id")}
    )
    assert [(r.eid, r.src, r.dst, r.w) for r in g.edges.orderBy("eid").collect()] == [
        (i, i, (i * 7) % 50 + 3, i / 2) for i in range(40)
    ]
    ids = [r.id for r in g.vertices.orderBy("id").collect()]
    assert ids == list(range(max(ids) + 1)) and 0 in ids
    with pytest.raises(PySparkException, match="malformed input"):
        edge_list.read_edge_list_strict(spark, write(tmp_path, "1\t2\t3\t4\n", "bad.tsv")).edges.collect()


def test_strict_line_numbers_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    n = 3000
    for part in range(3):
        text = "".join(f"{part * n + i}\t{i}\n" for i in range(n))
        (folder / f"part-{part:05d}").write_text(text)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        edges = edge_list.read_edge_list_strict(spark, str(folder)).edges
        assert edges.where("eid <> src").count() == 0
        assert edges.count() == 3 * n
    finally:
        spark.conf.set(key, before)


def test_sampled_rows(spark):
    edges = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    g = edge_list.from_edges_only(edges, fraction=0.5, seed=3)
    assert 800 < g.n_edges() < 1200
    assert {r.value for r in g.vertices.select("value").distinct().collect()} == {1.0}


def test_text_dump(weighted, tmp_path, spark):
    path = str(tmp_path / "dump")
    text_dump.write_graph_lines(weighted, path)
    parts = sorted((tmp_path / "dump").glob("part-*"))
    text = "".join(p.read_text() for p in parts).splitlines()
    assert text[:3] == ["Vertices", "0 : 1", "1 : 1"]
    assert text[7:10] == ["", "Edges", "1->2 : 1.0"]
    assert len(text) == 1 + 6 + 2 + 10


# ------------------------------------------------------------------------------ graphs


def test_from_rows_counts_preview(chained):
    assert {r.kind: r.n for r in chained.counts().collect()} == {"edges": 7, "vertices": 9}
    assert [r.id for r in chained.preview(3).collect()] == [0, 1, 2]
    vertices, edges = chained.fetch_all()
    assert (len(vertices), len(edges)) == (9, 7) == (chained.n_vertices(), chained.n_edges())


def test_dangling_edges(spark):
    args = (spark, [(1, 1), (2, 1)], [(1, 2, 0), (2, 9, 0), (8, 1, 0)])
    g = PropertyGraph.from_rows(*args)
    assert [(r.src, r.dst) for r in g.inner_edges().collect()] == [(1, 2)]
    labels = components.connected_components(g).graph.vertices
    assert sorted(map(tuple, labels.collect())) == [(1, 1), (2, 1)]
    sums = messages.aggregate_messages(g, lambda t: t.other.id, F.sum, "both")
    assert sorted(map(tuple, sums.collect())) == [(1, 2), (2, 1)]
    with pytest.raises(ValueError, match="not a vertex"):
        g.validate()
    with pytest.raises(ValueError, match="not unique"):
        PropertyGraph.from_rows(spark, [(1, 1), (1, 2)], [(1, 1, 0)]).validate()


def test_empty_graph(spark):
    g = PropertyGraph.from_rows(spark, [], [])
    result = components.connected_components(g)
    assert result.graph.vertices.collect() == [] and result.converged
    assert messages.reduce_vertices(g, F.col("data"), F.sum, "s").collect() == [(None,)]
    assert messages.reduce_edges(g, lambda t: t.edge["data"], F.sum, "s").collect() == [(None,)]
    assert derive.densify_vertices(g.edges).count() == 0


def test_replication(spark, chained):
    copies = {(r.id, r.pid) for r in derive.vertex_partitions(chained.edges, 2).collect()}
    assert copies == {(1, 1), (2, 1), (2, 0), (3, 0), (3, 1), (4, 0), (5, 0), (5, 1), (6, 1), (6, 0), (7, 0), (7, 1), (8, 1)} | {(1, 1)}
    by_edge = derive.vertex_replication(chained.edges, 3, "edge").collect()
    assert all(1 <= r.copies <= 2 for r in by_edge)


# ------------------------------------------------------------------------------- loops


def counting(**kw):
    """Adds up one per in-edge and stays active."""
    return Program(
        gather=lambda t: F.lit(1).cast("bigint"),
        reducer=F.sum,
        default=-1,
        apply=lambda v, acc: {"data": acc},
        signal=lambda t: F.lit(True),
        **kw,
    )


def data(df):
    return {r.id: r.data for r in df.collect()}


def test_default_is_substituted_not_added(spark):
    g = PropertyGraph.from_rows(spark, [(1, 7), (2, 7)], [(1, 2, 0)])
    assert data(run_gas(g, counting(), max_iter=1, on_limit="return").graph.vertices) == {1: -1, 2: 1}


def test_no_rounds(chained):
    result = run_gas(chained, counting(), max_iter=0)
    assert result.graph is chained and result.iterations == 0


def test_loops_count_twice_in_both(spark):
    g = PropertyGraph.from_rows(spark, [(1, 0), (2, 0)], [(1, 1, 0), (1, 2, 0)])
    both = run_gas(g, counting(gather_dir="both", scatter_dir="both"), max_iter=1, on_limit="return")
    assert data(both.graph.vertices) == {1: 3, 2: 1}
    slow = run_gas(g, counting(gather_dir="both", scatter_dir="both", scatter_edge_update=lambda t: {}), max_iter=1, on_limit="return")
    assert data(slow.graph.vertices) == {1: 3, 2: 1}


def test_isolated_and_inactive_vertices(spark):
    """An isolated vertex applies once; a vertex that is not signalled keeps its data."""
    g = PropertyGraph.from_rows(spark, [(0, 5), (1, 5), (2, 5)], [(1, 2, 0)])
    p = Program(
        gather=lambda t: t.src["data"],
        reducer=F.sum,
        default=0,
        apply=lambda v, acc: {"data": acc + v["data"] + 1},
        signal=lambda t: F.lit(True),
    )
    result = run_gas(g, p, max_iter=50)
    assert data(result.graph.vertices) == {0: 6, 1: 6, 2: 18}
    assert (result.active_history, result.converged) == ([3, 1], True)


def test_no_gather_direction(spark, chained):
    p = counting(gather_dir="none", scatter_dir="none")
    result = run_gas(chained, p, max_iter=5)
    assert set(data(result.graph.vertices).values()) == {-1}
    assert (result.iterations, result.converged) == (1, True)


def test_cap(spark):
    g = PropertyGraph.from_rows(spark, [(1, 0), (2, 0)], [(1, 2, 0), (2, 1, 0)])
    with pytest.raises(NotConverged):
        run_gas(g, counting(), max_iter=3)
    assert run_gas(g, counting(), max_iter=3, on_limit="return").converged is None
    rewriting = counting(gather_edge_update=lambda t: {"data": t.edge["data"] + 1})
    with pytest.raises(NotConverged):
        run_gas(g, rewriting, max_iter=3)
    assert run_gas(g, rewriting, max_iter=3, on_limit="return").converged is False


def test_the_two_plans_agree(chained):
    """A no-op edge update forces the triplet plan; results and history must not change."""
    def program(**kw):
        return Program(
            gather=lambda t: t.other["data"],
            reducer=F.min,
            apply=lambda v, acc: {"data": F.least(v["data"], acc)},
            signal=lambda t: t.other["data"] > t.center["data"],
            gather_dir="both",
            scatter_dir="both",
            **kw,
        )

    g = chained.with_vertices(chained.vertices.select("id", F.col("id").alias("data")))
    arc, trip = (run_gas(g, program(**kw)) for kw in ({}, {"scatter_edge_update": lambda t: {}}))
    assert data(arc.graph.vertices) == data(trip.graph.vertices)
    assert (arc.active_history, arc.iterations) == (trip.active_history, trip.iterations)


def test_null_messages_are_no_messages(weighted):
    p = lambda t: F.when(t.edge["w"] > 0.4, t.edge["w"])
    sent = messages.messages(weighted, p, "in").collect()
    assert len(sent) == 3
    acc = messages.aggregate_messages(weighted, p, F.sum, "in").collect()
    assert {r.id: r.acc for r in acc} == {2: 1.0, 3: 1.0}


def test_out_gather_and_in_scatter(spark):
    """Heights against the edges: the reversed program on the reversed graph."""
    def heights(g, gather_dir, scatter_dir):
        p = Program(
            gather=lambda t: t.other["data"] + 1,
            reducer=F.max,
            default=0,
            apply=lambda v, acc: {"data": acc},
            signal=lambda t: F.lit(True),
            gather_dir=gather_dir,
            scatter_dir=scatter_dir,
        )
        return data(run_gas(g, p, max_iter=20).graph.vertices)

    rows = [(1, 2, 0), (2, 3, 0), (1, 3, 0), (4, 3, 0)]
    v = [(i, 0) for i in range(1, 5)]
    forward = PropertyGraph.from_rows(spark, v, rows)
    backward = PropertyGraph.from_rows(spark, v, [(d, s, w) for s, d, w in rows])
    assert heights(forward, "out", "in") == heights(backward, "in", "out") == {1: 2, 2: 1, 3: 0, 4: 1}


def test_superstep_and_frontier(chained_from_1):
    g, flags = superstep(chained_from_1, counting(), F.col("id") < 3)
    assert {r.id: r.data for r in g.vertices.collect()} == {1: 1, 2: 1, **{i: 1 for i in range(3, 9)}}
    assert {r.id for r in flags.where("active").collect()} == {2, 3}
    ends = signal_frontier(chained_from_1, F.col("id") == 5, lambda t: F.lit(True), "both")
    assert {r.id for r in ends.collect()} == {4, 6}


def test_loop_settings_are_restored(spark, weighted):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(k) for k in keys]
    ranking.pagerank(weighted)
    assert [spark.conf.get(k) for k in keys] == before


def test_checkpoints_go_to_the_named_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert cluster.checkpoint_dir(spark) == named
    assert cluster.scratch_path(spark, "x").startswith(named)


def test_superseded_rounds_are_deleted(spark, weighted, tmp_path):
    import pathlib

    folder = pathlib.Path(spark.sparkContext.getCheckpointDir().replace("file:", ""))
    before = set(folder.glob("rdd-*"))
    result = ranking.pagerank(weighted)
    left = set(folder.glob("rdd-*")) - before
    assert len(left) == 1
    assert result.graph.vertices.count() == 6


def test_active_triplets(chained):
    t = triplets.active_triplets(chained, F.col("id") == 4).collect()
    assert [(r.s_id, r.d_id, r.s_active, r.d_active) for r in t] == [(4, 5, True, False)]
