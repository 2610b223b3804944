"""Giant components and hubs must not meet in one task."""

import random

import pytest
from pyspark.sql import functions as F

from sparkgas import PropertyGraph
from sparkgas.algorithms import components, contraction, triangles

LEAVES, PARTS = 300_000, 16


@pytest.fixture
def partitions(spark):
    """Adaptive planning off, so that nothing but the plan itself spreads rows."""
    settings = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df) -> float:
    """Rows of the largest partition, in even shares of ``PARTS``."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) * PARTS / sum(sizes)


def star(spark):
    return spark.range(1, LEAVES + 1, 1, PARTS).select(F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"))


def test_a_giant_star_is_never_in_one_task(spark, partitions):
    edges = star(spark).distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined, _, written = contraction.with_smallest(both, "a", "b", LEAVES, 20_000)
    assert written is not None and joined.count() == 2 * LEAVES
    assert largest_share(joined) <= 2
    for step in (contraction._large_star, contraction._small_star):
        rewired, _ = step(edges, LEAVES, 20_000)
        assert largest_share(rewired) <= 2 and rewired.count() == LEAVES


def test_a_giant_component_has_one_label(spark, partitions):
    labels, _ = contraction.star_labels(star(spark), "a", "b", rows_per_piece=20_000)
    assert [tuple(r) for r in labels.groupBy("label").count().collect()] == [(0, LEAVES + 1)]


def test_cut_centres_give_the_same_labels(spark):
    rnd = random.Random(6)
    pairs = [(rnd.randrange(300), rnd.choice([0, 1, 2, rnd.randrange(300)])) for _ in range(260)]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    found = [sorted(map(tuple, contraction.star_labels(edges, rows_per_piece=piece)[0].collect())) for piece in (5, None)]
    assert found[0] == found[1]
    vertices = spark.range(300)
    labels = [
        sorted(map(tuple, components.connected_components(PropertyGraph(vertices, edges, rows_per_piece=p)).graph.vertices.collect())) for p in (5, 1000)
    ]
    assert labels[0] == labels[1]


def test_a_hub_of_triangles_is_spread(spark, partitions):
    """A hub with an edge to everyone, and a ring: as many triangles as edges of the ring."""
    n = 30_000
    ring = spark.range(1, n + 1, 1, PARTS).select(F.col("id").alias("src"), (F.col("id") % n + 1).alias("dst"))
    hub = spark.range(1, n + 1, 1, PARTS).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    pairs = triangles.canonical_pairs(hub.unionByName(ring))
    sizes, (rows, most) = triangles._observed(
        pairs.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), F.sum("n"), F.max("n")
    )
    assert (rows, most) == (4 * n, n)
    heavy = triangles._heavy(sizes, "n", rows, most, 1000)
    assert [tuple(r) for r in heavy.table.collect()] == [(0, 30)]
    table = sizes.select(F.col("id").alias("lo"), F.col("n").alias("lo_n"))
    assert largest_share(triangles.spread_join(pairs, table, ["lo"], hot=heavy)) <= 2
    graph = PropertyGraph(spark.range(n + 1), hub.unionByName(ring), complete=True, rows_per_piece=1000)
    counts = triangles.triangle_count(graph)
    assert [tuple(r) for r in counts.groupBy("triangles").count().orderBy("triangles").collect()] == [(2, n), (n, 1)]


def test_middle_vertices_with_many_paths(spark):
    """Incoming and outgoing pairs of a middle vertex, dealt over its pieces."""
    into = spark.range(400).select(F.col("id").alias("a"), F.lit(1000).cast("bigint").alias("b"))
    out = spark.range(2000, 2030).select(F.lit(1000).cast("bigint").alias("b"), F.col("id").alias("c"))
    whole, cut_up = (triangles._paths(into, out, piece) for piece in (1_000_000, 100))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut_up.collect())) and whole.count() == 12_000


def test_a_block_reads_its_own_arcs_and_senders(spark, monkeypatch):
    """Input rows of a step: the arcs into its block, and one row for each sender of theirs."""
    from sparkgas import Program, iterate_blocked
    from sparkgas.plans import rounds

    rnd = random.Random(12)
    pairs = [(rnd.randrange(40), rnd.randrange(90, 100)) for _ in range(300)] + [(i, (i + 1) % 100) for i in range(100)]
    graph = PropertyGraph(spark.range(100).withColumn("x", F.lit(1.0)), spark.createDataFrame(pairs, "src bigint, dst bigint"))
    seen, gathered = [], rounds._Blocks.gathered

    def spy(self, block, state):
        arcs, senders = self.arcs(block), self.senders(block, state.schema)
        files = [r[0] for df in (arcs, senders) for r in df.select(F.input_file_name()).distinct().collect()]
        assert all(f"/_to={block}/" in f for f in files)
        seen.append((block, arcs.count(), senders.count()))
        return gathered(self, block, state)

    monkeypatch.setattr(rounds._Blocks, "gathered", spy)
    program = Program(gather=lambda t: t.src["x"], reducer=F.sum, default=0.0, apply=lambda v, acc: {"x": acc / 8 + 1})
    found = {r.id: r.x for r in iterate_blocked(graph, program, 2, block_size=10).vertices.collect()}
    want = {b: [p for p in pairs if p[1] // 10 == b] for b in range(10)}
    assert seen == 2 * [(b, len(want[b]), len({s for s, _ in want[b]})) for b in range(10)]
    x = [1.0] * 100
    for _ in range(2):
        for b in range(10):
            new = {v: sum(x[s] for s, d in pairs if d == v) / 8 + 1 for v in range(10 * b, 10 * b + 10)}
            for v, value in new.items():
                x[v] = value
    assert all(abs(found[v] - x[v]) < 1e-9 for v in range(100))


def test_negative_weights_are_an_error(spark):
    from sparkgas.algorithms import paths

    edges = spark.createDataFrame([(1, 2, -1.0), (2, 3, 1.0)], "src bigint, dst bigint, w double")
    graph = PropertyGraph(spark.range(1, 4), edges)
    with pytest.raises(Exception, match="negative weight: -1.0"):
        paths.shortest_paths(graph, 1)
    missing = spark.createDataFrame([(1, 2, None), (2, 3, 1.0)], "src bigint, dst bigint, w double")
    assert sorted(map(tuple, paths.distances(paths.shortest_paths(PropertyGraph(spark.range(1, 4), missing), 1)).collect())) == [(1, 0.0), (2, -1.0), (3, -1.0)]
