"""Long ways are reached region by region: same sums, fewer rounds than edges."""

import heapq
import random

from pyspark.sql import functions as F

from sparkgas import PropertyGraph
from sparkgas.algorithms import paths
from sparkgas.plans import regions


def brute(ids, arcs, source):
    out, queue = {}, [(0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in out and v in ids:
            out[v] = d
            for to, w in arcs.get(v, ()):
                heapq.heappush(queue, (d + w, to))
    return out


def test_a_long_chain_takes_few_rounds(spark):
    edges = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0.5).alias("w"))
    g = PropertyGraph(spark.range(73), edges)
    far = paths.shortest_paths(g, 0)
    assert far.iterations < 40 and far.converged
    assert {r.id: r.dist for r in paths.distances(far).collect()} == {i: i / 2 if i <= 70 else -1.0 for i in range(73)}
    hops = paths.hop_counts(g, 0)
    assert hops.iterations < 40
    assert {r.id: r.hops for r in hops.graph.vertices.collect()} == {i: i if i <= 70 else None for i in range(73)}


def test_many_small_regions(spark, monkeypatch):
    """Clumps in a row, repeated and missing vertices, loops, parallel edges, a missing weight; every part is tiny."""
    monkeypatch.setattr(paths, "NEAR", 3)
    monkeypatch.setattr(regions, "LEAST", 1)
    monkeypatch.setattr(regions, "MOST", 30)
    rng = random.Random(4)
    pairs = [(12, 13, None), (5, 5, 1.0), (900, 3, 0.0), (30, 900, 0.0)]
    for clump in range(8):
        low = 10 * clump
        pairs += [(low + rng.randrange(10), low + rng.randrange(10), float(rng.randint(0, 9))) for _ in range(25)]
        pairs.append((low + rng.randrange(10), low + 10 + rng.randrange(10), 0.25))
    ids = [*range(90), 7]
    g = PropertyGraph(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(pairs, "src bigint, dst bigint, w double"))
    both, out = {}, {}
    for a, b, w in pairs:
        out.setdefault(a, []).append((b, 1))
        if w is not None:
            both.setdefault(a, []).append((b, w))
            both.setdefault(b, []).append((a, w))
    source = pairs[4][0]
    want = brute(set(ids), both, source)
    got = paths.distances(paths.shortest_paths(g, source)).collect()
    assert set(map(tuple, got)) == {(i, float(want.get(i, -1))) for i in ids}
    want = brute(set(ids), out, source)
    got = paths.hop_counts(g, source).graph.vertices.collect()
    assert {(r.id, r.hops) for r in got} == {(i, want.get(i)) for i in ids}


def test_what_regions_cannot_hold_goes_on_round_by_round(spark, monkeypatch):
    monkeypatch.setattr(paths, "NEAR", 2)
    pairs = [(i, i + 1, 1.0) for i in range(6)] + [(6, 7, float("inf"))]
    g = PropertyGraph(spark.range(8), spark.createDataFrame(pairs, "src bigint, dst bigint, w double"))
    got = paths.distances(paths.shortest_paths(g, 0)).collect()
    assert {r.id: r.dist for r in got} == {**{i: float(i) for i in range(7)}, 7: float("inf")}
