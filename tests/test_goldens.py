"""Known results on the two small example graphs."""

import pytest

from sparkgas.algorithms import coloring, components, paths, ranking, triangles
from sparkgas.operators import derive
from sparkgas.sources import edge_list


def by_id(df, column):
    return [r[column] for r in sorted(df.select("id", column).collect())]


def test_pagerank_weighted(weighted):
    result = ranking.pagerank(weighted)
    expected = [0.15, 0.15, 0.181875, 0.233406, 0.332604, 0.615317]
    assert by_id(result.graph.vertices, "rank") == pytest.approx(expected, abs=1e-6)
    assert (result.iterations, result.converged) == (5, True)
    assert ranking.rank_total(result.graph).first()[0] == pytest.approx(1.663202, abs=1e-6)


def test_pagerank_chained(chained, chained_from_1):
    result = ranking.pagerank(chained)
    expected = [0.15, 1, 1, 1, 0.15, 0.2775, 0.385875, 0.477994, 0.556295]
    assert by_id(result.graph.vertices, "rank") == pytest.approx(expected, abs=1e-6)
    assert result.iterations == 5
    capped = ranking.pagerank(chained_from_1, tol=0.01, max_iter=10, initial=(1.0, 1.0), on_limit="return")
    assert by_id(capped.graph.vertices, "rank") == pytest.approx(expected[1:], abs=1e-6)
    assert capped.iterations == 5


def test_components(weighted, chained):
    assert by_id(components.connected_components(weighted).graph.vertices, "label") == [0, 1, 1, 1, 1, 1]
    assert by_id(components.connected_components(chained).graph.vertices, "label") == [0, 1, 1, 1, 4, 4, 4, 4, 4]
    assert by_id(components.neighborhood_min_id(weighted), "label") == [0, 1, 1, 1, 1, 1]
    assert by_id(components.neighborhood_min_id(chained), "label") == [0, 1, 1, 1, 4, 4, 5, 6, 7]


VISITS = {(1, 2): 2, (2, 3): 2, (3, 1): 2, (4, 5): 2, (5, 6): 3, (6, 7): 5, (7, 8): 7}


def test_component_visits(chained_from_1):
    counted = components.connected_components(chained_from_1, edge_visits=True)
    assert {(r.src, r.dst): r.visits for r in counted.graph.edges.collect()} == VISITS
    assert counted.iterations == 4
    rewritten = components.component_visits(chained_from_1)
    assert {(r.src, r.dst): r.visits for r in rewritten.graph.edges.collect()} == VISITS
    assert rewritten.iterations == 4


def test_edge_modes_differ(chained_from_1):
    """Both ends active in one round: two visits chained, one independent."""
    first = {m: components.component_visits(chained_from_1, m, max_iter=1, on_limit="return").graph.edges for m in ("chained", "independent")}
    assert {r.visits for r in first["chained"].collect()} == {2}
    assert {r.visits for r in first["independent"].collect()} == {1}


def test_greedy_color(weighted, chained):
    assert by_id(coloring.greedy_color(weighted).graph.vertices, "color") == [0, 4, 3, 2, 1, 0]
    assert by_id(coloring.greedy_color(chained).graph.vertices, "color") == [0, 2, 1, 0, 0, 1, 0, 1, 0]


def test_shortest_paths(weighted):
    result = paths.shortest_paths(weighted, 1)
    assert by_id(paths.distances(result), "dist") == pytest.approx([-1, 0, 0.5, 0.5, 0.33, 0.25])
    assert result.iterations == 3


def test_shortest_paths_needs_weights(spark, tmp_path):
    path = tmp_path / "edges.tsv"
    path.write_text("1\t2\n2\t3\n")
    from pyspark.sql import functions as F

    g = edge_list.read_edge_list(spark, str(path), {"w": F.col("payload").cast("double")})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        paths.shortest_paths(g, 1)


def test_triangles(weighted, chained):
    assert by_id(triangles.triangle_count(weighted), "triangles") == [0, 6, 6, 6, 6, 6]
    assert by_id(triangles.triangle_count(chained), "triangles") == [0, 1, 1, 1, 0, 0, 0, 0, 0]
    assert {r.common for r in triangles.edge_common_neighbors(weighted).collect()} == {3}
    shared = {(r.src, r.dst): r.common for r in triangles.edge_common_neighbors(chained).collect()}
    assert shared == {e: int(e[0] < 4) for e in VISITS}


def test_triangles_from_common_neighbors(weighted):
    """Halved sums of shared neighbours are the triangle counts on a simple graph."""
    shared = triangles.edge_common_neighbors(weighted)
    sums = triangles.edge_sum_to_vertices(weighted.with_edges(shared), "common")
    assert by_id(sums, "total") == [0, 6, 6, 6, 6, 6]


def test_linear_propagation(weighted, chained):
    assert ranking.linear_propagation(weighted).collect() == []
    values = {r.id: r.value for r in ranking.linear_propagation(chained).collect()}
    assert values == pytest.approx({1: 4.66178, 2: 4.66178, 3: 4.66178}, abs=1e-5)


def test_degrees(weighted, chained):
    rows = {r.id: (r.in_degree, r.out_degree) for r in derive.degrees(weighted).collect()}
    assert rows == {0: (0, 0), 1: (0, 4), 2: (1, 3), 3: (2, 2), 4: (3, 1), 5: (4, 0)}
    rows = {r.id: (r.in_degree, r.out_degree) for r in derive.degrees(chained).collect()}
    assert rows[4] == (0, 1) and rows[8] == (1, 0) and rows[6] == (1, 1)


def test_blocked_is_synchronous_with_one_block(weighted):
    one = ranking.pagerank_blocked(weighted, rounds=5, block_size=100).vertices
    reference = [0.15, 0.15, 0.181875, 0.233406, 0.332604, 0.615317]
    assert by_id(one, "rank") == pytest.approx(reference, abs=1e-6)
    # in id order every source comes before its targets here: one round is enough
    many = ranking.pagerank_blocked(weighted, rounds=1, block_size=1).vertices
    assert by_id(many, "rank") == pytest.approx(reference, abs=1e-6)


def test_top_vertices(weighted):
    g = ranking.pagerank(weighted).graph
    assert [r.id for r in ranking.top_vertices(g, "rank", 3).collect()] == [5, 4, 3]
    assert [r.id for r in ranking.top_vertices(g, "rank").collect()] == [5, 4, 3, 2, 0, 1]
