"""Shortest paths from many nodes at once, against a plain search."""

import heapq

import numpy as np
import pytest

from urbanloom.operators import network


def plain(n, ends, costs, radius):
    """Brandes' sums of each node and edge over all sources."""
    near = [[] for _ in range(n)]
    for e, ((a, b), c) in enumerate(zip(ends, costs, strict=True)):
        near[a].append((b, c, e))
        near[b].append((a, c, e))
    on_node, on_edge = np.zeros(n), np.zeros(len(ends))
    for s in range(n):
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            for v, c, _ in near[u] if d == best[u] else ():
                if d + c <= radius and d + c < best.get(v, np.inf):
                    best[v] = d + c
                    heapq.heappush(heap, (d + c, v))
        order = sorted(best, key=best.get)
        before = {v: [(u, e) for u, c, e in near[v] if u in best and best[u] + c == best[v]] for v in order}
        paths, share = {s: 1.0}, dict.fromkeys(order, 0.0)
        for v in order[1:]:
            paths[v] = sum(paths[u] for u, _ in before[v])
        for v in reversed(order[1:]):
            on_node[v] += share[v]
            for u, e in before[v]:
                part = paths[u] / paths[v] * (1 + share[v])
                share[u] += part
                on_edge[e] += part
    return on_node / 2, on_edge / 2


@pytest.mark.parametrize("radius", [None, 9.0])
def test_shares_with_ties_slivers_and_parallel_edges(spark, monkeypatch, radius):
    rng = np.random.default_rng(4)
    n, ends = 40, [(i, i + 1) for i in range(30)] + [(0, 1), (7, 7)]
    ends += [(int(a), int(b)) for a, b in rng.integers(0, 38, (60, 2))]
    costs = [float(c) for c in rng.choice([0.0078125, 1.0, 2.0, 3.0, 4.0], len(ends))]
    nodes = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(n)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(100 + e, a, b, c, c) for e, ((a, b), c) in enumerate(zip(ends, costs, strict=True))], "edge_id long, a long, b long, cost double, len double")
    monkeypatch.setattr(network, "SEARCH_PLACES", 130)
    on_node, on_edge = plain(n, ends, costs, radius or np.inf)
    got = {r.node_id: r for r in network.centrality(nodes, edges, radius).collect()}
    assert [got[i].betweenness for i in range(n)] == pytest.approx(list(on_node)) and got[39].reach == 1
    streets = {r.edge_id: r.betw_edge for r in network.edge_centrality(nodes, edges, radius).collect()}
    assert [streets[100 + e] for e in range(len(ends))] == pytest.approx(list(on_edge))


def test_shares_are_summed_in_the_task(spark, monkeypatch):
    """A path of 400 nodes has 160,000 pairs of a source and a place; at most a row a task and place is stored."""
    stored = []

    def written(df):
        out = kept(df)
        stored.append((out.count(), [t for _, t in out.dtypes]))
        return out

    kept = network.written
    monkeypatch.setattr(network, "written", written)
    nodes = spark.range(400).selectExpr("id as node_id", "double(id) as x", "0D as y")
    edges = spark.range(399).selectExpr("id as edge_id", "id as a", "id + 1 as b", "1D as cost", "1D as len")
    found = network.centrality(nodes, edges).where("node_id = 1").first()
    assert found.betweenness == pytest.approx(398)
    tasks = spark.sparkContext.defaultParallelism * 2
    assert stored and all(n <= 400 * (tasks + 1) and not any(t.startswith("array") for t in kinds) for n, kinds in stored)
