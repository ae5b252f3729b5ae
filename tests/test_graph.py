from collections import deque

import numpy as np
import pytest

from lodestream.operators import graph as G

TRIANGLES = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]


@pytest.fixture
def bridge(spark):
    return G.mirrored(spark.createDataFrame(TRIANGLES, "src string, dst string"))


def brute_betweenness(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = {tuple(sorted(e)): 0.0 for e in edges}
    for root in near:
        level, sigma, parents, order, queue = {root: 0}, {root: 1.0}, {root: []}, [], deque([root])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in level:
                    level[w], sigma[w], parents[w] = level[v] + 1, 0.0, []
                    queue.append(w)
                if level[w] == level[v] + 1:
                    sigma[w] += sigma[v]
                    parents[w].append(v)
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in parents[w]:
                share = credit[w] * sigma[v] / sigma[w]
                credit[v] += share
                total[tuple(sorted((v, w)))] += share / 2
    return total


def test_threshold_repeats_and_self_pairs(spark):
    rows = spark.createDataFrame([("u", "x"), ("u", "x"), ("u", "y"), ("v", "x"), ("v", "y"), ("w", "y"), (None, "y")], "a string, i string")
    assert {tuple(r) for r in G.co_counts(rows, "a", "i").collect()} == {("u", "v", 2), ("u", "w", 1), ("v", "w", 1)}
    assert {tuple(r) for r in G.co_graph(rows, "a", "i", 2).collect()} == {("u", "v"), ("v", "u")}
    assert {tuple(r) for r in G.co_counts(rows, "a", "i", dedupe=False).collect()} == {("u", "u", 1), ("u", "v", 3), ("u", "w", 1), ("v", "w", 1)}


def test_bridge_has_the_most_betweenness(bridge):
    found = {(r["src"], r["dst"]): r["betweenness"] for r in G.edge_betweenness(bridge).collect()}
    assert found[("c", "d")] == 9.0
    assert found == pytest.approx(brute_betweenness(TRIANGLES))


def test_betweenness_of_a_square_with_a_tail(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (6, 7)]
    df = G.mirrored(spark.createDataFrame(edges, "src long, dst long"))
    assert {(r["src"], r["dst"]): r["betweenness"] for r in G.edge_betweenness(df).collect()} == pytest.approx(brute_betweenness(edges))
    assert {(r["id"], r["component"]) for r in G.connected_components(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6)}


def test_communities_by_edge_removal(bridge):
    parts = {r["id"]: r["component"] for r in G.girvan_newman(bridge).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}
    assert {r["id"]: r["component"] for r in G.girvan_newman(bridge, most_rounds=0).collect()} == dict.fromkeys("abcdef", "a")


def test_one_task_and_joins_take_a_graph_apart_alike(spark):
    ends = {(k, k + 1) for k in (0, 10, 20)} | {(k, k + 2) for k in (0, 10, 20)} | {(k + 1, k + 2) for k in (0, 10, 20)} | {(2, 10), (12, 20), (30, 31), (31, 32)}
    df = spark.createDataFrame(sorted(ends), "src long, dst long")
    for rounds, mutated in ((3, False), (2, True)):
        one, joined = ({r["id"]: r["component"] for r in G.girvan_newman(df, rounds, local_vertices=n, mutated=mutated).collect()} for n in (100, 0))
        assert one == joined and len(set(one.values())) > 2
    part = sorted(e for e in ends if e[0] < 30)
    names = sorted({v for e in part for v in e})
    a = np.zeros((len(names), len(names)))
    for u, v in part:
        a[names.index(u), names.index(v)] = a[names.index(v), names.index(u)] = 1
    found = G.dense_betweenness(a)
    assert {(names[i], names[j]): found[i, j] for i, j in zip(*np.nonzero(np.triu(a)), strict=True)} == pytest.approx(brute_betweenness(part))


def test_registered_operators_run_their_defaults(spark, monkeypatch):
    from lodestream.operators import features as X
    from lodestream.plans import registry

    asked = []
    monkeypatch.setattr(registry, "_graph", lambda *_: None)
    monkeypatch.setattr(G, "girvan_newman", lambda edges, most_rounds=None, **_: asked.append(most_rounds))
    registry.girvan_newman(spark, "")
    for name in ("_ratings", "_items", "_users"):
        monkeypatch.setattr(registry, name, lambda *_: (None, None))
    monkeypatch.setattr(registry, "cut", lambda df: df)
    monkeypatch.setattr(registry.R, "mean_ratings", lambda df: df)
    monkeypatch.setattr(X, "assemble", lambda *_: None)

    def fit(df, features, trees=100, **_):
        asked.append(trees)
        raise StopIteration

    monkeypatch.setattr(X, "fit_gbt", fit)
    with pytest.raises((StopIteration, AttributeError)):
        registry._gbt(spark, "")
    assert asked == [None, 100]


def test_labels_take_the_smallest_of_equals(spark):
    path = G.mirrored(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"))
    assert {(r["id"], r["label"]) for r in G.label_propagation(path, 1).collect()} == {(1, 2), (2, 1), (3, 2)}
    members = G.communities(G.label_propagation(path, 2)).collect()
    assert {(r["label"], tuple(r["members"])) for r in members} == {(1, (1, 3)), (2, (2,))}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert G.edge_betweenness(none).count() == G.label_propagation(none).count() == G.girvan_newman(none).count() == 0


def test_modularity_of_a_graph_without_edges_is_null(spark, monkeypatch):
    from lodestream.plans import registry

    none = spark.createDataFrame([], "src long, dst long")
    monkeypatch.setattr(registry, "_graph", lambda *_: none)
    assert [r["modularity"] for r in registry.community_modularity(spark, "").collect()] == [None]
    assert G.girvan_newman(G.mirrored(spark.createDataFrame([(1, 2)], "src long, dst long")), local_vertices=1).count() == 2
