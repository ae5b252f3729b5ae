"""Co-occurrence graphs, label propagation, betweenness, communities by edge removal.

Graphs are edge tables (src, dst), undirected ones with an edge each way. Iterations are joins;
loops on the driver look at counts and single numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.lineage import cut


def co_counts(rows: DataFrame, actor: str, item: str, dedupe: bool = True) -> DataFrame:
    """(src, dst, weight) with src < dst: how many items two actors share. Without ``dedupe`` repeated
    rows count as often as they occur, and an actor's repeats pair with each other."""
    own = rows.select(F.col(actor).alias("actor"), F.col(item).alias("item")).where("actor IS NOT NULL AND item IS NOT NULL")
    if dedupe:
        own = own.distinct()
        met = own.withColumnRenamed("actor", "src").join(own.withColumnRenamed("actor", "dst"), "item").where("src < dst")
        return met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    n = own.groupBy("actor", "item").agg(F.count(F.lit(1)).alias("n"))
    met = n.select(F.col("actor").alias("src"), "item", F.col("n").alias("a")).join(n.select(F.col("actor").alias("dst"), "item", F.col("n").alias("b")), "item").where("src <= dst")
    pairs = F.when(F.col("src") == F.col("dst"), F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b"))
    return met.groupBy("src", "dst").agg(F.sum(pairs).cast("long").alias("weight")).where("weight > 0")


def co_graph(rows: DataFrame, actor: str, item: str, least: int, dedupe: bool = True) -> DataFrame:
    """(src, dst) both ways, for actors that share at least ``least`` items."""
    return mirrored(co_counts(rows, actor, item, dedupe).where(F.col("weight") >= least).select("src", "dst"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Each edge both ways, once."""
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): each vertex starts as its own label and takes, ``rounds`` times and all at once, the
    label most of its neighbours have, the smallest of equals."""
    edges = cut(edges.select("src", "dst"))
    labels = edges.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy("dst", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = cut(votes.groupBy(F.col("dst").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label")))
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """(label, members, size), members in order."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("size"))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest vertex that a path reaches; ``vertices`` (id) adds lone ones."""
    ids = edges.select(F.col("src").alias("id")).distinct()
    ids = ids if vertices is None else ids.unionByName(vertices.select("id")).distinct()
    edges, labels = cut(edges.select("src", "dst")), cut(ids.withColumn("component", F.col("id")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        step = cut(step)
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = cut(step.join(jump, "component").select("id", "old", F.col("further").alias("component")))
        if labels.where("component <> old").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(s, t, d, sigma): distance and number of shortest paths between all connected pairs, d = 0 for a
    vertex and itself. Frontiers advance for all sources at once, a level a round. A row per
    connected pair: for graphs that a threshold has made sparse."""
    edges = cut(edges.select("src", "dst"))
    frontier = cut(edges.select(F.col("src").alias("s")).distinct().select("s", F.col("s").alias("t"), F.lit(0).alias("d"), F.lit(1).cast("long").alias("sigma")))
    known, level = frontier, 0
    while True:
        step = frontier.join(edges.withColumnRenamed("src", "t"), "t").groupBy("s", F.col("dst").alias("t")).agg((F.first("d") + 1).alias("d"), F.sum("sigma").alias("sigma"))
        frontier = cut(step.join(known.select("s", "t"), ["s", "t"], "left_anti"))
        if frontier.isEmpty():
            return known
        known, level = known.unionByName(frontier), level + 1
        if level % 16 == 0:  # frontiers are written already; only the plan must not grow for ever
            known = cut(known)


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness) with src < dst: over all pairs of vertices, the share of their shortest
    paths that use the edge.

    Shares flow back from the farthest vertices of each source, a level a round: a vertex passes its own
    path and what reached it to those before it in proportion to their paths. So a round joins
    the vertices of a level with their edges, and no pair of vertices with another."""
    edges = cut(edges.select("src", "dst"))
    paths = shortest_paths(edges)
    depth = paths.agg(F.max("d")).first()[0] or 0
    used, share = None, None
    for d in range(depth, 0, -1):
        level = paths.where(F.col("d") == d).select("s", F.col("t").alias("v"), F.col("sigma").alias("n_v"))
        level = level.withColumn("passed", F.lit(1.0)) if share is None else level.join(share, ["s", "v"], "left").withColumn("passed", 1.0 + F.coalesce("passed", F.lit(0.0)))
        before = paths.where(F.col("d") == d - 1).select("s", F.col("t").alias("u"), F.col("sigma").alias("n_u"))
        flow = level.join(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), "v").join(before, ["s", "u"])
        flow = cut(flow.select("s", "u", "v", (F.col("passed") * F.col("n_u") / F.col("n_v")).alias("passed")))
        on = flow.groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.sum("passed").alias("passed"))
        used = on if used is None else used.unionByName(on)
        share = flow.groupBy("s", F.col("u").alias("v")).agg(F.sum("passed").alias("passed"))
    if used is None:
        return edges.select("src", "dst", F.lit(0.0).alias("betweenness")).where(F.lit(False))
    # Each pair counts from both of its ends.
    return used.groupBy("src", "dst").agg((F.sum("passed") / 2).alias("betweenness"))


def modularity(original: DataFrame, components: DataFrame, m: int) -> float | None:
    """Sum over unordered pairs in one component of A - k k / 2m, by 2m, with the original graph's
    edges and degrees; a pair's terms are got from sums by component, never from pairs. None of a graph
    without edges."""
    if not m:
        return None
    degree = original.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    sums = components.join(degree, "id", "left").groupBy("component").agg(F.sum(F.coalesce("k", F.lit(0))).alias("k"), F.sum(F.pow(F.coalesce("k", F.lit(0)), 2)).alias("kk"))
    expected = sums.agg(F.sum((F.pow("k", 2) - F.col("kk")) / 2)).first()[0] or 0.0
    ends = original.where("src < dst").join(components.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(components.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    inside = ends.where("a = b").count()
    return (inside - expected / (2 * m)) / (2 * m)


def without_top_edges(edges: DataFrame, betweenness: DataFrame, digits: int = 9) -> DataFrame:
    """The graph without all edges whose betweenness, rounded, is the largest."""
    scored = cut(betweenness.withColumn("score", F.round("betweenness", digits)))
    top = scored.agg(F.max("score")).first()[0]
    gone = mirrored(scored.where(F.col("score") == F.lit(top)).select("src", "dst"))
    return edges.join(gone, ["src", "dst"], "left_anti")


def dense_betweenness(a: np.ndarray) -> np.ndarray:
    """The same of each edge of a connected graph given by its symmetric 0/1 matrix: levels of all
    sources at once, forth and back, as matrix products."""
    front, seen, levels = np.eye(len(a)), np.eye(len(a), dtype=bool), []
    while front.any():
        levels.append(front)
        front = np.where(seen, 0.0, front @ a)
        seen |= front > 0
    used, passed = np.zeros_like(a), np.zeros_like(a)
    for d in range(len(levels) - 1, 0, -1):
        own = np.divide(1.0 + passed, levels[d], out=np.zeros_like(a), where=levels[d] > 0)
        used += levels[d - 1].T @ own
        passed = levels[d - 1] * (own @ a)
    return a * (used + used.T) / 2


def _parts(a: np.ndarray) -> list[np.ndarray]:
    """The vertices of each connected part of a graph."""
    label, out = np.full(len(a), -1), []
    for v in range(len(a)):
        if label[v] < 0:
            front = np.zeros(len(a), bool)
            front[v] = True
            while True:
                more = front | (a[front] > 0).any(0)
                if (more == front).all():
                    break
                front = more
            label[front] = len(out)
            out.append(np.flatnonzero(front))
    return out


def split_by_betweenness(ends: list[tuple], most_rounds: int | None = None, digits: int = 9, mutated: bool = False) -> dict:
    """``girvan_newman`` of a graph in memory: vertex -> component. Only parts that lose an edge are looked at again."""
    names = sorted({v for e in ends for v in e})
    place = {v: i for i, v in enumerate(names)}
    near: list[set[int]] = [set() for _ in names]
    for u, v in ends:
        near[place[u]].add(place[v])
        near[place[v]].add(place[u])
    degree, m = np.array([len(x) for x in near], float), sum(map(len, near)) / 2

    def part_of(vertices: np.ndarray) -> list[tuple]:
        """(vertices, matrix, betweenness) of each connected part of the graph's ``vertices``."""
        at = {int(v): i for i, v in enumerate(vertices)}
        a = np.zeros((len(vertices), len(vertices)))
        for v, i in at.items():
            for w in near[v]:
                a[i, at[w]] = 1.0
        found = []
        for own in _parts(a):
            inner = a[np.ix_(own, own)]
            found.append((vertices[own], inner, np.round(dense_betweenness(inner), digits) if len(own) > 1 else inner))
        return found

    whole = [set(x) for x in near]

    def gain(vertices: np.ndarray) -> float:
        own = set(vertices.tolist())
        edges, k = (near, np.array([len(near[v]) for v in vertices], float)) if mutated else (whole, degree[vertices])
        inside = sum(len(edges[v] & own) for v in own) / 2
        return (inside - (k.sum() ** 2 - (k**2).sum()) / 2 / (2 * m)) / (2 * m)

    # Connected parts first by search, so that no matrix is larger than a part.
    left, parts = set(range(len(names))), []
    while left:
        front = own = {left.pop()}
        while front:
            front = {w for v in front for w in near[v]} - own
            own = own | front
        left -= own
        parts += part_of(np.array(sorted(own)))
    gains = [gain(p[0]) for p in parts]
    best, best_q, rounds = [p[0] for p in parts], sum(gains), 0
    while (most_rounds is None or rounds < most_rounds) and any(p[1].any() for p in parts):
        rounds += 1
        top = max(p[2].max() for p in parts)
        after, after_gains = [], []
        for (vertices, a, score), q in zip(parts, gains, strict=True):
            if not a.any() or score.max() < top:
                after.append((vertices, a, score))
                after_gains.append(q)
                continue
            for i, j in zip(*np.nonzero((score == top) & (a > 0)), strict=True):
                near[vertices[i]].discard(int(vertices[j]))
            for p in part_of(vertices):
                after.append(p)
                after_gains.append(gain(p[0]))
        parts, gains = after, after_gains
        if sum(gains) > best_q + 1e-12:
            best, best_q = [p[0] for p in parts], sum(gains)
    return {names[v]: names[own.min()] for own in best for v in own.tolist()}


def girvan_newman(edges: DataFrame, most_rounds: int | None = None, local_vertices: int = 2_000, mutated: bool = False) -> DataFrame:
    """(id, component) of the best partition by modularity among those met while all edges of the
    largest betweenness are removed again and again; the earliest of equals. The whole graph counts
    as a partition too. ``most_rounds`` ends the search early; None goes on until no edge is left.

    There are about as many rounds as edges. A graph of at most ``local_vertices`` vertices, which is checked, is
    taken apart in one task; a larger one by joins, with the same result. ``mutated`` takes edges and degrees for
    the modularity from the graph as it is in each round instead of the original one.
    """
    original = cut(mirrored(edges))
    vertices = original.select(F.col("src").alias("id")).distinct()
    m = original.count() // 2
    kind = original.schema["src"].dataType
    if m and vertices.count() <= local_vertices:

        def take_apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ends = [e for frame in frames for e in zip(frame["src"], frame["dst"], strict=True)]
            yield pd.DataFrame(list(split_by_betweenness(ends, most_rounds, mutated=mutated).items()), columns=["id", "component"])

        schema = StructType([StructField("id", kind), StructField("component", kind)])
        return original.where("src < dst").coalesce(1).mapInPandas(take_apart, schema)
    graph, best, best_q, rounds = original, None, None, 0
    while True:
        parts = connected_components(graph, vertices)
        q = modularity(graph if mutated else original, parts, m) or 0.0
        if best_q is None or q > best_q + 1e-12:
            best, best_q = parts, q
        if graph.isEmpty() or (most_rounds is not None and rounds >= most_rounds):
            return best
        graph, rounds = cut(without_top_edges(graph, edge_betweenness(graph))), rounds + 1
