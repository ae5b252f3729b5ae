"""Clustering in rounds by summaries (count, sum, sum of squares), Bradley-Fayyad-Reina.

Points are (id, features). Three tables of summaries and assignments stand for the discard set (the
clusters asked for), the compression set (small clusters near none of those) and the retained
set (single points). Distances are Mahalanobis with a diagonal covariance. Each round's points are
assigned against the summaries as the round found them, which then are updated at once, so
the order of points doesn't matter and a round is joins and sums.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import cut
from .graph import connected_components, mirrored


def summaries(points: DataFrame) -> DataFrame:
    """(cluster, n, total, squares) of assigned points (cluster, features)."""
    each = points.select("cluster", F.posexplode("features").alias("at", "x")).groupBy("cluster", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    ordered = each.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s", "q"))).alias("v"))
    return ordered.select("cluster", "n", F.transform("v", lambda v: v["s"]).alias("total"), F.transform("v", lambda v: v["q"]).alias("squares"))


def merged(*tables: DataFrame) -> DataFrame:
    """Summaries of the same clusters added up."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    each = every.select("cluster", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("at", "v")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("v.total").alias("s"), F.sum("v.squares").alias("q"))
    ordered = each.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s", "q"))).alias("v"))
    return ordered.select("cluster", "n", F.transform("v", lambda v: v["s"]).alias("total"), F.transform("v", lambda v: v["q"]).alias("squares"))


def mahalanobis(features: Column, n: Column, total: Column, squares: Column) -> Column:
    """Distance of a point from a summary; null where a dimension doesn't vary."""
    parts = F.arrays_zip(features.alias("x"), total.alias("s"), squares.alias("q"))

    def one(v: Column) -> Column:
        mean = v["s"] / n
        variance = v["q"] / n - mean * mean
        return F.when(variance > 1e-12, (v["x"] - mean) * (v["x"] - mean) / variance)

    return F.sqrt(F.aggregate(F.transform(parts, one), F.lit(0.0), lambda a, x: a + x))


def nearest_within(points: DataFrame, clusters: DataFrame, reach: float | None = None, most: int = 10_000) -> DataFrame:
    """(id, cluster, distance) of each point's nearest summary at a distance below ``reach`` (default
    twice the root of the dimension), the smaller cluster of equals; points beyond have no row. The
    clusters meet all points in blocks of at most about ``most``, each a bounded broadcast; how many there are is counted."""
    limit = F.lit(reach) if reach is not None else 2 * F.sqrt(F.size("features"))
    blocks = max(1, -(-clusters.count() // most))
    scored = None
    for b in range(blocks):
        own = clusters.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == b)
        met = points.join(F.broadcast(own)).select("id", "cluster", limit.alias("limit"), mahalanobis(F.col("features"), F.col("n"), F.col("total"), F.col("squares")).alias("distance"))
        scored = met if scored is None else scored.unionByName(met)
    near = scored.where("distance < limit").groupBy("id").agg(F.min(F.struct("distance", "cluster")).alias("best"))
    return near.select("id", "best.cluster", "best.distance")


def merged_near(clusters: DataFrame, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(summaries, names (cluster, into)) with clusters made one whose centres are within reach of each other: an
    end of the link is nearest to the other's centre, and what links connect is one, by its smallest number."""
    centres = clusters.select(F.col("cluster").alias("id"), F.transform("total", lambda x: x / F.col("n")).alias("features"))
    links = None
    for b in range(blocks := max(1, -(-clusters.count() // most))):
        own = clusters.where(F.pmod(F.xxhash64("cluster"), F.lit(blocks)) == b)
        met = centres.join(F.broadcast(own), F.col("id") != F.col("cluster"))
        met = met.select("id", "cluster", (2 * F.sqrt(F.size("features"))).alias("limit"), mahalanobis(F.col("features"), F.col("n"), F.col("total"), F.col("squares")).alias("distance"))
        links = met if links is None else links.unionByName(met)
    near = links.where("distance < limit").groupBy("id").agg(F.min_by("cluster", F.struct("distance", "cluster")).alias("other"))
    edges = mirrored(near.select(F.col("id").alias("src"), F.col("other").alias("dst")))
    names = cut(connected_components(edges, clusters.select(F.col("cluster").alias("id"))).toDF("cluster", "into"))
    renamed = clusters.join(names, "cluster").select(F.col("into").alias("cluster"), "n", "total", "squares")
    return cut(merged(renamed)), names


def k_means(points: DataFrame, k: int, seed: int = 1, steps: int = 20) -> DataFrame:
    """(id, features, cluster) by k-means; with no more distinct points than clusters each is its own."""
    distinct = points.select("features").distinct()
    if distinct.limit(k + 1).count() <= max(k, 2):  # at most k rows, numbered in one place
        own = distinct.withColumn("cluster", (F.row_number().over(W.orderBy("features")) - 1).cast("int"))
        return points.join(own, "features").select(*points.columns, "cluster")
    vectors = points.withColumn("vector", array_to_vector("features"))
    model = KMeans(k=max(k, 2), seed=seed, maxIter=steps, featuresCol="vector", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("vector")


def _split(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points of clusters of two or more, points alone in theirs)."""
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("__n"))
    sized = cut(clustered.join(sizes, "cluster"))
    return sized.where("__n > 1").drop("__n"), sized.where("__n = 1").drop("__n")


class BFR:
    """The state of a clustering: summaries of both sets, where their points went, and the retained. With ``merge``
    compression clusters near each other become one after each round, and at the end those near one asked for part of it."""

    def __init__(self, k: int, seed: int = 1, merge: bool = False) -> None:
        self.k, self.seed, self.merge = k, seed, merge
        self.discard = self.compressed = self.assigned = self.small = self.retained = None
        self.numbers = 0

    def start(self, points: DataFrame) -> None:
        """The first round: five times as many clusters as asked for set single points aside; the others
        give the discard set; what was set aside is clustered into the compression set."""
        many, alone = _split(k_means(points, self.k * 5, self.seed))
        firm = k_means(many.drop("cluster"), self.k, self.seed)
        self.assigned = cut(firm.select("id", "cluster"))
        self.discard = cut(summaries(firm))
        self._recluster(alone.drop("cluster"))

    def _join_compressed(self, points: DataFrame) -> DataFrame:
        """Put points near a compression cluster into it; the others are returned."""
        if self.compressed is None or self.compressed.isEmpty():
            return points
        close = cut(nearest_within(points, self.compressed))
        self.small = cut(self.small.unionByName(close.select("id", "cluster")))
        self.compressed = cut(merged(self.compressed, summaries(points.join(close.select("id", "cluster"), "id"))))
        return points.join(close, "id", "left_anti")

    def _recluster(self, points: DataFrame) -> None:
        """Cluster loose points, half as many clusters as points. Those of groups of two or more go to a compression
        cluster near them, where there is one; what is left of a group becomes a new one, single points are retained."""
        n = points.count()
        none = points.withColumn("cluster", F.lit(0)).where(F.lit(False))
        grouped, alone = _split(k_means(points, 1 + n // 2, self.seed)) if n else (none, none)
        known = self.compressed
        if known is not None and not known.isEmpty():
            left = self._join_compressed(grouped.withColumnRenamed("cluster", "group"))
            grouped, more = _split(left.withColumnRenamed("group", "cluster"))
            alone = alone.unionByName(more)
        grouped = cut(grouped.withColumn("cluster", F.col("cluster") + F.lit(self.numbers)))
        self.numbers += 1 + n // 2 + 1
        fresh = summaries(grouped)
        self.compressed = cut(fresh if known is None else self.compressed.unionByName(fresh))
        small = grouped.select("id", "cluster")
        self.small = cut(small if self.small is None else self.small.unionByName(small))
        self.retained = cut(alone.drop("cluster"))
        if self.merge and not self.compressed.isEmpty():
            self.compressed, names = merged_near(self.compressed)
            self.small = cut(self.small.join(names, "cluster").select("id", F.col("into").alias("cluster")))

    def step(self, points: DataFrame) -> None:
        """A further round: to the discard set, else the compression set, else among the retained points,
        which are clustered again."""
        near = cut(nearest_within(points, self.discard))
        rest = points.join(near, "id", "left_anti")
        self.assigned = cut(self.assigned.unionByName(near.select("id", "cluster")))
        self.discard = cut(merged(self.discard, summaries(points.join(near.select("id", "cluster"), "id"))))
        self._recluster(self._join_compressed(rest).unionByName(self.retained))

    def finish(self) -> None:
        """With ``merge``: compression clusters whose centres are near a cluster asked for become part of it."""
        if not self.merge or self.compressed.isEmpty():
            return
        centres = self.compressed.select(F.col("cluster").alias("id"), F.transform("total", lambda x: x / F.col("n")).alias("features"))
        into = cut(nearest_within(centres, self.discard).select(F.col("id").alias("from"), F.col("cluster").alias("into")))
        gone = self.small.join(into, F.col("cluster") == F.col("from"))
        self.assigned = cut(self.assigned.unionByName(gone.select("id", F.col("into").alias("cluster"))))
        moved = self.compressed.join(into, F.col("cluster") == F.col("from")).select(F.col("into").alias("cluster"), "n", "total", "squares")
        self.discard = cut(merged(self.discard, moved))
        self.small = cut(self.small.join(into, F.col("cluster") == F.col("from"), "left_anti"))
        self.compressed = cut(self.compressed.join(into, F.col("cluster") == F.col("from"), "left_anti"))

    def counts(self) -> tuple[int, int, int, int]:
        """Points in the discard set, clusters and points in the compression set, retained points."""
        return self.assigned.count(), self.compressed.count(), self.small.count(), self.retained.count()

    def labels(self) -> DataFrame:
        """(id, cluster) of all points so far; -1 for those in no cluster asked for."""
        outside = self.small.select("id").unionByName(self.retained.select("id"))
        return self.assigned.select("id", "cluster").unionByName(outside.select("id", F.lit(-1).alias("cluster")))


def bfr(points: DataFrame, k: int, rounds: int = 5, seed: int = 1, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(labels (id, cluster), rounds (round, ds_points, cs_clusters, cs_points, rs_points)) of points (id,
    features) dealt into ``rounds`` by a hash of their ids. Points without features are left out. ``merge``: see BFR."""
    spark = points.sparkSession
    points = cut(points.where("id IS NOT NULL AND features IS NOT NULL").select("id", "features").withColumn("round", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rounds))))
    state, log = BFR(k, seed, merge), []
    for i in range(rounds):
        own = points.where(F.col("round") == i).drop("round")
        state.start(own) if i == 0 else state.step(own)
        if i == rounds - 1:
            state.finish()
        log.append((i + 1, *state.counts()))
    return state.labels(), spark.createDataFrame(log, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")
