"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by length, longest first, into parts, and packed into blocks. Each query first
meets the longest parts; its k-th score there bounds from below what a result can be, and so, by its own
length, how long a vector must be to matter. As parts fall in length, that is the last part it has to
meet; queries are dealt into chunks in the order of it, and a chunk meets the parts up to its furthest one only.
A part and a chunk meet as one group, so each is sent once for each of the other, and there are few of either: up to
``TILE`` components are one part or chunk.
Within a block the local cosine threshold that the bound implies prunes on: the block is skipped whole,
cut by coordinates where the threshold is high and a trial says that it pays, cut by length where it is not. What is
left is verified by exact products, and the scores of one block bound the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, read

BLOCK_SCHEMA = "part int, ids binary, vecs binary, dim int, top double"
PACK_SCHEMA = "chunk int, q_ids binary, q_vecs binary, q_bounds binary, q_dim int, q_reach int"
HIT_SCHEMA = "query_id long, vec_id long, score long"
#: Components of a part or chunk, where there are more than a few for each core; tasks that tiles are dealt to at most.
TILE, TASKS = 1 << 23, 10_000
#: Products of a vector that cost as much as its bound by coordinates, one query at a time.
COORDINATE_COST = 512


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _narrow(vecs: np.ndarray) -> np.ndarray:
    """The same integers in 2, 4 or 8 bytes."""
    least, most = int(vecs.min(initial=0)), int(vecs.max(initial=0))
    return vecs.astype(next(d for d in (np.int16, np.int32, np.int64) if np.iinfo(d).min <= least and most <= np.iinfo(d).max))


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    """Rows of what ``_narrow`` made."""
    return np.frombuffer(raw, f"i{len(raw) // max(1, n * dim) or 8}").reshape(n, dim)


def _pack(rows: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of up to ``rows`` vectors of one dimension, in the order they come."""
        part = TaskContext.get().partitionId()
        held: dict[int, list] = {}

        def block(dim: int, own: list) -> dict:
            vecs = np.array([v for _, v in own], np.int64).reshape(len(own), dim)
            top = float(np.sqrt((vecs.astype(np.float64) ** 2).sum(1).max()))
            return {"part": part, "ids": np.array([i for i, _ in own], np.int64).tobytes(), "vecs": _narrow(vecs).tobytes(), "dim": dim, "top": top}

        for frame in frames:
            out = []
            for i, v in zip(frame["vec_id"], frame["vec"], strict=True):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) == rows:
                    out.append(block(len(v), held.pop(len(v))))
            yield pd.DataFrame(out, columns=["part", "ids", "vecs", "dim", "top"])
        yield pd.DataFrame([block(d, own) for d, own in held.items()], columns=["part", "ids", "vecs", "dim", "top"])

    return pack


def _exact(queries: np.ndarray, vecs: np.ndarray, longest: float) -> np.ndarray:
    """Integer products, in float32 or float64 where every sum on the way is exact in it, else in int64. No such sum
    is above ``longest``, the product of the largest lengths."""
    kind = np.float32 if longest < 2**24 else np.float64 if longest < 2**53 else np.int64
    return queries.astype(kind, copy=False) @ vecs.astype(kind, copy=False).T


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, bound: float) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, without the query's own row and
    without scores below ``bound``."""
    kept = np.flatnonzero((ids != own) & (scores >= bound))
    if len(kept) > k:
        kept = kept[scores[kept] >= np.partition(scores[kept], len(kept) - k)[len(kept) - k]]
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


def _lengths(vecs: np.ndarray) -> np.ndarray:
    return np.sqrt((vecs.astype(np.float64) ** 2).sum(1))


def search_block(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int, coordinates: int = 3, high: float = 0.4, cost: float = COORDINATE_COST, few: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score) of the vectors of one block that can still be among the k best of each query, by
    its bound; up to k, or up to ``few`` where no more reach the bound. ``p`` is in order of falling length."""
    at, found, scores = [], [], []

    def keep(query: int, place: np.ndarray, row: np.ndarray) -> None:
        at.append(np.full(len(place), query))
        found.append(ids[place])
        scores.append(row.astype(np.int64))

    p_len, q_len = _lengths(p), _lengths(q)
    top = p_len.max(initial=0.0)
    reach = q_len * top * (1 + 1e-9) + 1e-6
    alive = reach >= bounds
    local = np.where(bounds > 0, bounds / np.maximum(reach, 1e-300), 0.0)
    by_length = alive & (local < high)
    by_coordinate = np.flatnonzero(alive & (local >= high))
    unit = p / np.maximum(p_len, 1e-300)[:, None] if len(by_coordinate) and p.shape[1] > cost else None
    for nth, i in enumerate(by_coordinate):
        if unit is None:
            by_length[by_coordinate[nth:]] = True
            break
        u = q[i] / max(q_len[i], 1e-300)
        focus = np.argsort(-np.abs(u), kind="stable")[:coordinates]
        part = unit[:, focus]
        cosine = part @ u[focus] + np.sqrt(max(0.0, 1 - (u[focus] ** 2).sum())) * np.sqrt(np.maximum(0.0, 1 - (part**2).sum(1)))
        kept = np.flatnonzero((cosine + 1e-9) * q_len[i] * p_len + 1e-6 >= bounds[i])
        if len(kept):
            row = _exact(q[i : i + 1], p[kept], q_len[i] * top)[0]
            best_ = best(row, ids[kept], q_ids[i], k, bounds[i])
            keep(i, kept[best_], row[best_])
        if len(kept) * p.shape[1] + cost * len(p) > p.shape[1] * len(p):
            unit = None  # it cuts too little here: the others by length
    by_length = np.flatnonzero(by_length)
    if len(by_length):
        needed = np.where(bounds[by_length] > 0, bounds[by_length] / np.maximum(q_len[by_length], 1e-300), 0.0).min() * (1 - 1e-9) - 1e-6
        last = int((p_len >= needed).sum()) if np.all(p_len[:-1] >= p_len[1:]) else len(p)
        product = _exact(q[by_length], p[:last], q_len[by_length].max() * top)
        some = np.flatnonzero(product.max(1, initial=-np.inf if product.dtype.kind == "f" else np.iinfo(np.int64).min) >= bounds[by_length])
        own = by_length[some]
        hit = product[some] >= bounds[own, None]
        many = hit.sum(1) > max(few, k)
        if many.any() and last > k + 1:  # the query's own row may be one of the k + 1 highest
            highest = np.partition(product[some[many]], last - k - 1, axis=1)[:, last - k - 1]
            hit[many] &= product[some[many]] >= highest[:, None]
            many = hit.sum(1) > max(few, k)  # ties
        for i in np.flatnonzero(many):
            row = product[some[i]]
            best_ = best(row, ids[:last], q_ids[own[i]], k, bounds[own[i]])
            keep(own[i], best_, row[best_])
        hit[many] = False
        row, column = np.nonzero(hit)
        other = ids[column] != q_ids[own[row]]
        row, column = row[other], column[other]
        at.append(own[row])
        found.append(ids[column])
        scores.append(product[some[row], column].astype(np.int64))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in (at, found, scores))


def _k_best(hits: tuple[np.ndarray, ...], k: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The k best of each query of (place, id, score) in order; the places of queries that have k, and their k-th scores."""
    order = np.lexsort((hits[1], -hits[2], hits[0]))
    at, ids, scores = (x[order] for x in hits)
    opens = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    nth = np.arange(len(at)) - np.repeat(opens, np.diff(np.append(opens, len(at))))
    kth = np.flatnonzero(nth == k - 1)
    return (at[nth < k], ids[nth < k], scores[nth < k]), at[kth], scores[kth]


def _search(k: int):
    def search(blocks: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        """The k best of each query of a chunk among the vectors of a part."""
        out = [(np.zeros(0, np.int64),) * 3]
        blocks = blocks.sort_values("top", ascending=False, kind="stable")
        for y in packs.itertuples(index=False):
            q_ids, bounds = np.frombuffer(y.q_ids, np.int64), np.frombuffer(y.q_bounds, np.float64).copy()
            q, hits = _matrix(y.q_vecs, len(q_ids), y.q_dim), (np.zeros(0, np.int64),) * 3
            for x in blocks.itertuples(index=False):
                if x.dim != y.q_dim:
                    continue
                ids = np.frombuffer(x.ids, np.int64)
                new = search_block(q_ids, q, bounds, ids, _matrix(x.vecs, len(ids), x.dim), k)
                if len(new[0]):
                    hits, full, least = _k_best(tuple(np.concatenate(pair) for pair in zip(hits, new, strict=True)), k)
                    bounds[full] = np.maximum(bounds[full], least)
            out.append((q_ids[hits[0]], hits[1], hits[2]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return search


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """The k highest inner products of each query among all vectors, exact, ties to the smaller
    id: query_id, rank (from 1), vec_id, score.

    ``vectors`` and ``queries``: vec_id (long), vec (array of long, no nulls). Rows without an id
    take no part; a row whose id is the query's is not its candidate; vectors of another
    dimension are not candidates; empty vectors score 0. Exact while sums of products fit 64 bits.
    Repeated ids are repeated candidates.

    Parts of the vectors meet chunks of the stated queries, each pair as one group, so no task holds more than one of each;
    pairs in which no product can reach a query's bound are not made.
    """
    spark = vectors.sparkSession
    length = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    vectors, queries = vectors.where("vec_id IS NOT NULL"), queries.where("vec_id IS NOT NULL")
    queries = cut(queries.select("vec_id", "vec", F.sqrt(length).alias("length")))
    volume = (F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0)))
    (count, size), (n_queries, q_size) = vectors.agg(*volume).first(), queries.agg(*volume).first()
    if not count or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide = 4 * spark.sparkContext.defaultParallelism
    parts = max(1, -(-size // TILE), min(-(-count // rows), 2 * wide))
    ranged = vectors.withColumn("__length", length).repartitionByRange(parts, F.col("__length").desc(), F.xxhash64("vec_id"))
    blocks = cut(ranged.sortWithinPartitions(F.col("__length").desc()).select("vec_id", "vec").mapInPandas(_pack(rows), BLOCK_SCHEMA))
    last = blocks.agg(F.max("part")).first()[0]
    first = int((last + 1) ** 0.5)  # the longest parts, which give the bounds
    chunks = max(1, -(-q_size // TILE), min(-(-n_queries // query_rows), -(-wide // first)))

    def meet(with_bounds: DataFrame, reach: Column, low: int) -> DataFrame:
        dealt = with_bounds.withColumn("reach", reach.cast("int")).where(F.col("reach") >= low)
        asked = dealt.repartitionByRange(chunks, F.col("reach").desc(), "vec_id").sortWithinPartitions(F.col("reach").desc())
        packs = cut(asked.select("vec_id", "vec", "bound", "reach").mapInPandas(_pack_queries(query_rows), PACK_SCHEMA))
        met = packs.withColumn("part", F.explode(F.sequence(F.lit(low), F.col("q_reach"))))
        tiles = packs.groupBy("chunk").agg(F.max("q_reach").alias("q_reach")).select(F.col("chunk").alias("to"), F.explode(F.sequence(F.lit(low), F.col("q_reach"))).alias("part"))
        sent = blocks.where(F.col("part") >= low).join(tiles, "part").select("part", "to", "ids", "vecs", "dim", "top")
        # So many tasks that tiles, which are small as bytes and large as work, don't come to lie together.
        dealt_to = min(2 * chunks * (last + 1), TASKS)
        one, two = sent.repartition(dealt_to, "part", "to").groupBy("part", "to"), met.repartition(dealt_to, "part", "chunk").groupBy("part", "chunk")
        return one.cogroup(two).applyInPandas(_search(k), HIT_SCHEMA)

    start = meet(queries.withColumn("bound", F.lit(float("-inf"))), F.lit(first - 1), 0)
    if first > last:
        return _top(start, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    start = cut(_top(start, k))
    bounds = start.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound")).dropDuplicates(["vec_id"])
    bounded = queries.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    rest = meet(bounded, reach_of(blocks, last, F.col("length")), first)
    return _top(start.select("query_id", "vec_id", "score").unionByName(rest), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def reach_of(blocks: DataFrame, last: int, length: Column, steps: int = 1024) -> Column:
    """The last part that a query of ``length`` and ``bound`` has to meet, -1 for none. Parts fall in
    length; at most ``steps`` runs of them are told apart, by a list of their largest lengths."""
    width = -(-(last + 1) // steps)
    runs = blocks.groupBy(F.floor(F.col("part") / width).alias("run")).agg(F.max("top").alias("top")).orderBy("run").collect()  # at most `steps` rows
    tops = F.split(F.lit(",".join(repr(r["top"] * (1 + 1e-9) + 1e-6) for r in runs)), ",").cast("array<double>")
    met = F.size(F.filter(tops, lambda t: t * length * (1 + 1e-9) + 1e-6 >= F.col("bound")))
    return F.when(F.col("bound") > 0, F.least(met * width - 1, F.lit(last))).otherwise(F.lit(last))


def _pack_queries(rows: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries of one dimension, up to ``rows`` of a frame, in rows that know their chunk: the task's number."""
        chunk = TaskContext.get().partitionId()
        for frame in frames:
            out = []
            for dim, own in frame.groupby(frame["vec"].str.len(), sort=True):
                for i in range(0, len(own), rows):
                    x = own.iloc[i : i + rows]
                    vecs = _narrow(np.array(x["vec"].tolist(), np.int64).reshape(len(x), int(dim)))
                    out.append({"chunk": chunk, "q_ids": x["vec_id"].to_numpy(np.int64).tobytes(), "q_vecs": vecs.tobytes(), "q_bounds": x["bound"].to_numpy(np.float64).tobytes(), "q_dim": int(dim), "q_reach": int(x["reach"].max())})
            yield pd.DataFrame(out, columns=["chunk", "q_ids", "q_vecs", "q_bounds", "q_dim", "q_reach"])

    return pack


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding").where(usable(F.col("embedding")))
    vectors = e.select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("vec"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, p.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND len(p.vec) = len(q.vec))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
