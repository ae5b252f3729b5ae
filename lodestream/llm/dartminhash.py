"""Near-duplicate documents by DartMinHash over weighted word shingles.

A shingle that occurs w times is a region of weight w. Darts are thrown into (weight, rank) space
by hashes of the region alone, so equal regions of two documents hold the same darts; each dart
has a rank and one of k coordinates, and a document keeps the earliest dart of each coordinate
that falls into its regions. Two documents keep the same dart with the probability of their
weighted Jaccard similarity. Only about k ln k + 2k darts of a document are made, however long
it is. Signatures are cut into bands; documents that agree in a band are compared exactly.

Equal texts are folded before and are members of their class. Bands with many texts are not
expanded into pairs: each text is compared with the band's hub, the one that shares most bands
with others, and where that leaves a band in several classes, those outside the largest class with a hub of
their own. In bands that are in several classes still, the texts outside the largest class are
compared with all of the band in blocks of texts of like length, whose exact similarities are one matrix product and
of which only links that join classes come out. So no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, cut, join_heavy, mix64, numbered_down, read, small_batches
from .components import components
from .shingles import weighted_cells

#: Width of the first rank region; each later one is as wide as those before together, up to the widest.
_FIRST, _WIDEST = 0.5, 64.0


def _poisson_table(mean: float) -> np.ndarray:
    """Upper ends of 64-bit hash ranges for 0, 1, 2 ... events."""
    p, total, ends, n = np.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-17 and n < 40 + 4 * mean:
        total += p
        ends.append(min(total, 1.0) * 2.0**64)
        n += 1
        p *= mean / n
    return np.array([min(int(e), 2**64 - 1) for e in ends], np.uint64)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def throw(owner: np.ndarray, cells: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, rank, dart) of all darts in the texts' unit cells with rank below the text's limit.

    Rank regions are [0, 1/2), [1/2, 1), [1, 2), [2, 4) ... ; from 64 on they are as wide. The number of darts in a
    region of a cell is Poisson with its width, drawn from the hash of cell and region, as are
    their ranks: the same for every text that has the cell."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low, strip = 0.0, 0
    mine = limit[owner]
    while True:
        width = _FIRST if low == 0 else min(low, _WIDEST)
        alive = np.flatnonzero(mine > low)
        if not len(alive):
            break
        seed = mix64(cells[alive], 1000 + strip)
        count = np.searchsorted(_poisson_table(width), seed, side="right")
        hit = np.flatnonzero(count)
        rows, n = alive[hit], count[hit]
        rows, dart = np.repeat(rows, n), np.repeat(seed[hit], n)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix64(dart + nth.astype(np.uint64), 3)
        rank = low + width * _unit(mix64(dart, 4))
        keep = rank < mine[rows]
        found.append((owner[rows[keep]], rank[keep], dart[keep]))
        low, strip = low + width, strip + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _by_place_and_rank(at: np.ndarray, rank: np.ndarray, dart: np.ndarray) -> np.ndarray:
    """The order by place, rank, dart: by the first two as one number, unless that leaves ties."""
    bits = 63 - int(at.max(initial=0)).bit_length()
    key = (at.astype(np.uint64) << np.uint64(bits)) + (rank * (2.0 ** (bits - 1) / max(rank.max(initial=0.0), 1e-300))).astype(np.uint64)
    order = np.argsort(key)
    own = key[order]
    return np.lexsort((dart, rank, at)) if (own[1:] == own[:-1]).any() else order


def signatures(texts: list[str | None], k: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, one row of k darts per text; whether the text has any shingle)."""
    owner, cells = weighted_cells(texts, size)
    weight = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(texts), k), np.uint64)
    todo = weight > 0
    limit = np.where(todo, (k * np.log(k) + 2 * k) / np.maximum(weight, 1), 0.0)
    while todo.any():
        mine = todo[owner]
        text, rank, dart = throw(owner[mine], cells[mine], np.where(todo, limit, 0.0))
        at = text * k + (mix64(dart, 6) % np.uint64(k)).astype(np.int64)
        order = _by_place_and_rank(at, rank, dart)
        at, dart = at[order], dart[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        filled = np.bincount(at[first] // k, minlength=len(texts)) == k
        done = filled[at[first] // k]
        out.reshape(-1)[at[first][done]] = dart[first][done]
        todo &= ~filled
        limit = limit * 2
    return out, weight > 0


def _bands(bands: int, rows: int, size: int):
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            sig, any_ = signatures(frame["text"].tolist(), bands * rows, size)
            keys = np.zeros((len(frame), bands), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(rows):
                    keys = mix64(keys * np.uint64(31) + sig[:, j::rows], j)
            keys = keys.view(np.int64)
            out = frame[["doc", "digest"]].copy()
            out["bands"] = [list(k) if a else [] for k, a in zip(keys, any_, strict=True)]
            yield out

    return sign


def _cells(size: int):
    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(iter([frame]), "text"):
                owner, cell = weighted_cells(part["text"].tolist(), size)
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                yield pd.DataFrame({"node": part["node"], "weight": np.diff(edges), "cells": [cell[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)]})

    return cells


def similarity(a: bytes, b: bytes) -> float:
    """Of two texts by their sorted cells; 0 without any."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def _verify(threshold: float):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            similar = [similarity(x, y) >= threshold for x, y in zip(frame["cells_a"], frame["cells_b"], strict=True)]
            yield frame.loc[np.array(similar, bool), ["a", "b"]]

    return verify


def _checked(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as that; those whose lengths alone forbid it go first."""
    sides = [cells.select(F.col("node").alias(n), F.col("weight").alias(f"weight_{n}"), F.col("cells").alias(f"cells_{n}")) for n in ("a", "b")]
    fit = F.least("weight_a", "weight_b") >= F.greatest("weight_a", "weight_b") * threshold - 1e-6
    met = pairs.join(sides[0], "a").join(sides[1], "b").where(fit)
    return met.select("a", "b", "cells_a", "cells_b").mapInPandas(_verify(threshold), "a long, b long")


def _block_links(threshold: float, columns: int = 4096):
    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples(index=False):
                found = block_links(*([(m["node"], m["label"], m["cells"]) for m in side] for side in (x.outs, x.every)), threshold, columns)
                yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return link


def block_links(outs: list[tuple], every: list[tuple], threshold: float, columns: int = 4096) -> list[tuple[int, int]]:
    """Links between two blocks of (node, label, cells) that join labels: pairs of different labels
    with similarity ``threshold`` or more, without those that earlier ones already imply."""
    sides = [np.frombuffer(m[2], np.uint64) for m in (*outs, *every)]
    weight = np.array([len(x) for x in sides])
    owner, cell = np.repeat(np.arange(len(sides)), weight), np.concatenate(sides)
    names, place = np.unique(cell, return_inverse=True)
    shared = np.bincount(place, minlength=len(names)) > 1
    at = np.cumsum(shared) - 1
    owner, place = owner[shared[place]], at[place[shared[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(outs), len(every)), np.float32)
    for first in range(0, int(shared.sum()), columns):
        own = slice(*np.searchsorted(place, (first, first + columns)))
        matrix = np.zeros((len(weight), columns), np.float32)
        matrix[owner[own], place[own] - first] = 1
        both += matrix[: len(outs)] @ matrix[len(outs) :].T
    union = weight[: len(outs), None] + weight[None, len(outs) :] - both
    parent: dict = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    found = []
    for i, j in zip(*np.nonzero((both >= threshold * union) & (both > 0)), strict=True):
        a, b = root(outs[i][1]), root(every[j][1])
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((outs[i][0], every[j][0]))
    return found


def _mixed(many: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``many`` (band, key, node) with their label and ``main``, the largest class of the band, of bands
    that hold several classes."""
    now = cut(many.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    classes = now.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = classes.groupBy("band", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    return now.join(main, ["band", "key"])


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b): the hub of each band among those ``rows`` (band, key, node, known, and whether a node may be its hub)
    with all its other nodes. A hub shares most bands with others (``known``)."""
    hubs = rows.where("may").groupBy("band", "key").agg(F.max_by("node", F.struct("known", -F.col("node"))).alias("hub"))
    met = rows.join(hubs, ["band", "key"]).where("hub <> node")
    return met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _settled(mixed: DataFrame, cells: DataFrame, threshold: float, rows: int, size: int) -> DataFrame:
    """Links of bands that hold several classes (``mixed``): their texts outside the largest class against all
    of the band. Texts as similar as that have weights within that ratio, so blocks hold texts of a level of weight (a
    power of the ratio) and meet the blocks of the same and of the next levels only. A pair of blocks is a row of
    its own wherever it is joined, so that a band of very many texts is spread over all tasks. The texts are dealt
    out by their weights alone; each side meets the cells once, when it is made into blocks."""
    level = F.floor(F.log(F.greatest("weight", F.lit(1))) / float(-np.log(threshold)) + 1e-9)
    key = ["band", "key", "level"]
    rated = mixed.join(cells.select("node", "weight"), "node").where("weight > 0").withColumn("level", level.cast("int"))
    rated = cut(rated.select(*key, "node", "label", "weight", (F.col("label") != F.col("main")).alias("out")))
    item = F.struct("node", "label", "cells")

    def parts(own: DataFrame) -> DataFrame:
        """(band, key, level, parts): how many blocks of at most about so many rows and bytes of cells."""
        return own.groupBy(*key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), F.ceil(F.sum("weight") * 8 / size)).cast("int").alias("parts"))

    def blocks(own: DataFrame, counts: DataFrame, name: str) -> DataFrame:
        """(band, key, level, block, ``name``)."""
        dealt = own.join(counts, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        met = dealt.drop("weight").join(cells.select("node", "cells"), "node")
        return met.groupBy(*key, "block").agg(F.collect_list(item).alias(name))

    own, counts = rated.where("out"), parts(rated)
    outs, every = blocks(own, parts(own), "outs").drop("block"), blocks(rated, counts, "every")
    asked = outs.withColumn("level", F.explode(F.array(*[F.col("level") + d for d in (-1, 0, 1)]))).join(counts, key)
    sides = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").join(every, [*key, "block"])
    return cut(sides.select("outs", "every").mapInPandas(_block_links(threshold), "a long, b long"))


def _classes(docs: DataFrame, threshold: float, size: int, bands: int, rows: int, small: int, block: int, block_bytes: int) -> DataFrame:
    """(doc_id, digest, doc, class_id, copy_of, repeated) of rows with an id; doc is a number for each id and text."""
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    signed = cut(docs.mapInPandas(_bands(bands, rows, size), "doc long, digest string, bands array<long>").withColumnRenamed("doc", "doc_id"))
    several = signed.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = cut(several)
    further = several.where("first <> last")
    if further.isEmpty():
        signed = signed.withColumn("doc", F.col("doc_id"))
    else:
        numbers = cut(numbered_down(signed.join(further, "doc_id").where("digest <> first").select("doc_id", "digest").distinct(), "doc_id", "digest"))
        signed = cut(signed.join(numbers, ["doc_id", "digest"], "left").withColumn("doc", F.coalesce("number", "doc_id")).drop("number"))
    members = cut(signed.groupBy("digest").agg(F.min("doc").alias("node"), F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("rows"), F.min_by("bands", "doc").alias("bands")))
    banded = members.select("node", F.posexplode("bands").alias("band", "key")).distinct()
    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    banded = cut(banded.join(sizes, ["band", "key"]))
    texts = signed.select("doc_id", "digest", F.col("doc").alias("node")).join(banded.select("node").distinct(), "node").dropDuplicates(["node"])
    texts = docs.withColumnRenamed("doc", "doc_id").join(texts, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    cells = cut(texts.select("node", "text").mapInPandas(_cells(size), "node long, weight long, cells binary"))

    # Bands of few texts: their pairs, at most small * (small - 1) / 2 of each.
    few = banded.where(F.col("n") <= small)
    pairs = few.select("band", "key", F.col("node").alias("a")).join(few.select("band", "key", F.col("node").alias("b")), ["band", "key"]).where("a < b").select("a", "b")
    # A node has a row for each of its bands at most, so its window is short.
    many = cut(banded.where(F.col("n") > small).withColumn("known", F.sum("n").over(Window.partitionBy("node"))).drop("n"))
    star = _stars(many.withColumn("may", F.lit(True)))
    links = cut(_checked(pairs.unionByName(star).distinct(), cells, threshold).distinct())
    labels = components(links)
    mixed = cut(_mixed(many, labels))
    if not mixed.isEmpty():
        second = _checked(_stars(mixed.withColumn("may", F.col("label") != F.col("main"))), cells, threshold)
        links = cut(links.unionByName(second).distinct())
        labels = components(links)
        mixed = cut(_mixed(many, labels))
    if not mixed.isEmpty():
        labels = components(links.unionByName(_settled(mixed, cells, threshold, block, block_bytes)))
    classes = members.drop("bands").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("class_id"), "copy_of", "rows")
    found = join_heavy(signed.select("doc_id", "digest", "doc"), classes, "digest", "rows")
    if several.isEmpty():
        found = found.withColumn("repeated", F.lit(False))
    else:
        found = found.join(several.select("doc_id", F.lit(True).alias("repeated")), "doc_id", "left")
    return found.select("doc_id", "digest", "doc", "class_id", "copy_of", "repeated")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 20, rows: int = 5, small: int = 12, block: int = 256, block_bytes: int = 4_000_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (the smallest id of its class)
    and copy_of (the smallest id with the same text).

    A class is a component of links between texts of weighted Jaccard similarity ``threshold`` or
    more over counts of ``size``-word shingles. A link of exactly 0.8 is found by 20 bands of 5
    rows with probability 0.9996, higher ones more surely; nothing below the threshold is linked.
    Null texts are empty; empty ones are copies of each other. Rows without an id are left out. Rows of one id
    with different texts are documents of their own: the text of the smallest digest has the id, and the others count
    after all ids, as numbers from the largest long down (a class of such texts only has one as its class_id).
    Other columns are not looked at.
    """
    return _classes(docs, threshold, size, bands, rows, small, block, block_bytes).select("doc_id", "class_id", "copy_of")


def keep_one(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 20, rows: int = 5, small: int = 12, block: int = 256, block_bytes: int = 4_000_000) -> DataFrame:
    """The document of each class whose number is the class's (``near_duplicates``), in the columns of ``docs``; of
    repeated rows one. Rows without an id stay."""
    found = cut(_classes(docs.select("doc_id", "text"), threshold, size, bands, rows, small, block, block_bytes))
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").cast("long").alias("__id"), key.alias("__key"))
    dropped = found.where("doc <> class_id").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__key")).distinct()
    kept = keyed.join(dropped, ["__id", "__key"], "left_anti")
    twice = found.where("repeated AND doc = class_id").groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__key")).count().where("count > 1").drop("count")
    if not twice.isEmpty():
        once = kept.join(twice, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"])
        kept = kept.join(twice, ["__id", "__key"], "left_anti").unionByName(once)
    return kept.select("__row.*")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
