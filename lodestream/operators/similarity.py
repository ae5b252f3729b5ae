"""Set similarity joins: exact, and by min-hash bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructField, StructType

from ..functions.lineage import cut

RESULT = ("id_1", "id_2", "similarity")
#: Joins that make more rows than this for each of their input are looked at again, with equal sets as one.
HEAVY = 24
#: Sets of a block; elements of a matrix at a time; elements that sets in blocks may have in all; products of
#: matrices that cost as much as a row of a join.
BLOCK, SLICE, MOST_ELEMENTS, PRODUCTS = 2_048, 4_096, 65_536, 1_000
#: Rows of a product that are looked at and pairs that are handed on at a time; tasks that pairs of blocks go to at most.
ROWS, MOST_HITS, TASKS = 256, 100_000, 10_000


def members(rows: DataFrame, owner: str, element: str) -> DataFrame:
    """(id, element): each set's distinct elements; nulls are none."""
    named = rows.select(F.col(owner).alias("id"), F.col(element).alias("element"))
    return named.where("id IS NOT NULL AND element IS NOT NULL").distinct()


def jaccard_pairs(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(id_1, id_2, similarity) of the given pairs whose sets (id, element) are that similar. A pair is one
    row with both sets as arrays, so nothing is multiplied by the sets' sizes."""
    whole = sets.groupBy("id").agg(F.collect_list("element").alias("items"))
    one = pairs.join(whole.select(F.col("id").alias("id_1"), F.col("items").alias("a")), "id_1")
    two = one.join(whole.select(F.col("id").alias("id_2"), F.col("items").alias("b")), "id_2")
    both = two.select("id_1", "id_2", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("n"))
    out = both.withColumn("similarity", F.col("both") / (F.col("n") - F.col("both")))
    return out.where(F.col("similarity") >= least).select(*RESULT)


def _counted_join(sets: DataFrame, least: float) -> DataFrame:
    """By counting how often two sets meet, over all elements."""
    sized = sets.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("id")))
    left = sized.select(F.col("id").alias("id_1"), "element", F.col("n").alias("n_1"))
    met = left.join(sized.select(F.col("id").alias("id_2"), "element", F.col("n").alias("n_2")), "element").where("id_1 < id_2")
    both = met.groupBy("id_1", "id_2").agg(F.count(F.lit(1)).alias("both"), F.first("n_1").alias("n_1"), F.first("n_2").alias("n_2"))
    out = both.withColumn("similarity", F.col("both") / (F.col("n_1") + F.col("n_2") - F.col("both")))
    return out.where(F.col("similarity") >= least).select(*RESULT)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id_1", "id_2").alias("id_1"), F.greatest("id_1", "id_2").alias("id_2"), "similarity")


def folded(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes (id, items), members (class, id)): equal sets as one, under the smallest of their ids."""
    whole = cut(sets.groupBy("id").agg(F.array_sort(F.collect_list("element")).alias("items")))
    classes = cut(whole.groupBy("items").agg(F.min("id").alias("class")))
    members = cut(whole.join(classes, "items").select("class", "id"))
    return classes.select(F.col("class").alias("id"), "items"), members


def unfolded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of all members of pairs of classes, and of members of one class."""
    one, two = (members.select(F.col("class").alias(c), F.col("id").alias(m)) for c, m in (("id_1", "a"), ("id_2", "b")))
    apart = pairs.join(one, "id_1").join(two, "id_2").select(F.col("a").alias("id_1"), F.col("b").alias("id_2"), "similarity")
    same = members.select("class", F.col("id").alias("id_1")).join(members.select("class", F.col("id").alias("id_2")), "class").where("id_1 < id_2")
    return _ordered(apart).unionByName(same.select("id_1", "id_2", F.lit(1.0).alias("similarity")))


def _bits(elements: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of sets as rows of bits."""
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                own = frame.iloc[at : at + BLOCK]
                n = own["numbers"].str.len().to_numpy(np.int64)
                rows = np.zeros((len(own), elements), bool)
                rows[np.repeat(np.arange(len(own)), n), np.concatenate(own["numbers"].tolist())] = True
                yield pd.DataFrame({"ids": [own["id"].tolist()], "bits": [np.packbits(rows, axis=1).tobytes()], "low": [int(n.min())], "high": [int(n.max())]})

    return run


def _meet(elements: int, least: float):
    def matrix(ids: np.ndarray, bits: bytes) -> np.ndarray:
        return np.frombuffer(bits, np.uint8).reshape(len(ids), -1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The similar pairs of two blocks: what their sets have in common is a product of matrices of 0 and 1."""
        for frame in frames:
            for x in frame.itertuples(index=False):
                one, two = matrix(x.ids_1, x.bits_1), matrix(x.ids_2, x.bits_2)
                both = np.zeros((len(one), len(two)), np.float32)
                for at in range(0, elements, SLICE):
                    a, b = (np.unpackbits(m[:, at // 8 : (at + SLICE) // 8], axis=1).astype(np.float32) for m in (one, two))
                    both += a @ b.T
                n_1, n_2 = (np.bitwise_count(m).sum(1, dtype=np.int64) for m in (one, two))
                # Roughly by rows first, as few pairs pass; then exactly, as each pair's sizes have it.
                share = np.float32(max(0.0, least / (1 + least) - 1e-5))
                rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for at in range(0, len(both), ROWS):
                    part = both[at : at + ROWS]
                    i, j = np.nonzero((part >= share * (n_1[at : at + ROWS, None] + n_2).astype(np.float32)) & (part > 0))
                    rows.append(i + at)
                    columns.append(j)
                i, j = np.concatenate(rows), np.concatenate(columns)
                if x.block_1 == x.block_2:
                    i, j = i[i < j], j[i < j]
                shared = both[i, j].astype(np.int64)
                similarity = shared / (n_1[i] + n_2[j] - shared)
                i, j, similarity = (v[similarity >= least] for v in (i, j, similarity))
                ids_1, ids_2 = (np.array([*ids, None], object)[:-1] for ids in (x.ids_1, x.ids_2))
                for at in range(0, len(i), MOST_HITS):
                    k = slice(at, at + MOST_HITS)
                    yield pd.DataFrame({"id_1": ids_1[i[k]].tolist(), "id_2": ids_2[j[k]].tolist(), "similarity": similarity[k]})

    return run


def _blocked_join(classes: DataFrame, numbers: DataFrame, count: int, elements: int, least: float) -> DataFrame:
    """Of sets (id, items) with few different elements: blocks of sets of like size meet as matrices of bits,
    but those whose sizes rule out a pair."""
    kind = classes.schema["id"].dataType
    numbered_ = classes.select("id", F.explode("items").alias("element")).join(numbers, "element").groupBy("id").agg(F.collect_list("number").alias("numbers"))
    ranged = numbered_.withColumn("n", F.size("numbers")).repartitionByRange(max(1, -(-count // BLOCK)), "n", "id").sortWithinPartitions("n", "id")
    schema = f"ids array<{kind.simpleString()}>, bits binary, low int, high int"
    blocks = cut(ranged.select("id", "numbers").mapInPandas(_bits(elements), schema).withColumn("block", F.monotonically_increasing_id()))
    one, two = (blocks.select(*[F.col(c).alias(f"{c}_{i}") for c in ("block", "low", "high")]) for i in (1, 2))
    fit = (F.col("high_1") + 1e-9 >= F.col("low_2") * F.lit(least)) & (F.col("high_2") + 1e-9 >= F.col("low_1") * F.lit(least))
    pairs = cut(one.crossJoin(two).where(F.col("block_1") <= F.col("block_2")).where(fit).select("block_1", "block_2"))
    met = pairs.count()
    for i in (1, 2):
        pairs = pairs.join(blocks.select(*[F.col(c).alias(f"{c}_{i}") for c in ("block", "ids", "bits")]), f"block_{i}")
    found = StructType([StructField("id_1", kind), StructField("id_2", kind), StructField("similarity", blocks.select(F.lit(1.0)).schema[0].dataType)])
    # So many tasks that pairs, which are small as bytes and large as work, don't come to lie together.
    dealt = pairs.select("block_1", "ids_1", "bits_1", "block_2", "ids_2", "bits_2").repartition(max(1, min(met, TASKS)), "block_1", "block_2")
    return _ordered(dealt.mapInPandas(_meet(elements, least), found))


def _classes_join(classes: DataFrame, least: float) -> DataFrame:
    """``jaccard_join`` of different sets (id, items): as blocks where their elements are few, so that products cost
    less than rows."""
    sets = classes.select("id", F.explode("items").alias("element"))
    df = sets.groupBy("element").agg(F.count(F.lit(1)).cast("double").alias("df"))
    elements, meets = df.agg(F.count(F.lit(1)), F.sum(F.col("df") * (F.col("df") - 1) / 2)).first()
    count = classes.count()
    if elements <= MOST_ELEMENTS and count * count / 2 * elements <= PRODUCTS * (meets or 0.0):
        return _blocked_join(classes, cut(numbered(sets, "element")), count, elements, least)
    return _listed_or_counted(sets, least)[0]


def jaccard_join(sets: DataFrame, least: float) -> DataFrame:
    """(id_1, id_2, similarity) of all pairs of sets (id, element) with Jaccard similarity ``least`` or
    more; exact, by the cheapest of three plans.

    Where the two plans that join rows would make very many of each, equal sets are taken as one, to be expanded at
    the end, and different sets with few elements in all meet as matrices of bits, in blocks.
    """
    sets = cut(sets)  # asked several times, and reading them can cost more than joining them
    plan, rows = _listed_or_counted(sets, least)
    if rows <= HEAVY * sets.count():
        return plan
    classes, members = folded(sets)
    return unfolded(_classes_join(classes, least), members)


def _listed_or_counted(sets: DataFrame, least: float) -> tuple[DataFrame, float]:
    """``jaccard_join`` by the cheaper of two plans, and the rows that its join makes.

    With frequent elements, a set is indexed by its rarest elements only: two sets that similar share
    one of each one's first n - ceil(least * n) + 1 elements in order of rarity, so frequent ones are
    never joined on; candidates whose sizes alone rule them out go, the others are compared. Where
    elements are rare and the threshold low, pairs simply are counted as they meet. The plan is
    chosen by the pairs that either makes, which the elements' frequencies tell beforehand.
    """
    df = sets.groupBy("element").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = W.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "element")
    sized = sets.join(df, "element", "left").withColumn("place", F.row_number().over(own)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("id")))
    prefix = cut(sized.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).where("df IS NOT NULL").select("id", "element", "n"))
    meets = lambda of: F.sum(of.cast("double") * (of - 1) / 2)
    counted = df.agg(meets(F.col("df"))).first()[0] or 0.0
    first = prefix.groupBy("element").agg(F.count(F.lit(1)).alias("df"), F.avg("n").alias("n")).agg(meets(F.col("df")), F.avg("n")).first()
    listed = (first[0] or 0.0) * (1 + (first[1] or 0.0))
    if counted <= listed:
        return _counted_join(sets, least), counted
    other = prefix.select(F.col("id").alias("id_2"), "element", F.col("n").alias("n_2"))
    met = prefix.select(F.col("id").alias("id_1"), "element", F.col("n").alias("n_1")).join(other, "element").where("id_1 < id_2")
    fit = (F.least("n_1", "n_2") + 1e-9) >= F.greatest("n_1", "n_2") * F.lit(least)
    return jaccard_pairs(sets, met.where(fit).select("id_1", "id_2").distinct(), least), listed


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """(column, number): distinct values numbered from 0 in their order, gapless. Sorted ranges are
    numbered by themselves and shifted by the sizes of those before."""
    distinct = rows.select(column).where(F.col(column).isNotNull()).distinct()
    # Written, as both branches below must see the same ranges.
    placed = cut(distinct.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("first"))
    before = W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("part").orderBy(column)) - 1
    return placed.withColumn("nth", nth).join(sizes.select("part", "base"), "part").select(column, (F.col("nth") + F.col("base")).alias("number"))


def minhash_params(count: int, seed: int = 1, prime: int = 24_593) -> list[tuple[int, int, int]]:
    """(a, b, p) of so many functions ((a x + b) mod p) mod n."""
    from ..functions.hashing import hash_family

    return [(a % 100_000 + 1, b % 100_000 + 1, prime) for a, b, _ in hash_family(count, seed=seed).params]


def minhash(sets: DataFrame, universe: int, count: int = 30, seed: int = 1) -> DataFrame:
    """(id, nth, value): the smallest value of each set's element numbers (id, number) under each
    function. Functions are unrolled into one aggregate, so a set's rows are combined before they
    are shuffled and never multiplied."""
    params = minhash_params(count, seed)
    least = [F.min((F.lit(a) * F.col("number") + F.lit(b)) % F.lit(p) % F.lit(universe)) for a, b, p in params]
    signed = sets.groupBy("id").agg(F.array(*least).alias("signature"))
    return signed.select("id", F.posexplode("signature").alias("nth", "value"))


def _bands(signatures: DataFrame, rows: int, every: int) -> DataFrame:
    """(id, band, key): ``rows`` values in a row from each place that ``every`` divides."""
    bands = signatures.withColumn("band", F.floor(F.col("nth") / every)).where(F.col("nth") % every < rows)
    keyed = bands.groupBy("id", "band").agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("key"))
    return keyed.withColumn("key", F.transform("key", lambda x: x["value"]))


def _met(keyed: DataFrame) -> DataFrame:
    left, right = keyed.withColumnRenamed("id", "id_1"), keyed.withColumnRenamed("id", "id_2")
    return left.join(right, ["band", "key"]).where("id_1 < id_2").select("id_1", "id_2").distinct()


def band_candidates(signatures: DataFrame, rows: int = 1, every: int = 2) -> DataFrame:
    """(id_1, id_2) of sets that agree in a band: ``rows`` values in a row from each place that
    ``every`` divides. The default, one value at every second place, is 15 bands of 30 values."""
    return _met(_bands(signatures, rows, every))


def lsh_join(sets: DataFrame, least: float = 0.5, count: int = 30, rows: int = 1, every: int = 2, seed: int = 1) -> DataFrame:
    """(id_1, id_2, similarity) of candidate pairs with exact similarity ``least`` or more; a subset of
    ``jaccard_join`` that misses a pair of similarity s with probability (1 - s^rows)^bands.

    Where bands make very many candidates of each set, equal sets are taken as one, which agree in all bands, and
    the similar pairs are got first and then asked for a band in common: the same pairs."""
    sets = cut(sets)
    numbers = cut(numbered(sets, "element"))
    universe = max(1, numbers.count())
    keyed = cut(_bands(minhash(sets.join(numbers, "element").select("id", "number"), universe, count, seed), rows, every))
    met = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    if (met or 0.0) <= HEAVY * keyed.count():
        return jaccard_pairs(sets, _met(keyed), least)
    classes, members = folded(sets)
    found = _classes_join(classes, least)
    whole = cut(keyed.join(classes.select("id"), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("band", "key"))).alias("bands")))
    for i in (1, 2):
        found = found.join(whole.select(F.col("id").alias(f"id_{i}"), F.col("bands").alias(f"bands_{i}")), f"id_{i}")
    agree = F.exists(F.zip_with("bands_1", "bands_2", lambda x, y: x == y), lambda x: x)
    return unfolded(found.where(agree).select(*RESULT), members)
