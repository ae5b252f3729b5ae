"""Frequent itemsets.

Counting is by level. A row of level k is an itemset of k items that occurs in a basket, with the
tail of that basket's items after its last one; the next level appends each item of the tail. So a
basket is dealt out once and no self-join pairs its items: each level is one explode, one
count that combines before it shuffles, and one semi-join with the sets that stay. Only baskets of
frequent items and frequent sets are ever written; levels are grown again from those, as growing
them costs less than keeping them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

RESULT = "length int, itemset array<string>, support long"


def _first_level(baskets: DataFrame) -> DataFrame:
    grown = baskets.select(F.posexplode("items").alias("at", "item"), "items")
    return grown.select(F.array("item").alias("itemset"), F.slice("items", F.col("at") + 2, F.size("items")).alias("tail"))


def _next_level(level: DataFrame) -> DataFrame:
    grown = level.select("itemset", "tail", F.posexplode("tail").alias("at", "item"))
    return grown.select(F.concat("itemset", F.array("item")).alias("itemset"), F.slice("tail", F.col("at") + 2, F.size("tail")).alias("tail"))


def _counts(level: DataFrame, support: float) -> DataFrame:
    counted = level.groupBy("itemset").agg(F.count(F.lit(1)).alias("support"))
    return counted.where(F.col("support") >= support).select(F.size("itemset").alias("length"), "itemset", "support")


def frequent_itemsets(baskets: DataFrame, support: float, longest: int | None = None) -> DataFrame:
    """(length, itemset, support) of every itemset in at least ``support`` baskets of (basket, items),
    items sorted and distinct; exact. Infrequent items leave the baskets before pairs are made."""
    singles = cut(_counts(_first_level(baskets), support))
    found, k = singles, 1
    keep = singles.select(F.element_at("itemset", 1).alias("item"))
    rows = baskets.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("items").alias("item"))
    level = _first_level(cut(rows.join(keep, "item").groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))))
    while longest is None or k < longest:
        k += 1
        level = _next_level(level)
        frequent = cut(_counts(level, support))
        if frequent.isEmpty():
            break
        found = found.unionByName(frequent)
        level = level.join(frequent.select("itemset"), "itemset", "left_semi")
    return found


def local_itemsets(baskets: list[list[str]], support: float) -> Iterator[tuple[str, ...]]:
    """Itemsets in at least ``support`` of some baskets, by levels."""
    sets = [frozenset(b) for b in baskets]
    counts: dict[tuple[str, ...], int] = {}
    for b in sets:
        for x in b:
            counts[(x,)] = counts.get((x,), 0) + 1
    level = sorted(s for s, n in counts.items() if n >= support)
    while level:
        yield from level
        known, counts = set(level), {}
        heads: dict[tuple[str, ...], list[str]] = {}
        for s in level:
            heads.setdefault(s[:-1], []).append(s[-1])
        wanted = {(*h, a, b) for h, tails in heads.items() for a, b in combinations(sorted(tails), 2)}
        wanted = {s for s in wanted if all(c in known for c in combinations(s, len(s) - 1))}
        if not wanted:
            return
        singles = {x for s in wanted for x in s}
        size = len(level[0]) + 1
        for b in sets:
            for s in combinations(sorted(b & singles), size):
                if s in wanted:
                    counts[s] = counts.get(s, 0) + 1
        level = sorted(s for s, n in counts.items() if n >= support)


def son_candidates(baskets: DataFrame, share: float, chunk: int = 20_000, least: int = 8) -> DataFrame:
    """(itemset): those in at least ``share`` of the baskets of some chunk. Whatever is in that share
    of all baskets is among them, however they are dealt.

    A task takes its baskets in chunks of ``chunk`` rows, or as many as it takes for the share to be ``least``
    baskets: of less nearly every subset would be a candidate. For the same reason baskets are dealt anew
    into so few tasks that the share of each is that many, where there are as many."""
    chunk = max(chunk, int(-(-least // share)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[str]] = []
        for frame in frames:
            held += [list(items) for items in frame["items"] if items is not None]
            # A last chunk stays as large as a whole one, or is the only one.
            while len(held) >= 2 * chunk:
                yield _itemset_frame(local_itemsets(held[:chunk], share * chunk))
                held = held[chunk:]
        yield _itemset_frame(local_itemsets(held, share * len(held)))

    parts = max(1, int(baskets.count() * share / (2 * least)))
    dealt = baskets.select("items")
    # By the whole basket and a draw, as equal baskets would otherwise be in one task.
    dealt = dealt.repartition(min(parts, int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4), F.xxhash64("items", F.rand(1)))
    return dealt.mapInPandas(run, "itemset array<string>").distinct()


def _itemset_frame(itemsets: Iterator[tuple[str, ...]]) -> pd.DataFrame:
    return pd.DataFrame({"itemset": pd.Series([list(s) for s in itemsets], dtype=object)})


def son_itemsets(baskets: DataFrame, share: float) -> DataFrame:
    """(length, itemset, support) in at least ``share`` of all baskets, in two passes: candidates by
    partition, then their exact counts."""
    baskets = cut(baskets)
    candidates = cut(son_candidates(baskets, share))
    support = share * baskets.count()
    longest = candidates.agg(F.max(F.size("itemset"))).first()[0] or 0
    level, found = _first_level(baskets), None
    for k in range(1, longest + 1):
        level = (level if k == 1 else _next_level(level)).join(candidates.where(F.size("itemset") == k), "itemset", "left_semi")
        counted = _counts(level, support)
        found = counted if found is None else found.unionByName(counted)
    return found if found is not None else baskets.sparkSession.createDataFrame([], RESULT)
