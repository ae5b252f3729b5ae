"""Stream sketches as relations over numbered elements (seq, element).

A tick is ``size`` elements in a row. What a sequential filter keeps in memory is expressed by
firsts: when an element, or a bit, was first there. So a whole stream is one set of aggregates,
parallel over elements, with the results a one-by-one pass would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashing import HashFamily, hashed, trailing_zeros, uniform_of


def ticked(elements: DataFrame, size: int) -> DataFrame:
    """Elements with their tick, from 0; seq counts from 1."""
    return elements.withColumn("tick", F.floor((F.col("seq") - 1) / size))


def running_share(by_tick: DataFrame, part: str, whole: str, block: int = 4096) -> DataFrame:
    """(tick, share): the sum of ``part`` by that of ``whole`` over all ticks up to each. Blocks of ticks are summed
    by themselves and then shifted by those before, a table of one row per block."""
    placed = by_tick.withColumn("block", F.floor(F.col("tick") / block))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = placed.groupBy("block").agg(F.sum(part).alias("p"), F.sum(whole).alias("w"))
    base = base.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("p", "w")])
    upto = W.partitionBy("block").orderBy("tick").rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumns({"own_p": F.sum(part).over(upto), "own_w": F.sum(whole).over(upto)}).join(base, "block")
    return summed.select("tick", ((F.col("own_p") + F.col("p")) / F.nullif(F.col("own_w") + F.col("w"), F.lit(0))).alias("share"))


def bloom_first_seen(elements: DataFrame, family: HashFamily) -> DataFrame:
    """(element, first, false_positive): when each distinct element came first, and whether a Bloom
    filter fed with all before it said it had come already, which is when each of its bits had been
    set by an earlier one."""
    firsts = elements.groupBy("element").agg(F.min("seq").alias("first"))
    bits = firsts.select("element", "first", F.explode(F.array_distinct(hashed(F.col("element"), family))).alias("bit"))
    set_at = bits.groupBy("bit").agg(F.min("first").alias("set_at"))
    seen = bits.join(set_at, "bit").groupBy("element", "first").agg(F.bool_and(F.col("set_at") < F.col("first")).alias("false_positive"))
    return seen


def bloom_rates(elements: DataFrame, size: int, family: HashFamily) -> DataFrame:
    """(tick, fpr): after each tick, the share of first occurrences so far that the filter took for
    repeats."""
    first = ticked(bloom_first_seen(elements, family).withColumnRenamed("first", "seq"), size)
    by_tick = first.groupBy("tick").agg(F.count_if("false_positive").alias("fp"), F.count(F.lit(1)).alias("n"))
    ticks = ticked(elements, size).select("tick").distinct().join(by_tick, "tick", "left").fillna(0, ["fp", "n"])
    return running_share(ticks, "fp", "n").withColumnRenamed("share", "fpr")


def flajolet_martin(elements: DataFrame, size: int, family: HashFamily, groups: int = 3) -> DataFrame:
    """(tick, truth, estimate): distinct elements of each tick, and the median over groups of hash
    functions of the mean of 2^(most zeros at a hash's end). Functions are unrolled into one
    aggregate; functions beyond ``groups`` equal parts don't count."""
    parts = len(family.params) // groups
    rows = ticked(elements, size).select("tick", "element").distinct()
    # Each distinct element is hashed once, however many ticks it is in.
    known = rows.select("element").distinct().withColumn("tails", F.transform(hashed(F.col("element"), family), trailing_zeros))
    tails = rows.join(known, "element").select("tick", "tails")
    most = [F.max(F.col("tails")[i]).alias(f"m{i}") for i in range(parts * groups)]
    by_tick = tails.groupBy("tick").agg(F.count(F.lit(1)).alias("truth"), *most)
    means = [sum((F.pow(F.lit(2.0), F.col(f"m{i}")) for i in range(g * parts, (g + 1) * parts)), F.lit(0.0)) / parts for g in range(groups)]
    middle = F.element_at(F.array_sort(F.array(*means)), groups // 2 + 1)
    return by_tick.select("tick", "truth", F.floor(middle).alias("estimate"))


def flajolet_martin_by_element(elements: DataFrame, size: int, family: HashFamily, groups: int = 3) -> DataFrame:
    """(tick, truth, estimate) in the variant that takes each element's longest tail over all functions,
    in the order of the tick, and averages slices of elements as if they were groups of functions:
    each slice one short, divided by its full length."""
    part = len(family.params) // groups
    rows = ticked(elements, size).withColumn("place", (F.col("seq") - 1) % size)
    longest = F.array_max(F.transform(hashed(F.col("element"), family), trailing_zeros))
    own = rows.join(rows.select("element").distinct().withColumn("power", F.pow(F.lit(2.0), longest)), "element")
    sums = [F.coalesce(F.sum(F.when(F.col("place").between(g * part, (g + 1) * part - 2), F.col("power"))), F.lit(0.0)) / part for g in range(groups)]
    by_tick = own.groupBy("tick").agg(F.count_distinct("element").alias("truth"), F.element_at(F.array_sort(F.array(*sums)), groups // 2 + 1).alias("middle"))
    return by_tick.select("tick", "truth", F.floor("middle").alias("estimate"))


def accuracy(estimates: DataFrame) -> DataFrame:
    """One row: the sum of true counts by that of estimates."""
    return estimates.agg((F.sum("truth") / F.nullif(F.sum("estimate"), F.lit(0))).alias("ratio"))


def reservoir_placed(elements: DataFrame, slots: int = 100) -> DataFrame:
    """(seq, element, slot) of the elements that enter the reservoir: the first ``slots`` in order, each
    later one with probability slots / seq at a slot drawn for it. Draws are fixed by seq."""
    enters = (F.col("seq") <= slots) | (uniform_of(F.col("seq"), 1_103_515_245, 12_345) * F.col("seq") < slots)
    slot = F.when(F.col("seq") <= slots, F.col("seq") - 1).otherwise(F.floor(uniform_of(F.col("seq"), 69_069, 1) * slots))
    return elements.where(enters).select("seq", "element", slot.cast("long").alias("slot"))


def reservoir(elements: DataFrame, slots: int = 100) -> DataFrame:
    """(slot, element, seq): the sample after the whole stream; a slot holds the last one put there."""
    return reservoir_placed(elements, slots).groupBy("slot").agg(F.max_by("element", "seq").alias("element"), F.max("seq").alias("seq"))


def reservoir_snapshots(elements: DataFrame, size: int, slots: int = 100, shown: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """(seqnum, s0, s20, ...): what some slots hold after each tick whose end is a multiple of ``slots``.
    Only entries of those slots are looked at, about a logarithm of the stream's length each."""
    ends = ticked(elements, size).groupBy("tick").agg(F.max("seq").alias("seqnum")).where(F.col("seqnum") % slots == 0).select("seqnum")
    placed = reservoir_placed(elements, slots).where(F.col("slot").isin(*shown))
    # A slot is entered about ln(n / slots) times in a stream of n: a broadcast that stays small.
    per_end = ends.join(F.broadcast(placed), F.col("seq") <= F.col("seqnum")).groupBy("seqnum", "slot").agg(F.max_by("element", "seq").alias("element"))
    held = [F.max(F.when(F.col("slot") == s, F.col("element"))).alias(f"s{s}") for s in shown]
    return per_end.groupBy("seqnum").agg(*held)
