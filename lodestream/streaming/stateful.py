"""The same sketches over streams, their state in Spark's state store.

A Bloom filter and a reservoir are one state each, whatever the stream, so theirs is a single key
of bounded size (bits, slots). Elements are spread over keys first wherever that can be done:
distinct counts are per tick and combine before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import HashFamily, hashed, trailing_zeros, uniform_of


def stream_bloom(stream: DataFrame, family: HashFamily) -> DataFrame:
    """(tick, repeats, fresh): of each tick's elements (seq, tick, element) those the filter had seen, by
    what it said, and the others. The state is the filter's bits."""
    size = family.size

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bits = bytearray(state.get[0]) if state.exists else bytearray(-(-size // 8))
        rows = pd.concat(list(frames)).sort_values("seq")
        said: dict[int, list[int]] = {}
        for tick, own in zip(rows["tick"], rows["bits"], strict=True):
            seen = all(bits[b >> 3] >> (b & 7) & 1 for b in own)
            for b in own:
                bits[b >> 3] |= 1 << (b & 7)
            said.setdefault(tick, [0, 0])[0 if seen else 1] += 1
        state.update((bytes(bits),))
        yield pd.DataFrame([(t, *n) for t, n in sorted(said.items())], columns=["tick", "repeats", "fresh"])

    keyed = stream.select(F.lit(0).alias("key"), "seq", "tick", hashed(F.col("element"), family).alias("bits"))
    return keyed.groupBy("key").applyInPandasWithState(update, "tick long, repeats long, fresh long", "bits binary", "append", GroupStateTimeout.NoTimeout)


def stream_reservoir(stream: DataFrame, slots: int = 100) -> DataFrame:
    """(seqnum, sample): the sample after each batch that ends at a multiple of ``slots``. Draws are those
    of the relational form, so both hold the same. The state is the slots."""
    take = (F.col("seq") <= slots) | (uniform_of(F.col("seq"), 1_103_515_245, 12_345) * F.col("seq") < slots)
    slot = F.when(F.col("seq") <= slots, F.col("seq") - 1).otherwise(F.floor(uniform_of(F.col("seq"), 69_069, 1) * slots))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else [None] * slots
        rows = pd.concat(list(frames)).sort_values("seq")
        for place, element in zip(rows["slot"], rows["element"], strict=True):
            if not pd.isna(place):
                held[int(place)] = element
        state.update((held,))
        end = int(rows["seq"].iloc[-1])
        yield pd.DataFrame({"seqnum": [end], "sample": [held]} if end % slots == 0 else {"seqnum": [], "sample": []})

    keyed = stream.select(F.lit(0).alias("key"), "seq", "element", F.when(take, slot).cast("double").alias("slot"))
    return keyed.groupBy("key").applyInPandasWithState(update, "seqnum long, sample array<string>", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def stream_distinct(stream: DataFrame, family: HashFamily, groups: int = 3) -> DataFrame:
    """(tick, estimate) of distinct elements by Flajolet-Martin, as a streaming aggregate (update or
    complete mode); with an event time and watermark on ``stream``, tick can be a window."""
    parts = len(family.params) // groups
    tails = stream.select("tick", F.transform(hashed(F.col("element"), family), trailing_zeros).alias("tails"))
    by_tick = tails.groupBy("tick").agg(*[F.max(F.col("tails")[i]).alias(f"m{i}") for i in range(parts * groups)])
    means = [sum((F.pow(F.lit(2.0), F.col(f"m{i}")) for i in range(g * parts, (g + 1) * parts)), F.lit(0.0)) / parts for g in range(groups)]
    return by_tick.select("tick", F.floor(F.element_at(F.array_sort(F.array(*means)), groups // 2 + 1)).alias("estimate"))
