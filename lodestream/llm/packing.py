"""Packing tokenised documents into training windows.

Documents are cut into whole windows, one piece that is a multiple of a unit and one below it.
The histogram of piece lengths (no more bins than the window is long) goes to the driver, where
shallow combinations of unit lengths that fill a window exactly are enumerated and their repeat
counts solved by non-negative least squares, rounded down; what they leave is packed greedily,
largest first, by counts. The plan is a table of rank ranges by length, as small as the
histogram; each piece finds its place in it by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, read, small_batches

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"
_UNBROKEN = re.compile(r"\S{4096}|\s{4096}")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where
    it prints, else the next code point from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids (uint32) for a byte-level BPE file of the tokenizers library.

    Ids equal those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
    The merges of the file's own vocabulary run in the rank-based encoder, which takes a quarter
    of the time; texts with very long unbroken runs, on which its pattern matcher is slow, go
    to the library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols = byte_symbols()
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if _UNBROKEN.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)

    return encode


def cuts(n: int, window: int, unit: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens: whole windows, a multiple of the unit, the rest."""
    tail = n % window
    return [x for x in [*[window] * (n // window), tail // unit * unit, tail % unit] if x]


def _tokenise(path: str, end: int, window: int, unit: int):
    def tokenise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for frame in frames:
            out: list[tuple] = []
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end)).astype("<u4")
                start = 0
                for n in cuts(len(ids), window, unit):
                    out.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
                    start += n
            rows = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield rows.astype({"doc_id": object})

    return tokenise


def pieces(docs: DataFrame, path: str, end: int = 1, window: int = 2048, unit: int = 64) -> DataFrame:
    """One row per piece of each document of (doc_id, text): start, length, CRC-32 of its ids as
    little-endian 32-bit, tokens of the whole document with its end id. Null and empty texts are
    the end id alone. Rows with the same id are documents of their own."""
    small_batches(docs.sparkSession)
    # Ids as text: pandas would make whole numbers with nulls among them floating ones.
    cut_up = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(_tokenise(path, end, window, unit), PIECES)
    return cut_up.withColumn("doc_id", F.col("doc_id").cast("long"))


def combinations(units: int, depth: int, largest: int | None = None) -> Iterator[tuple[int, ...]]:
    """Multisets of at most ``depth`` lengths below ``units`` that add up to ``units``, falling."""

    def fill(left: int, most: int, more: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif more:
            for x in range(min(left, most), 0, -1):
                if x * more >= left:
                    for rest in fill(left - x, x, more - 1):
                        yield (x, *rest)

    yield from fill(units, units - 1 if largest is None else largest, depth)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares by the active-set method: x >= 0 that minimises |a x - b|."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        j = int(np.argmax(gradient)) if n else 0
        if not n or gradient[j] <= 1e-9 * max(1.0, np.abs(b).max(initial=0)):
            break
        free[j] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if trial[free].min(initial=0) >= -1e-12:
                x = np.maximum(trial, 0)
                break
            falling = free & (trial < 0)
            step = np.min(x[falling] / np.maximum(x[falling] - trial[falling], 1e-300))
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def plan(histogram: dict[int, int], window: int, unit: int, depth: int = 4) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, rank after the last, first
    sequence, pieces of this length in each sequence, offset of the first of them).

    The combinations are laid out first, then the greedy patterns; each is used as often as the
    pieces that are left allow."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def lay(pattern: list[tuple[int, int]], times: int) -> None:
        nonlocal sequences
        offset = 0
        for n, m in pattern:
            out.append((n, used[n], used[n] + m * times, sequences, m, offset))
            used[n] += m * times
            left[n] -= m * times
            offset += n * m
        sequences += times

    if left.get(window):
        lay([(window, 1)], left[window])
    units = window // unit
    shapes = [c for c in combinations(units, depth) if all(left.get(x * unit) for x in c)]
    if shapes:
        a = np.zeros((units, len(shapes)))
        for j, shape in enumerate(shapes):
            for x in shape:
                a[x, j] += 1
        repeats = nnls(a, np.array([left.get(x * unit, 0) for x in range(units)], float))
        for j in np.argsort(-repeats, kind="stable"):
            pattern = [(x * unit, shapes[j].count(x)) for x in sorted(set(shapes[j]), reverse=True)]
            times = min(int(repeats[j] + 1e-6), *(left[n] // m for n, m in pattern))
            if times > 0:
                lay(pattern, times)
    while any(left.values()):
        room, pattern = window, []
        for n in sorted((n for n, c in left.items() if c), reverse=True):
            if m := min(left[n], room // n):
                pattern.append((n, m))
                room -= n * m
        lay(pattern, min(left[n] // m for n, m in pattern))
    return out


def pack(rows: DataFrame, window: int = 2048, unit: int = 64, depth: int = 4, rows_per_bucket: int = 65_536, least_buckets: int = 64) -> DataFrame:
    """Adds sequence_id and offset (from 0 without gaps) to pieces of at most ``window`` tokens,
    whatever else their rows hold (doc_id, start and length are needed). No piece is dropped."""
    spark = rows.sparkSession
    rows = cut(rows)
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `window` rows
    table = spark.createDataFrame(plan(histogram, window, unit, depth), "__length long, __low long, __high long, __first long, __m long, __at long")
    buckets = max(least_buckets, -(-sum(histogram.values()) // rows_per_bucket))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    order = W.partitionBy("length", "__bucket").orderBy("doc_id", "start", *[c for c in ("ids_crc32", "doc_tokens") if c in rows.columns])
    rows = rows.withColumn("__rank", F.row_number().over(order) - 1).join(counts, ["length", "__bucket"])
    rows = rows.withColumn("__rank", F.col("__rank") + F.col("__base")).drop("__base", "__bucket")
    # The plan has no more rows than patterns of at most `window` lengths: a bounded broadcast.
    placed = rows.join(F.broadcast(table), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")))
    nth = F.col("__rank") - F.col("__low")
    return placed.withColumns({"sequence_id": F.col("__first") + F.floor(nth / F.col("__m")), "offset": F.col("__at") + nth % F.col("__m") * F.col("length")}).drop("__rank", "__length", "__low", "__high", "__first", "__m", "__at")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return pack(pieces(docs, default_tokenizer())).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
