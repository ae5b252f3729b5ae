"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir, cut
from ..sources.readers import numbered_rows

__all__ = ["cut"]

LAST = 2**63 - 1

#: One word: a run of anything but space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the library's lineage cutting finds it."""
    return checkpoint_dir(spark)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def numbered_down(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds ``number`` to rows: from the largest long down in the order of ``columns``, so that they are after all
    ids and the same in every run."""
    ordered = numbered_rows(rows.withColumn("__by", F.struct(*columns)), "__by")
    return ordered.withColumn("number", F.lit(LAST) - F.col("seq")).drop("__by", "seq")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = one if on is None else on & one
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def join_heavy(rows: DataFrame, table: DataFrame, key: str, count: str, share: int = 200, least: int = 1000) -> DataFrame:
    """Inner equi-join of rows with a table of one row per key, whose column ``count`` says how many rows have it and
    is left out. Keys that more than one in ``share`` of the rows have, and more than ``least``, are fewer
    than ``share``: they are broadcast, so that no task gets all rows of one; the others are joined as Spark sees fit."""
    total = table.agg(F.sum(count)).first()[0] or 0
    heavy = cut(table.where(F.col(count) > max(total // share, least)).drop(count))
    light = table.drop(count)
    if heavy.isEmpty():
        return rows.join(light, key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.where(F.col(count) <= max(total // share, least)).drop(count), key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply and shift rounds) of uint64 values, by salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_BYTES = mix64(np.arange(256, dtype=np.uint64), 77) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            with np.errstate(over="ignore"):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Polynomial hashes of any substrings of one byte array, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end); equal strings have equal ones wherever they stand."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start], 5)


    def every(self, size: int) -> np.ndarray:
        """Hashes of all substrings of that size, by where they start: as ``of``, without index arrays."""
        n = max(len(self.sums) - size, 0)
        with np.errstate(over="ignore"):
            return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n], 5)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def join_texts(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with a newline after each, and where each begins; the last
    of the starts is the length of all. Null is empty."""
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), starts


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in joined texts, and for each text its first word's number
    (with the number of all words at the end)."""
    space = _SPACE[data]
    inside = ~space
    begin = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(inside & np.concatenate((space[1:], [True]))) + 1
    return begin, end, np.searchsorted(begin, starts)


def batches(frames: Iterator[pd.DataFrame], column: str, most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """The frames cut into runs of rows of about ``most`` characters at most (one row at least),
    so that an array made from them stays bounded whatever Arrow's batch holds."""
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).to_numpy(np.int64)
        total, first = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield frame.iloc[first:i]
                total, first = 0, i
            total += size
        if first < len(frame):
            yield frame.iloc[first:]


def small_batches(spark: SparkSession, rows: int = 512, size: int = 1 << 26) -> None:
    """Rows and bytes of text that Arrow sends to Python at once; its default of 10,000 rows is too many for
    long texts. Session settings, as Spark has no other place for them; smaller ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
