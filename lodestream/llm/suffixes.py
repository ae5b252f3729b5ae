"""Removal of repeated byte strings by a sampled suffix array, merged across the cluster.

Every ``length``-byte window of a text has one anchor, the leftmost ``gram``-byte string in it
with the smallest hash, so equal windows have equal anchors at equal places; consecutive windows
share theirs. Only suffixes at anchors are exchanged, about one in 17 bytes, and of those only
the ones whose anchor string is in more than one document. Each shard of documents sends its
sorted run of such suffixes (each with what stands before its anchor, backwards) front-coded. A reducer
merges its runs with a loser tree that keeps, for each run, the length of the prefix it has in
common with the last suffix out, and so never compares those bytes again. Two windows are equal if
their anchors are at the same place in them, their suffixes have so many bytes in common from the anchor on, and so many
backwards: both are read off the common prefixes of neighbours in sorted order. Each
shard gets back the smallest document of each of its suffixes' windows.

Shards are dealt by text, and go to them as compressed pieces in which equal texts are one, with all their ids: the one with
the smallest id stands for them, as the others start no string that it does not and are repeated whole. What the first
step shuffles is gone before the second begins.

A string that very many documents have in the same surroundings is one suffix per shard. An anchor string
that is in very many different surroundings is frequent: its windows are exchanged one by one, dealt out by all
of their bytes, so no reducer gets all that is around a frequent line. Shards and buckets grow with the
root of the input, so that what a shard sends to a bucket stays as large (``sizes``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, Rolling, batches, cut, join_texts, mix64, read, small_batches

ROW = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def window_minima(h: np.ndarray, span: int) -> np.ndarray:
    """Smallest of each ``span`` values in a row, by doubling."""
    out, have = h, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


@dataclass
class Anchors:
    """Texts ``first`` and after of a shard, and their anchors: position, first and last window."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    rolling: Rolling
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.searchsorted(self.starts, self.at, side="right") - 1

    def one_by_one(self, chosen: np.ndarray) -> Anchors:
        """With the chosen anchors' runs of windows taken apart: an anchor for each window of theirs."""
        n = np.where(chosen, self.high - self.low + 1, 1)
        of = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        low = self.low[of] + nth
        return Anchors(self.first, self.data, self.starts, self.rolling, self.at[of], low, np.where(chosen[of], low, self.high[of]))

    def grams(self, gram: int) -> np.ndarray:
        """Keys of the anchor strings; hashed again, as their hashes are the small ones."""
        return mix64(self.rolling.of(self.at, self.at + gram), 41)

    def contexts(self, length: int) -> np.ndarray:
        """Hash of all bytes of an anchor's windows, and of where the anchor is among them."""
        return mix64(self.rolling.of(self.low, self.high + length) + (self.at - self.low).astype(np.uint64), 21)


def anchors_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int, first: int = 0) -> Anchors:
    """Anchors of joined texts; texts shorter than a window have none."""
    rolling = Rolling(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Anchors(first, data, starts, rolling, none, none, none)
    span = length - gram + 1
    h = rolling.every(gram)
    least = window_minima(h, span)
    inside = np.zeros(len(data) + 1, np.int32)  # windows that lie within one text
    sizes = np.diff(starts) - 1
    long = sizes >= length
    inside[starts[:-1][long]] += 1
    inside[starts[:-1][long] + sizes[long] - length + 1] -= 1
    valid = np.cumsum(inside)[: len(least)] > 0
    fresh = valid.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    low = np.flatnonzero(fresh)
    last = valid.copy()
    last[:-1] &= fresh[1:] | ~valid[1:]
    high = np.flatnonzero(last)

    halves = []
    while 1 << len(halves) < span:
        halves.append(h if not halves else np.minimum(halves[-1][: -(1 << len(halves) - 1)], halves[-1][1 << len(halves) - 1 :]))

    def leftmost(p: np.ndarray) -> np.ndarray:
        """Where each window's minimum is first: past every half that doesn't hold it, largest first."""
        v, out = least[p], p.copy()
        for j in range(len(halves) - 1, -1, -1):
            own = halves[j]
            out += (own[np.minimum(out, len(own) - 1)] > v).astype(np.int64) << j
        return out

    anchor = leftmost(low)
    # Where equal strings follow each other, a run of windows outlives its anchor: window by window.
    stale = np.flatnonzero(anchor < high)
    if len(stale):
        n = high[stale] - anchor[stale]
        p = np.repeat(anchor[stale] + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = leftmost(p)
        opens = np.ones(len(p), bool)
        opens[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
        closes = np.append(opens[1:], True)
        high = high.copy()
        high[stale] = anchor[stale]
        anchor, low, high = np.concatenate((anchor, a[opens])), np.concatenate((low, p[opens])), np.concatenate((high, p[closes]))
    return Anchors(first, data, starts, rolling, anchor, low, high)


def shard_anchors(texts: list[str | bytes | None], length: int, gram: int, most: int = 1_000_000) -> Iterator[Anchors]:
    """Anchors of a shard, a few MB of text at a time."""
    first, total = 0, 0
    for i, t in enumerate([*texts, None]):
        size = len(t or "")
        if i == len(texts) or (total and total + size > most):
            if i > first:
                yield anchors_of(*join_texts(texts[first:i]), length, gram, first)
            first, total = i, 0
        total += size


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, the first bytes of all their items together, then the second ones
    and so on: those of sorted or small numbers are alike."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.compress(b"".join(planes), 1)


def _array(raw: bytes, dtype: type | np.dtype | str, n: int, offset: int = 0) -> np.ndarray:
    """The array of n items that begins at ``offset`` of decompressed bytes."""
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(raw, np.uint8, n * size, offset).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def sizes(total: int, shard_bytes: int, bucket_bytes: int, most: int = 16) -> tuple[int, int]:
    """(shards, buckets) for so many bytes: of the given sizes up to a GB, beyond that of sizes that grow with the
    root of the input, up to ``most`` times as large. Then what a shard sends to a bucket is about as large
    whatever the input, and there are as many of these pieces as the input is larger."""
    growth = min(max(1.0, (total / 1e9) ** 0.5), most)
    return max(1, -(-total // int(shard_bytes * growth))), max(1, -(-total // int(bucket_bytes * growth)))


def tasks_for(spark: SparkSession, shards: int, each: int = 4, most: int = 100_000) -> int:
    """Tasks that go through so many shards, one after another: about ``each`` a task, but as many as keep all cores
    busy, and no more than a driver can plan for."""
    return max(1, min(shards, max(4 * spark.sparkContext.defaultParallelism, -(-shards // each)), most))


PIECE = "shard int, n int, ids int, blob binary"


def packed_pieces(most: int = 1 << 25):
    """Rows (doc, text, shard) -> for each shard its different texts with their ids, compressed, for about ``most`` characters at
    a time."""

    def pieces(held: dict[int, dict[str, list[int]]]) -> pd.DataFrame:
        out = []
        for shard, own in held.items():
            raw = [t.encode("utf-8", "surrogatepass") for t in own]
            ids = np.concatenate([np.array(i, np.int64) for i in own.values()])
            sizes, counts = np.array([len(r) for r in raw], np.int64), np.array([len(i) for i in own.values()], np.int64)
            out.append((shard, len(raw), len(ids), zstandard.compress(b"".join([sizes.tobytes(), counts.tobytes(), ids.tobytes(), *raw]), 3)))
        return pd.DataFrame(out, columns=["shard", "n", "ids", "blob"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for frame in batches(frames, "text"):
            for doc, text, shard in zip(frame["doc"].tolist(), frame["text"].tolist(), frame["shard"].tolist(), strict=True):
                ids = held.setdefault(shard, {}).setdefault(text, [])
                size += 8 if ids else len(text) + 100
                ids.append(doc)
            if size > most:
                yield pieces(held)
                held, size = {}, 0
        yield pieces(held)

    return run


def unpacked(frame: pd.DataFrame) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """(different texts, the smallest id of each, all ids of each) of the pieces of a shard, or of its rows (doc, text, shard)."""
    if "text" in frame:
        return unpacked(pd.concat(packed_pieces()(iter([frame]))))
    ids_of: dict[bytes, list[np.ndarray]] = {}
    for x in frame.itertuples(index=False):
        raw = zstandard.decompress(x.blob)
        sizes, counts, ids = (np.frombuffer(raw, np.int64, n, at) for n, at in ((x.n, 0), (x.n, 8 * x.n), (x.ids, 16 * x.n)))
        ends, last = np.cumsum(sizes) + 16 * x.n + 8 * x.ids, np.cumsum(counts)
        for end, size, upto, count in zip(ends.tolist(), sizes.tolist(), last.tolist(), counts.tolist(), strict=True):
            ids_of.setdefault(raw[end - size : end], []).append(ids[upto - count : upto])
    every = [np.concatenate(i) if len(i) > 1 else i[0] for i in ids_of.values()]
    return list(ids_of), np.array([i.min() for i in every], np.int64), every


def _keys_and_marks(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and their marks, of (n, blob)."""
    raws = [(zstandard.decompress(b), n) for b, n in zip(frame["blob"], frame["n"], strict=True)]
    if not raws:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, marks = np.concatenate([_array(r, np.uint64, n) for r, n in raws]), np.concatenate([_array(r, bool, n, 8 * n) for r, n in raws])
    order = np.argsort(keys)
    return keys[order], marks[order]


def _sort_groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if len(bucket):
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
        for lo, hi in zip(edges, np.append(edges[1:], len(order)), strict=True):
            yield int(bucket[order[lo]]), order[lo:hi]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def seen_grams(length: int, gram: int, buckets: int):
    """Shard -> its distinct anchor strings by bucket, in how many surroundings each is (up to 127), with 128
    added where it is in two of its documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts, docs, _ = unpacked(frame)
        parts = [(x.grams(gram), docs[x.first + x.owner], x.contexts(length)) for x in shard_anchors(texts, length, gram)]
        if not parts or not sum(len(p[0]) for p in parts):
            return pd.DataFrame([], columns=["bucket", "shard", "n", "blob"])
        keys, own, context = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((own, keys))
        keys, own, context = keys[order], own[order], context[order]
        opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(opens, len(keys)))
        seen = np.where(own[opens] != own[opens + size - 1], 128, 0)
        # Surroundings are told apart only where there are several.
        group = np.repeat(np.arange(len(opens)), size)
        some = np.flatnonzero((size > 1)[group])
        around = np.ones(len(opens), np.int64)
        if len(some):
            by = some[np.lexsort((context[some], group[some]))]
            fresh = np.append(True, (group[by][1:] != group[by][:-1]) | (context[by][1:] != context[by][:-1]))
            around = np.maximum(around, np.bincount(group[by], weights=fresh, minlength=len(opens)).astype(np.int64))
        marks = (seen + np.minimum(around, 127)).astype(np.uint8)
        keys = keys[opens]
        out = [(b, int(frame["shard"].iloc[0]), len(at), _squeeze(keys[at], marks[at])) for b, at in _sort_groups(_bucket(keys, buckets))]
        return pd.DataFrame(out, columns=["bucket", "shard", "n", "blob"])

    return run


def shared_grams(frequent: int):
    """Bucket -> for each shard those of its strings that more than one document has, with a mark where they are
    in more than ``frequent`` surroundings."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, marks, shard = [], [], []
        for x in frame.itertuples(index=False):
            raw = zstandard.decompress(x.blob)
            keys.append(_array(raw, np.uint64, x.n))
            marks.append(_array(raw, np.uint8, x.n, 8 * x.n))
            shard.append(np.full(x.n, x.shard, np.int32))
        keys, marks, shard = np.concatenate(keys), np.concatenate(marks), np.concatenate(shard)
        order = np.argsort(keys, kind="stable")
        keys, marks, shard = keys[order], marks[order], shard[order]
        opens = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        size = np.diff(np.append(opens, len(keys)))
        around = np.add.reduceat((marks & 127).astype(np.int64), opens)
        kept = np.repeat(size > 1, size) | (marks >= 128)
        hot = np.repeat(around > frequent, size)
        keys, hot, shard = keys[kept], hot[kept], shard[kept]
        out = [(s, len(at), _squeeze(keys[at], hot[at])) for s, at in _sort_groups(shard.astype(np.int64))]
        return pd.DataFrame(out, columns=["shard", "n", "blob"])

    return run


def front_coded(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix with the row before, remaining bytes of all) of sorted rows of ``sizes`` bytes."""
    lcp = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        lcp[1:] = np.minimum(lcp[1:], np.minimum(sizes[1:], sizes[:-1]))
    columns = np.arange(rows.shape[1])
    return lcp, rows[(columns >= lcp[:, None]) & (columns < sizes[:, None])]


def decoded(lcp: np.ndarray, sizes: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """The rows that were front-coded, padded with zeros."""
    columns = np.arange(width)
    rows = np.zeros((len(lcp), width), np.uint8)
    rows[(columns >= lcp[:, None]) & (columns < sizes[:, None])] = rest
    line = np.arange(len(lcp))
    for j in range(int(lcp.max(initial=0))):
        rows[:, j] = rows[np.maximum.accumulate(np.where(lcp <= j, line, 0)), j]
    rows[columns >= sizes[:, None]] = 0
    return rows


def sorted_runs(length: int, gram: int, buckets: int):
    """Shard and its shared strings -> its suffixes at them as one sorted run for each bucket (kind 1), and its
    frequent strings, which it gets back with the rest (kind 0).

    A suffix is the bytes from the anchor to the end of its windows, then those before the
    anchor, backwards; of equal ones the smallest and largest document are kept."""
    width = 2 * length - gram

    def run(frame: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "shard", "n", "kind", "blob"]
        if not len(frame) or not len(shared):
            return pd.DataFrame([], columns=columns)
        wanted, frequent = _keys_and_marks(shared)
        (texts, docs, _), shard = unpacked(frame), int(frame["shard"].iloc[0])
        parts = []
        for x in shard_anchors(texts, length, gram):
            keys = x.grams(gram)
            place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            hit = np.flatnonzero(wanted[place] == keys)
            hot, keys = frequent[place[hit]], keys[hit]
            x = Anchors(x.first, x.data, x.starts, x.rolling, x.at[hit], x.low[hit], x.high[hit])
            if hot.any():
                n = np.where(hot, x.high - x.low + 1, 1)
                x, hot, keys = x.one_by_one(hot), np.repeat(hot, n), np.repeat(keys, n)
            at, low, high, own = x.at, x.low, x.high, docs[x.first + x.owner]
            context = x.contexts(length)
            keys = np.where(hot, mix64(context, 43), keys)
            order = np.lexsort((own, context))
            opens = np.flatnonzero(np.append(True, context[order][1:] != context[order][:-1])) if len(order) else np.zeros(0, np.int64)
            if not len(opens):
                continue
            least, most = own[order][opens], own[order][np.append(opens[1:], len(order)) - 1]
            one = order[opens]
            right, left = high[one] + length - at[one], at[one] - low[one]
            rows = np.zeros((len(one), width), np.uint8)
            for j in range(width):  # by column: no index array as large as the matrix
                source = np.where(j < right, at[one] + j, at[one] - 1 - (j - right))
                rows[:, j] = np.where(j < right + left, x.data[np.clip(source, 0, len(x.data) - 1)], 0)
            parts.append((keys[one], rows, right.astype(np.uint8), left.astype(np.uint8), least, most, context[one]))
        if not parts:
            return pd.DataFrame([], columns=columns)
        keys, rows, right, left, least, most, context = (np.concatenate(p) for p in zip(*parts, strict=True))
        out = []
        for b, at in _sort_groups(_bucket(keys, buckets)):
            own = rows[at]
            padded = np.zeros((len(own), -(-width // 8) * 8), np.uint8)
            padded[:, :width] = own
            words = padded.view(">u8")
            at = at[np.lexsort((left[at], right[at], *words.T[::-1]))]
            # The same suffix from several parts of the shard is one.
            opens = np.append(True, (rows[at][1:] != rows[at][:-1]).any(1) | (right[at][1:] != right[at][:-1]) | (left[at][1:] != left[at][:-1]))
            opens = np.flatnonzero(opens)
            lo, hi = np.minimum.reduceat(least[at], opens), np.maximum.reduceat(most[at], opens)
            at = at[opens]
            sizes = right[at].astype(np.int64) + left[at]
            lcp, rest = front_coded(rows[at], sizes)
            out.append((b, shard, len(at), 1, _squeeze(lo, hi, right[at], left[at], lcp, rest)))
        if frequent.any():
            out.append((shard % buckets, shard, int(frequent.sum()), 0, _squeeze(wanted[frequent])))
        return pd.DataFrame(out, columns=columns)

    return run


def merge(runs: list[list[int]], lcps: list[list[int]], width: int) -> Iterator[tuple[int, int, int]]:
    """(run, place, common prefix with the one before) of sorted runs in merged order.

    Strings are numbers of ``width`` bytes, ``lcps`` the common prefix of each with the one before
    it in its run. A loser tree: each inner node keeps the loser of its match. Contenders carry
    the length of their common prefix with the last string out: the longer one wins; only if
    both are as long are the bytes after it compared.
    """
    k = 1
    while k < len(runs):
        k *= 2
    bits = width * 8
    place = [0] * k
    value = [runs[i][0] if i < len(runs) and runs[i] else -1 for i in range(k)]  # -1: exhausted
    known = [0 if v >= 0 else -1 for v in value]
    tree = [-1] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one with the winner."""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        u, v = value[a], value[b]
        differ = u ^ v
        common = (bits - differ.bit_length()) >> 3
        if u <= v:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    def play(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = match(play(2 * node), play(2 * node + 1))
        return winner

    best = play(1) if k > 1 else 0
    while known[best] >= 0:
        yield best, place[best], known[best]
        at = place[best] = place[best] + 1
        own = runs[best]
        if at < len(own):
            value[best], known[best] = own[at], lcps[best][at]
        else:
            value[best], known[best] = -1, -1
        node = (best + k) // 2
        while node:
            x, y = known[best], known[tree[node]]
            if x < y:
                best, tree[node] = tree[node], best
            elif x == y:
                best, tree[node] = match(best, tree[node])
            node //= 2


def _ints(rows: np.ndarray) -> list[int]:
    raw, width = rows.tobytes(), rows.shape[1]
    return [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]


def smallest_of_equal(common: np.ndarray, rows: np.ndarray, right: np.ndarray, left: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first window of each suffix, the smallest ``least`` of each window's equals) of distinct suffixes in sorted order, each
    with the length of the prefix it has in common with the one before.

    Windows with their anchor at place o agree from the anchor on where no common prefix between
    their suffixes is shorter than length - o, and before it where, in the order of what is backwards from the anchor,
    none is shorter than o. Both are numbers of runs, so no bytes and no hashes of windows are compared."""
    n = len(rows)
    windows = right + left - length + 1
    starts = np.concatenate(([0], np.cumsum(windows)))
    out = np.zeros(starts[-1], np.int64)
    back = np.zeros((n, -(-int(left.max(initial=0)) // 8) * 8 or 8), np.uint8)
    line = np.arange(n)
    for j in range(int(left.max(initial=0))):
        back[:, j] = np.where(j < left, rows[line, np.minimum(right + j, rows.shape[1] - 1)], 0)
    order = np.lexsort((left, *back.view(">u8").T[::-1]))
    sorted_back = back[order]
    differ = sorted_back[1:] != sorted_back[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), back.shape[1])
    for o in range(int(left.max(initial=0)) + 1):
        own = np.flatnonzero((left >= o) & (right >= length - o))
        if not len(own):
            continue
        ahead = np.cumsum(common < length - o)
        behind = np.empty(n, np.int64)
        behind[order] = np.concatenate(([0], np.cumsum(shared < o)))
        key = ahead[own] * np.int64(n + 1) + behind[own]
        by = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        found = np.repeat(np.minimum.reduceat(least[own][by], edges), np.diff(np.append(edges, len(by))))
        out[starts[own[by]] + left[own[by]] - o] = found
    return starts, out


def merged_windows(length: int, gram: int):
    """Bucket -> for each shard, the smallest document of each window of its suffixes (kind 1); its frequent
    strings as they are (kind 0)."""
    width = 2 * length - gram

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        runs, columns = [], ["shard", "n", "runs", "kind", "blob"]
        out = [(x.shard, x.n, 0, 0, x.blob) for x in frame[frame["kind"] == 0].itertuples(index=False)]
        frame = frame[frame["kind"] == 1]
        if not len(frame):
            return pd.DataFrame(out, columns=columns)
        for x in frame.sort_values("shard").itertuples(index=False):
            raw, n = zstandard.decompress(x.blob), x.n
            lo, hi = _array(raw, np.int64, n), _array(raw, np.int64, n, 8 * n)
            right, left, lcp = (_array(raw, np.uint8, n, 16 * n + i * n) for i in range(3))
            sizes = right.astype(np.int64) + left
            rows = decoded(lcp, sizes, np.frombuffer(raw, np.uint8, -1, 19 * n), width)
            runs.append((x.shard, lo, hi, right, left, rows))
        # Rows with their two lengths behind, so that equal bytes of other lengths stay apart.
        full = [np.concatenate((r[5], r[3][:, None], r[4][:, None]), 1) for r in runs]
        lcps = []
        for f in full:
            differ = f[1:] != f[:-1]
            lcps.append([0, *np.where(differ.any(1), differ.argmax(1), width + 2).tolist()])
        order = np.array(list(merge([_ints(f) for f in full], lcps, width + 2)), np.int64).reshape(-1, 3)
        base = np.concatenate(([0], np.cumsum([len(f) for f in full])))
        at = base[order[:, 0]] + order[:, 1]
        common = order[:, 2]
        shard = np.repeat(np.array([r[0] for r in runs]), [len(f) for f in full])[at]
        lo, hi = np.concatenate([r[1] for r in runs])[at], np.concatenate([r[2] for r in runs])[at]
        rows = np.concatenate(full)[at]
        opens = np.flatnonzero(np.append(True, common[1:] < width + 2))  # distinct suffixes
        which = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(at))))
        least = np.minimum.reduceat(lo, opens)
        one = rows[opens]
        right, left = one[:, width].astype(np.int64), one[:, width + 1].astype(np.int64)
        # Between distinct suffixes the common prefix is the least since the one before.
        starts, smallest = smallest_of_equal(common[opens], one[:, :width], right, left, least, length)
        windows = np.diff(starts)
        nth = np.arange(starts[-1]) - np.repeat(starts[:-1], windows)
        # The bytes of each suffix's windows in order, one after another, to name it by.
        size, line, straight = right + left, np.arange(len(one)), np.zeros((len(one), width), np.uint8)
        for j in range(width):
            straight[:, j] = one[line, np.clip(np.where(j < left, size - 1 - j, j - left), 0, width - 1)]
        rolling, ends = Rolling(straight[np.arange(width) < size[:, None]]), np.concatenate(([0], np.cumsum(size)))
        context = mix64(rolling.of(ends[:-1], ends[1:]) + left.astype(np.uint64), 21)
        # Runs of windows with the same smallest document.
        opens_run = np.append(True, (smallest[1:] != smallest[:-1]) | (nth[1:] == 0))
        first_run = np.flatnonzero(opens_run)
        run_size, run_doc = np.diff(np.append(first_run, len(smallest))), smallest[first_run]
        run_at = np.searchsorted(first_run, starts)
        lowest = np.minimum.reduceat(smallest, starts[:-1])
        useful = lowest[which] < hi
        for s, pick in _sort_groups(np.where(useful, shard, -1).astype(np.int64)):
            if s < 0:
                continue
            ids = np.unique(which[pick])
            counts = run_at[ids + 1] - run_at[ids]
            runs_of = np.repeat(run_at[ids], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            blob = _squeeze(context[ids], counts.astype(np.uint8), run_size[runs_of].astype(np.uint8), run_doc[runs_of])
            out.append((s, len(ids), len(runs_of), 1, blob))
        return pd.DataFrame(out, columns=columns)

    return run


def removed_spans(length: int, gram: int, with_spans: bool):
    """Shard and what it got back -> its documents without the bytes that are repeated."""

    def run(frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        contexts, counts, sizes, least = ([np.zeros(0, d)] for d in (np.uint64, np.uint8, np.uint8, np.int64))
        frequent = [_array(zstandard.decompress(x.blob), np.uint64, x.n) for x in found[found["kind"] == 0].itertuples(index=False)]
        frequent = np.sort(np.concatenate(frequent)) if frequent else np.zeros(0, np.uint64)
        for x in found[found["kind"] == 1].itertuples(index=False):
            raw, n, r = zstandard.decompress(x.blob), x.n, x.runs
            contexts.append(_array(raw, np.uint64, n))
            counts.append(_array(raw, np.uint8, n, 8 * n))
            sizes.append(_array(raw, np.uint8, r, 9 * n))
            least.append(_array(raw, np.int64, r, 9 * n + r))
        contexts, counts, sizes, least = (np.concatenate(v) for v in (contexts, counts, sizes, least))
        first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        order = np.argsort(contexts, kind="stable")
        ordered = contexts[order]
        texts, docs, every = unpacked(frame)
        out, nothing = [], hashlib.sha256().hexdigest()
        for x in shard_anchors(texts, length, gram):
            mark = np.zeros(len(x.data) + 1, np.int32)
            if len(frequent) and len(x.at):
                keys = x.grams(gram)
                x = x.one_by_one(frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys)
            if len(ordered) and len(x.at):
                context = x.contexts(length)
                place = np.minimum(np.searchsorted(ordered, context), len(ordered) - 1)
                hit = np.flatnonzero(ordered[place] == context)
                entry = order[place[hit]]
                n = counts[entry].astype(np.int64)
                runs = np.repeat(first[entry], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                occurrence = np.repeat(hit, n)
                size = sizes[runs].astype(np.int64)
                before = np.cumsum(size) - size
                begin = x.low[occurrence] + before - np.repeat(before[np.cumsum(n) - n], n) if len(n) else np.zeros(0, np.int64)
                gone = least[runs] < docs[x.first + x.owner[occurrence]]
                np.add.at(mark, begin[gone], 1)
                np.add.at(mark, begin[gone] + size[gone] - 1 + length, -1)
            covered = np.cumsum(mark)[:-1] > 0
            for i in range(len(x.starts) - 1):
                lo, hi = x.starts[i], x.starts[i + 1] - 1
                own, bytes_ = covered[lo:hi], x.data[lo:hi]
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if own.any() else np.zeros(0, np.int64)
                row = (hi - lo, int(own.sum()), len(edges) // 2, hashlib.sha256(bytes_[~own].tobytes()).hexdigest())
                row = (*row, edges.tolist()) if with_spans else row
                # A later document with the same text is repeated whole, unless it is shorter than a string.
                again = ((hi - lo, hi - lo, 1, nothing, [0, hi - lo]) if with_spans else (hi - lo, hi - lo, 1, nothing)) if hi - lo >= length else row
                out += [(doc, *(row if doc == docs[x.first + i] else again)) for doc in every[x.first + i].tolist()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans"] if with_spans else [])]
        frame = pd.DataFrame(out, columns=names)
        frame["doc_id"] = frame["doc_id"].astype("Int64").mask(frame["doc_id"] == LAST)
        return frame

    return run


def repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 20, shard_bytes: int = 3_000_000, bucket_bytes: int = 6_000_000, with_spans: bool = False, frequent: int = 8192) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) without each byte that is covered by a string of
    ``length`` bytes which also starts in a document with a smaller id: n_bytes, n_removed,
    n_spans (maximal removed runs), kept_sha256; with ``with_spans`` also ``spans``, start and end
    of each run in turn. Matches don't cross documents; all are judged on the input.

    Null texts are empty. Rows without an id come after all others. Rows with the same id never
    remove from each other. Other columns are not looked at. Windows are equal by their bytes; a suffix is named
    by 64 bits within its shard, so of 10**5 there two are taken for one with a chance of 10**-9 or so. ``docs`` is read
    more than once and must be the same each time.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = sizes(total, shard_bytes, bucket_bytes)
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    tasks = tasks_for(docs.sparkSession, shards)

    def deal() -> DataFrame:
        return rows.mapInPandas(packed_pieces(), PIECE).repartition(tasks, "shard")

    blobs = "bucket int, shard int, n int, {}blob binary"
    seen = deal().groupBy("shard").applyInPandas(seen_grams(length, gram, buckets), blobs.format(""))
    shared = cut(seen.groupBy("bucket").applyInPandas(shared_grams(frequent), "shard int, n int, blob binary"))
    dealt = deal()  # packed again, which costs less disk than to keep the pieces beside what the first step shuffles
    runs = dealt.groupBy("shard").cogroup(shared.groupBy("shard")).applyInPandas(sorted_runs(length, gram, buckets), blobs.format("kind int, "))
    windows = runs.groupBy("bucket").applyInPandas(merged_windows(length, gram), "shard int, n int, runs int, kind int, blob binary")
    schema = ROW + (", spans array<long>" if with_spans else "")
    return dealt.groupBy("shard").cogroup(windows.groupBy("shard")).applyInPandas(removed_spans(length, gram, with_spans), schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read(spark, sf_dir, "documents", "doc_id", "text"))
