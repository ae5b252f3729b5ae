"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not: a token of a toxic training document is labelled toxic if
one of its features (its word, or how it begins) is tied to toxic training documents beyond what
chance would give among all features tried. A two-state chain is fitted to those tokens by the
gradient of its log-likelihood. Forward-backward marginals of every token of every document
then add up to a document's evidence, calibrated to a score, and give the offending offsets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Rolling, batches, cut, join_texts, mix64, read, small_batches

PREFIXES = (4, 5, 6, 8)
CHAIN = 256

_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _WORD[_lo:_hi] = True
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x2E, 0x21, 0x3F]] = True


@dataclass
class Model:
    """Feature hashes (sorted) with weights, bias, transition scores, calibration."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0
    fitted: bool = False


def lowered(text: str | None) -> str:
    """Lower case where that keeps the number of code points, so that offsets hold."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else (text or "")


@dataclass
class Tokens:
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each text, and the number of all at the end
    chain: np.ndarray  # first token of each chain
    length: np.ndarray  # of each chain


def tokens_of(texts: list[str | None]) -> Tokens:
    """Runs of letters, digits and bytes beyond ASCII. A chain ends with its text, with a line or
    sentence, or after 256 tokens."""
    data, starts = join_texts([lowered(t) for t in texts])
    word = _WORD[data]
    begin = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    end = np.flatnonzero(word & np.concatenate((~word[1:], [True]))) + 1
    ends = np.cumsum(_ENDS[data])[begin] if len(begin) else np.zeros(0, np.int64)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = ends[1:] != ends[:-1]
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(begin)))
    parts = -(-size // CHAIN)
    at = np.repeat(head, parts) + CHAIN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return Tokens(data, begin, end, np.searchsorted(begin, starts), at, np.diff(np.append(at, len(begin))))


def features_of(t: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token, feature hash) by kind: the word, then each prefix shorter than it, in bytes."""
    rolling = Rolling(t.data)
    yield np.arange(len(t.begin)), rolling.of(t.begin, t.end)
    for p in PREFIXES:
        own = np.flatnonzero(t.end - t.begin > p)
        yield own, mix64(rolling.of(t.begin[own], t.begin[own] + p), 100 + p)


def forward_backward(e: np.ndarray, chain: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of state 1 from the left (each token's own score included) and from the right
    (without it); their sum is a token's marginal log-odds. All chains advance together."""
    order = np.argsort(-length, kind="stable")
    at, size = chain[order], length[order]
    left, right = np.array(e), np.zeros(len(e))
    falling = -size
    for t in range(1, int(size[0]) if len(size) else 0):
        i = at[: np.searchsorted(falling, -t, side="left")] + t
        x = left[i - 1]
        left[i] = e[i] + np.logaddexp(moves[0, 1], moves[1, 1] + x) - np.logaddexp(moves[0, 0], moves[1, 0] + x)
    for t in range((int(size[0]) if len(size) else 0) - 2, -1, -1):
        i = at[: np.searchsorted(falling, -(t + 1), side="left")] + t
        q = e[i + 1] + right[i + 1]
        right[i] = np.logaddexp(moves[1, 0], moves[1, 1] + q) - np.logaddexp(moves[0, 0], moves[0, 1] + q)
    return left, right


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def significant(texts: list[str], toxic: np.ndarray, margin: float = 3.0, least: float = 0.5) -> np.ndarray:
    """Hashes of features that stand in toxic texts more often than chance allows: the
    log-likelihood of their share of toxic places against that of all places exceeds the log of the
    number of features by ``margin``, and the share is ``least`` or more. Places with the same
    words on both sides count once, so that copies of one text don't make its words significant."""
    names, n1, n = [], [], []
    places = np.zeros(2)
    for kind in range(1 + len(PREFIXES)):
        hashes, keys, flags = [], [], []
        for first, t in _blocks(texts):
            owner = np.repeat(np.arange(first, first + len(t.first) - 1), np.diff(t.first))
            word = next(iter(features_of(t)))[1]
            around = np.zeros(len(word), np.uint64)
            with np.errstate(over="ignore"):
                around[1:] += word[:-1]
                around[:-1] += word[1:] * np.uint64(3)
            own, h = next(x for i, x in enumerate(features_of(t)) if i == kind)
            hashes.append(h)
            keys.append(mix64(h ^ mix64(around[own] + (toxic[owner[own]] > 0).astype(np.uint64), 12), 13))
            flags.append(toxic[owner[own]] > 0)
        _, one = np.unique(np.concatenate(keys), return_index=True)
        h, flag = np.concatenate(hashes)[one], np.concatenate(flags)[one]
        own, inverse = np.unique(h, return_inverse=True)
        names.append(own)
        n1.append(np.bincount(inverse, weights=flag, minlength=len(own)))
        n.append(np.bincount(inverse, minlength=len(own)).astype(float))
        if kind == 0:
            places += (flag.sum(), len(flag))
    names, n1, n = np.concatenate(names), np.concatenate(n1), np.concatenate(n)
    base, share = places[0] / max(places[1], 1), n1 / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n * (np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0))
    return np.unique(names[(share > base) & (share >= least) & (gain > np.log(max(len(names), 2)) + margin)])


def _blocks(texts: list[str], rows: int = 300) -> Iterator[tuple[int, Tokens]]:
    for i in range(0, len(texts), rows):
        yield i, tokens_of(texts[i : i + rows])


def _matches(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(token, place in model.features) of all features that the model has."""
    few = np.zeros(1 << 16, bool)
    few[(model.features >> np.uint64(48)).astype(np.int64)] = True
    out = []
    for own, h in features_of(t):
        hit = np.flatnonzero(few[(h >> np.uint64(48)).astype(np.int64)])
        place = np.searchsorted(model.features, h[hit])
        place = np.minimum(place, max(len(model.features) - 1, 0))
        same = model.features[place] == h[hit] if len(model.features) else np.zeros(len(hit), bool)
        out.append((own[hit[same]], place[same]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def evidence(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum of squared marginals of state 1, and every token's marginal."""
    token, place = _matches(model, t)
    e = model.bias + np.bincount(token, weights=model.weights[place], minlength=len(t.begin))
    left, right = forward_backward(e, t.chain, t.length, model.moves)
    p = _sigmoid(left + right)
    total = np.concatenate(([0.0], np.cumsum(p * p)))
    return total[t.first[1:]] - total[t.first[:-1]], p


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 60, rate: float = 0.3, ridge: float = 1e-3, quiet_chains: int = 20_000) -> Model:
    """Fit features, chain and calibration to texts with 0/1 labels. With one class only there is
    nothing to tell apart and the model scores every text 0."""
    toxic = np.asarray(toxic, float)
    if not 0 < toxic.sum() < len(toxic):
        return Model()
    model = Model(features=significant(texts, toxic), fitted=True)
    model.weights = np.ones(len(model.features))
    gathered, tokens, heads = [], 0, []
    for first, t in _blocks(texts):
        token, place = _matches(model, t)
        owner = np.repeat(np.arange(first, first + len(t.first) - 1), np.diff(t.first))
        gathered.append((token + tokens, place, toxic[owner] > 0))
        heads.append((t.chain + tokens, t.length))
        tokens += len(t.begin)
    token, place, guilty = (np.concatenate(x) for x in zip(*gathered, strict=True))
    chain, length = (np.concatenate(x) for x in zip(*heads, strict=True))
    marked = np.zeros(tokens, bool)
    marked[token] = True
    y = marked & guilty
    # Chains with a feature, and a fixed number of those without.
    number = np.repeat(np.arange(len(chain)), length)
    busy = np.zeros(len(chain), bool)
    busy[number[marked]] = True
    quiet = np.flatnonzero(~busy)
    busy[quiet[np.argsort(mix64(quiet.astype(np.uint64), 8))[:quiet_chains]]] = True
    kept = busy[number]
    renumber = np.cumsum(kept) - 1
    chain, length = renumber[chain[busy]], length[busy]
    on = kept[token]
    token, place, y = renumber[token[on]], place[on], y[kept].astype(float)
    follows = np.ones(len(y), bool)
    follows[chain] = False
    nxt = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[nxt - 1].astype(int), y[nxt].astype(int)), 1)
    params = np.concatenate((model.weights, [model.bias, 0, 0, 0]))
    speed = np.full(len(params), 1e-8)
    for _ in range(rounds):
        w, bias, moves = params[:-4], params[-4], np.array([[0, params[-3]], [params[-2], params[-1]]])
        e = bias + np.bincount(token, weights=w[place], minlength=len(y))
        left, right = forward_backward(e, chain, length, moves)
        miss = y - _sigmoid(left + right)
        r, q = left[nxt - 1], e[nxt] + right[nxt]
        scores = np.stack((np.zeros(len(nxt)), moves[0, 1] + q, moves[1, 0] + r, moves[1, 1] + r + q))
        pair = np.exp(scores - np.logaddexp.reduce(scores, axis=0))
        gradient = np.concatenate((np.bincount(place, weights=miss[token], minlength=len(w)), [miss.sum()], (seen.reshape(-1) - pair.sum(1))[1:]))
        gradient = gradient - ridge * len(chain) * np.concatenate((w, np.zeros(4))) * 0.01
        speed += gradient**2
        params = params + rate * gradient / np.sqrt(speed)
    model.weights, model.bias, model.moves = params[:-4], float(params[-4]), np.array([[0, params[-3]], [params[-2], params[-1]]])
    total = np.concatenate([evidence(model, t)[0] for _, t in _blocks(texts)])
    x, a, b = np.log(total + 1e-3), 1.0, 0.0
    for _ in range(400):  # logistic regression on one number
        miss = toxic - _sigmoid(a * x + b)
        a, b = a + 2 * ((miss * x).mean() - 1e-4 * a), b + 2 * miss.mean()
    model.slope, model.shift = float(a), float(b)
    return model


def score_texts(model: Model, texts: list[str | None], tagged: float = 0.5) -> tuple[np.ndarray, list[str]]:
    """(scores, spans): a span start:end (code points) for each run of tokens of one chain whose
    marginals are ``tagged`` or more, comma-joined."""
    if not model.fitted:
        return np.zeros(len(texts)), [""] * len(texts)
    t = tokens_of(texts)
    total, p = evidence(model, t)
    scores = _sigmoid(model.slope * np.log(total + 1e-3) + model.shift)
    spans = [""] * len(texts)
    hit = np.flatnonzero(p >= tagged)
    if len(hit):
        fresh = np.zeros(len(p), bool)
        fresh[t.chain] = True
        opens = np.ones(len(hit), bool)
        opens[1:] = (np.diff(hit) > 1) | fresh[hit[1:]]
        closes = np.append(opens[1:], True)
        points = np.concatenate(([0], np.cumsum((t.data & 0xC0) != 0x80)))
        owner = np.searchsorted(t.first, hit[opens], side="right") - 1
        starts = np.concatenate(([0], np.cumsum([len((x or "").encode("utf-8", "surrogatepass")) + 1 for x in map(lowered, texts)])))
        base = points[starts[owner]]
        found: dict[int, list[str]] = {}
        for o, s, e in zip(owner, points[t.begin[hit[opens]]] - base, points[t.end[hit[closes]]] - base, strict=True):
            found.setdefault(int(o), []).append(f"{s}:{e}")
        for o, own in found.items():
            spans[o] = ",".join(own)
    return scores, spans


def held_out(doc_id: Column) -> Column:
    """Whether the row's label may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_clean: int = 3500, most_bytes: int = 64_000_000) -> DataFrame:
    """(doc_id, toxic, text) of a bounded sample of labelled documents: of each label up to so many, those of the
    smallest hashes of their ids as long as their texts add up to ``most_bytes`` or less, never held-out ones. Texts
    are whole. Of repeated labels the larger counts, of several texts of an id the one of the smallest hash."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    ids = None
    for flag, most in ((1, most_toxic), (0, most_clean)):
        own = known.where(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = own if ids is None else ids.unionByName(own)
    text = F.coalesce("text", F.lit(""))
    # At most most_toxic + most_clean rows: a bounded broadcast, so that no text is shuffled, and small windows.
    sized = docs.select("doc_id", F.struct(F.xxhash64(text).alias("digest"), F.octet_length(text).alias("size")).alias("t")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))
    upto = F.sum("t.size").over(W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = cut(sized.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("doc_id", "toxic", F.col("t.digest").alias("digest")))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest")).join(F.broadcast(chosen), ["doc_id", "digest"])
    return rows.dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")


def _fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every = list(frames)
    rows = (pd.concat(every) if every else pd.DataFrame({"doc_id": [], "toxic": [], "text": []})).sort_values("doc_id", kind="stable")
    yield pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["toxic"].to_numpy()))]})


def train(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model:
    """Fit a model to a bounded sample of labelled documents (``sample``, whose bounds are parameters). One task
    has the sample; only the model, a few thousand features, comes to the driver."""
    small_batches(docs.sparkSession)
    found = sample(docs, labels, **bounds).coalesce(1).mapInPandas(_fitted, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else Model()


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on) and spans of documents of (doc_id, text), a row for
    each row; other columns are not looked at. Null texts are empty; empty ones score what no evidence scores."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand features: bounded by the sample

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            scores, spans = score_texts(shared.value, frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": scores, "predicted": (scores >= threshold).astype(np.int32), "spans": spans})

    # Ids as text: pandas would make whole numbers with nulls among them floating ones.
    scored = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, score double, predicted int, spans string")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below ``threshold``, whole and in their own columns."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:  # Arrow throughout, so that whatever else a row holds stays as it is
            rows = pd.DataFrame({"text": table.column("text").to_pylist()}, dtype=object)
            low = [score_texts(shared.value, part["text"].tolist())[0] < threshold for part in batches(iter([rows]), "text")]
            yield table.filter(pa.array(np.concatenate(low) if low else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")
