"""Secret scans: patterns, and character Markov models of random strings and identifiers.

All of it is DataFrame functions. Matches of a pattern and the text between them are two array
expressions of the same leftmost non-overlapping scan, so offsets are running sums of their
lengths, which like all else here take no more than n log n steps for a long text or many spans. Spans that the patterns don't name are found by the log-likelihood ratio of two first
order character models, one of random strings and one of ordinary identifiers, whose transition
counts are aggregates over labelled samples.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .expressions import between, blocks_of, let, scan

#: The kinds of the base scan as given: pattern, group that is measured, least length of it.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: A document can only match a kind if it holds this; cheaper than the whole scan.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: What the models look at: a run of key characters with a digit and a letter in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
SPAN = "struct<start:long,kind:int,stop:long>"
#: Code points of a text that are looked through for a place in it.
BLOCK = 4096


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans (start, stop, kind) of a pattern's leftmost non-overlapping matches whose ``group`` has
    at least so many characters, with the ``word`` matched; code points, stop exclusive."""
    gaps, words = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else words
    items = F.transform(F.arrays_zip(gaps.alias("g"), words.alias("w"), measured.alias("m")), lambda x: F.struct((F.length(x["g"]) + F.length(x["w"])).cast("long").alias("step"), x["w"].alias("word"), F.length(x["m"]).alias("n")))

    def placed(own: Column) -> Column:
        ends = scan(F.transform(own, lambda x: x["step"]), lambda a, b: a + b)
        return let(ends, lambda at: F.transform(own, lambda x, i: F.struct((F.get(at, i) - F.length(x["word"])).alias("start"), F.get(at, i).alias("stop"), F.lit(kind).alias("kind"), x["word"].alias("word"), x["n"].alias("n"))))

    # What follows the last match is a gap without a word.
    return F.filter(let(F.filter(items, lambda x: x["word"].isNotNull()), placed), lambda x: x["n"] >= least)


def _ordered(spans: Column) -> Column:
    """Spans as (start, kind, stop)."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    none = F.array().cast(f"array<{SPAN}>")
    own = [F.when(text.rlike(HINTS[k]), _ordered(matches(text, p, g, n, i))).otherwise(none) for i, (k, (p, g, n)) in enumerate(KINDS.items())]
    return F.sort_array(F.concat(*own))


def joined(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def steps_of(word: Column) -> Column:
    """For each two characters in a row their places in the alphabet (from 1; 0 for others) as one number."""
    places = F.transform(F.split(word, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    return let(places, lambda at: F.transform(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda x, i: F.get(at, i) * (len(ALPHABET) + 1) + x))


def transitions(words: DataFrame) -> DataFrame:
    """(klass, step, n): in how many distinct samples (klass, word) a character follows another; a step
    is the places of both as one number. Once a sample, so that a long or repeated one is one voice."""
    steps = F.array_distinct(steps_of(F.col("word")))
    return words.where(F.length("word") > 1).distinct().select("klass", F.explode(steps).alias("step")).groupBy("klass", "step").agg(F.count(F.lit(1)).alias("n"))


def labelled_samples(docs: DataFrame, secret_docs: int = 4000, plain_docs: int = 500, made: int = 4000) -> DataFrame:
    """(klass, word): 1 for random strings, 0 for ordinary identifiers.

    Random strings are what the patterns find in at most ``secret_docs`` documents and ``made``
    digests in hex, base 64 and upper case; identifiers are the words from four characters on of
    at most ``plain_docs`` documents, without those that look like keys, and ``made`` dates and
    numbered names. Documents are those
    of the smallest hashes of their ids; the bounds are on rows, whose texts are whole.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hints = reduce(lambda a, b: a | b, [F.col("text").rlike(h) for h in HINTS.values()])

    def long_ones(pattern: str, group: int, least: int) -> Column:
        return F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda m: F.length(m) >= least)

    found = [long_ones(*kind) for kind in KINDS.values()]

    def chosen(rows: DataFrame, most: int, klass: int) -> DataFrame:
        return rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("klass", F.lit(klass))

    # At most secret_docs + plain_docs ids: a bounded broadcast, so that no text is shuffled.
    ids = chosen(docs.where(hints), secret_docs, 1).unionByName(chosen(docs, plain_docs, 0))
    rows = docs.join(F.broadcast(ids), "doc_id")
    digest = F.unhex(F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256))
    kinds = F.array(F.lower(F.hex(digest)), F.regexp_replace(F.base64(digest), "=", ""), F.upper(F.regexp_replace(F.base64(digest), "[+/=]", "")))
    when = F.date_format(F.timestamp_seconds(F.col("id") * 864_013), "yyyy-MM-dd'T'HH-mm-ss")
    n = F.col("id").cast("string")
    plain_kinds = F.array(when, F.concat(F.lit("user_"), n, F.lit("_item"), (F.col("id") % 17).cast("string")), F.concat(F.lit("part-"), (F.col("id") % 97).cast("string"), F.lit("-section-"), n))
    nth = (F.col("id") % 3 + 1).cast("int")
    generated = spark.range(made).select(F.explode(F.array(F.struct(F.lit(1).alias("klass"), F.element_at(kinds, nth).alias("word")), F.struct(F.lit(0).alias("klass"), F.element_at(plain_kinds, nth).alias("word")))).alias("s")).select("s.klass", "s.word")
    words = F.filter(F.split("text", r"[^A-Za-z0-9+/_-]+"), lambda w: (F.length(w) >= 4) & ~w.rlike(r"[0-9a-f]{32}|AKIA|[0-9].*[0-9].*[0-9]"))
    own = F.when(F.col("klass") == 1, F.concat(*found)).otherwise(words)
    return rows.select("klass", F.explode(own).alias("word")).unionByName(generated)


def ratios(samples: DataFrame, smooth: float = 0.5, prior: float = 5.0) -> list[float]:
    """Log-likelihood ratio of each step, random against ordinary, in rows of the first character. A
    step's probability leans on its second character's by ``prior`` counts, so that characters rare in
    a class are rare after ones it never has, too. Counts are aggregated by Spark; at most two
    tables of alphabet by alphabet come here."""
    size = len(ALPHABET) + 1
    counts = np.zeros((2, size, size))
    for r in transitions(samples).collect():  # at most 2 * 67 * 67 rows
        counts[r["klass"], r["step"] // size, r["step"] % size] += r["n"]
    single = counts.sum(1) + smooth
    single /= single.sum(1, keepdims=True)
    chance = (counts + prior * single[:, None, :]) / (counts.sum(2, keepdims=True) + prior)
    return np.log(chance[1] / chance[0]).reshape(-1).tolist()


def random_spans(text: Column, table: list[float], per_step: float, total: float) -> Column:
    """Spans of key-like runs whose mean ratio a step is ``per_step`` or more, and whose sum ``total``."""
    ratio = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    scored = F.transform(matches(text, CANDIDATE, 0, 16, len(KINDS)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.aggregate(steps_of(s["word"]), F.lit(0.0), lambda acc, x: acc + F.element_at(ratio, x + 1)).alias("llr")))
    kept = F.filter(scored, lambda s: (s["llr"] >= total) & (s["llr"] >= per_step * (s["stop"] - s["start"] - 1)))
    return F.when(text.rlike(CANDIDATE), _ordered(kept)).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_free(base: Column, more: Column) -> Column:
    """All of ``base`` and those of ``more`` that overlap none of it, in order: of all by start, a span is free if
    no base span before it reaches into it and none after it begins in it."""
    added = len(KINDS)
    every = F.sort_array(F.concat(base, more))

    def free(own: Column) -> Column:
        reach = scan(F.transform(own, lambda s: F.when(s["kind"] < added, s["stop"]).otherwise(F.lit(-1).cast("long"))), F.greatest)
        ahead = scan(F.transform(own, lambda s: F.when(s["kind"] < added, s["start"]).otherwise(F.lit(1 << 62))), F.least, backward=True)
        both = F.arrays_zip(own.alias("s"), reach.alias("reach"), ahead.alias("ahead"))
        kept = F.filter(both, lambda x: (x["s"]["kind"] < added) | ((x["reach"] <= x["s"]["start"]) & (x["ahead"] >= x["s"]["stop"])))
        return F.transform(kept, lambda x: x["s"])

    return F.when(F.size(more) == 0, base).otherwise(let(every, free))


def scan_texts(docs: DataFrame, per_step: float = 1.5, total: float = 25.0, **samples: int) -> DataFrame:
    """Adds ``base`` and ``spans`` to documents of (doc_id, text and any others, which stay; columns of these two names
    are replaced): arrays of (start, kind, stop) in order, the pattern's spans and those with the models' added.
    An added span overlaps no base span. Null texts are empty and hold nothing; repeated rows each have their spans."""
    table = ratios(labelled_samples(docs, **samples))
    text, more = F.coalesce("text", F.lit("")), "__more"
    while more in docs.columns:
        more += "_"
    out = docs.withColumn("base", base_spans(text)).withColumn(more, random_spans(text, table, per_step, total))
    return out.withColumn("spans", with_free(F.col("base"), F.col(more))).drop(more)


def blanked(text: Column, spans: Column, mark: str) -> Column:
    """A text with each of its spans, which are in order and one at least, replaced; overlapping ones as one."""
    reach = scan(F.transform(spans, lambda s: s["stop"]), F.greatest)

    def groups(at: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: F.get(spans, i)["start"] >= F.coalesce(F.get(at, i - 1), F.lit(-1)))
        begins = lambda own, j: F.get(spans, F.get(own, j))["start"]
        ends = lambda own, j: F.get(at, F.coalesce(F.get(own, j + 1), F.size(at)) - 1)
        return let(opens, lambda own: F.transform(own, lambda _, j: F.struct(F.when(j > 0, ends(own, j - 1)).otherwise(F.lit(0).cast("long")).alias("low"), begins(own, j).alias("high"))))

    def run(blocks: Column) -> Column:
        gaps = F.transform(let(reach, groups), lambda g: F.concat(between(blocks, BLOCK, g["low"], g["high"]), F.lit(mark)))
        rest = between(blocks, BLOCK, F.array_max(F.transform(spans, lambda s: s["stop"])), F.length(text).cast("long"))
        return F.concat(F.array_join(gaps, ""), rest)

    return let(blocks_of(text, BLOCK), run)


def redact(docs: DataFrame, mark: str = "[SECRET]", **params) -> DataFrame:
    """The documents, in their own columns, with each span (overlapping ones as one) replaced by
    ``mark``; n_chars follows. None is dropped."""
    columns = docs.columns
    found = scan_texts(docs.select("doc_id", "text", F.struct(*columns).alias("__row")), **params)
    some = F.size("spans") > 0
    text = F.when(some, blanked(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    found = found.select("__row", some.alias("__some"), text.alias("__text"))
    n_chars = F.when(F.col("__some"), F.length("__text").cast("long"))
    own = {"text": F.col("__text"), "n_chars": F.coalesce(n_chars, F.col("__row")["n_chars"]) if "n_chars" in columns else None}
    return found.select(*[own.get(c, F.col("__row")[c]).alias(c) for c in columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_texts(read(spark, sf_dir, "documents", "doc_id", "text"))
    names = [*KINDS, "markov"]
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(names)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), names).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), names).alias("spans"))
