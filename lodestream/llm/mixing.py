"""Mixing sources to target weights.

Every row gets a hash-random key; within its source the rows are range-partitioned by it and
sorted, prefix sums of sizes run over the ranges and then inside each, and a source is cut where
its sum reaches its budget exactly, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.similarity import numbered
from .common import WORD, cut, null_safe, read


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Adds ``target`` (double) to one row per source (source, source_size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` of
    all sizes. No target is above ``most`` times its source's size; what that frees goes to the
    others by weight until none is above: all below their caps are filled to one level by weight, which
    rises as more are capped. A round of that is one aggregate over the sources, of which one row comes to the
    driver, so neither the sources nor their order are ever in one task.
    """
    places = numbered(totals, "source").withColumnRenamed("source", "__source")
    placed = totals.join(places, F.col("source") == F.col("__source"), "left").drop("__source")
    last = F.coalesce("number", F.lit(places.count()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (last % len(weights) + 1).cast("int"))
    s = cut(placed.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double")).drop("number"))
    budget = float(s.agg(F.sum("source_size")).first()[0] or 0) * share
    level = -1.0
    while True:  # at most a round for each source, and in effect a few
        capped = F.col("cap") / F.col("weight") <= level
        used, free = s.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        higher = (budget - used) / free if free else level
        if not free or higher <= level or s.where(~capped & (F.col("cap") / F.col("weight") <= higher)).isEmpty():
            break
        level = higher
    return s.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.lit((budget - used) / free if free else 0.0) * F.col("weight")).alias("target"))


ADDED = ("size", "source_size", "target", "taken")


def mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix-1", rows_per_range: int = 65_536, least_ranges: int = 1024) -> DataFrame:
    """How much of each row a mix takes. ``rows``: doc_id, source, size and any others, which stay.

    Adds source_size and ``taken`` (long; repeats counted) and target (double; the source's); what comes under
    one of these names is replaced. The amounts taken of a source add up to its target, rounded down; only the
    row at the cut is taken in part. Rows with a null or zero size are never taken. Null sources are one source.
    Equal ids in equal sizes are interchangeable. The same rows and seed give the same mix.
    """
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    others = [c for c in rows.columns if c not in ("doc_id", "source", *ADDED)]
    size, key = F.coalesce("size", F.lit(0)).cast("long"), F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    keyed = cut(rows.select("doc_id", "source", size.alias("size"), key.alias("__key"), *([F.struct(*others).alias("__row")] if others else [])))
    ranges = max(least_ranges, -(-keyed.count() // rows_per_range))
    keyed = keyed.withColumn("__range", F.shiftright(F.shiftright("__key", 30) * ranges, 30))
    by_range = keyed.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    totals = source_targets(cut(by_range.groupBy("source").agg(F.sum("__sum").alias("source_size"))), weights, share, most)
    before = W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    by_range = null_safe(by_range.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum"), totals, ["source"])
    inside = W.partitionBy("source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    mixed = null_safe(keyed, by_range, ["source", "__range"])
    epochs = [F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - F.col("source_size") * e - F.col("__base") - F.col("__before"))) for e in range(most)]
    taken = epochs[0]
    for more in epochs[1:]:
        taken = taken + more
    kept = [F.col("__row")[c].alias(c) if c in others else F.col(c) for c in rows.columns if c not in ADDED[1:]]
    return mixed.select(*kept, "source_size", "target", taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each time a document is taken, the one
    at its source's cut shortened to the words that still fit (n_chars follows). Documents
    without words are not in a mix by words and stay out."""
    columns = docs.columns
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*columns).alias("__row"))
    mixed = mix(sized, **params).where("taken > 0")
    mixed = mixed.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("taken") / F.col("size")) - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("__epoch") * F.col("size"))
    text = F.col("__row")["text"]
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    short = words < F.col("size")
    cut_text = F.when(short, F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")).otherwise(text)
    mixed = mixed.select("__row", short.alias("__short"), cut_text.alias("__text"))
    n_chars = F.when(F.col("__short"), F.length("__text").cast("long"))
    own = {"text": F.col("__text"), "n_chars": F.coalesce(n_chars, F.col("__row")["n_chars"]) if "n_chars" in columns else None}
    return mixed.select(*[own.get(c, F.col("__row")[c]).alias(c) for c in columns])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 15) AS k
  FROM documents),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
filled AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / w) + cap / w * (sum(w) OVER () - sum(w) OVER (ORDER BY cap / w))
            <= CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS capped,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * ((budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
         / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0)) END AS target
  FROM filled),
ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - source_size - before)) AS BIGINT) AS taken
FROM ordered JOIN targets USING (source) WHERE source IS NOT NULL
UNION ALL
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - source_size - before)) AS BIGINT)
FROM ordered JOIN targets ON ordered.source IS NULL AND targets.source IS NULL
"""
