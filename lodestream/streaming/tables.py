"""A Bloom filter over a stream, kept as tables that a batch adds to.

The filter's bits and the elements seen so far are Parquet folders, one part a batch, so neither is one key's state:
a batch is joins and aggregates over all tasks, and its false positives are known exactly. A batch reads the
parts of earlier ones only and overwrites its own, so one that is replayed after a failure does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HashFamily, hashed
from ..functions.lineage import cut
from .sketches import running_share

FIRSTS, BITS, COUNTS = "element string, first long", "bit long, set_at long", "tick long, fp long, n long"


class BloomTable:
    """For ``writeStream.foreachBatch`` of a stream of (seq, tick, element)."""

    def __init__(self, path: str, family: HashFamily) -> None:
        self.path, self.family = path, family

    def _read(self, spark: SparkSession, name: str, schema: str, before: int | None = None) -> DataFrame:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{name}")
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch.select("seq", "tick", "element"))
        known, bits = self._read(spark, "firsts", FIRSTS, number), self._read(spark, "bits", BITS, number)
        fresh = batch.groupBy("element").agg(F.min("seq").alias("first"), F.min_by("tick", "seq").alias("tick"))
        fresh = cut(fresh.join(known.select("element"), "element", "left_anti"))
        asked = cut(fresh.select("element", "first", "tick", F.explode(F.array_distinct(hashed(F.col("element"), self.family))).alias("bit")))
        own = cut(asked.groupBy("bit").agg(F.min("first").alias("set_at")).join(bits.select("bit"), "bit", "left_anti"))
        said = asked.join(bits.unionByName(own), "bit").groupBy("element", "tick").agg(F.bool_and(F.col("set_at") < F.col("first")).alias("fp"))
        by_tick = said.groupBy("tick").agg(F.count_if("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
        counts = batch.select("tick").distinct().join(by_tick, "tick", "left").fillna(0, ["fp", "n"])
        for name, rows in (("firsts", fresh.select("element", "first")), ("bits", own), ("counts", counts)):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def rates(self, spark: SparkSession) -> DataFrame:
        """(tick, fpr): after each tick, the share of first occurrences so far that the filter took for repeats."""
        counts = self._read(spark, "counts", COUNTS).groupBy("tick").agg(F.sum("fp").alias("fp"), F.sum("n").alias("n"))
        return running_share(counts, "fp", "n").withColumnRenamed("share", "fpr")
