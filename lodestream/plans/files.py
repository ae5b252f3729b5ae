"""Queries that go through files, reports and streams and come back as rows.

Tables are written in the formats of the jobs' inputs below the session's shared folder, read by the readers, and
removed once what was read is written to the shared folder itself.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir, cut
from ..operators import baskets as B
from ..operators import features as X
from ..operators import graph as G
from ..operators import recommend as R
from ..operators import similarity as S
from ..sources import readers, sinks
from ..streaming import stateful
from ..streaming.tables import BloomTable
from . import registry as Q


def _through(spark: SparkSession, write: Callable[[str], None], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """What ``read`` finds in what ``write`` wrote."""
    path = f"{checkpoint_dir(spark)}/files-{uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        write(path)
        return cut(read(spark, path))
    finally:
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def files_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q._month_rows(spark, sf).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("business_id"))
    read = _through(spark, lambda p: sinks.write_csv(rows, p), readers.reviews)
    return read.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("business_id").alias("items"))


def files_ratings(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q._t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("user_id"), F.col("l_suppkey").alias("business_id"), (1 + F.col("l_quantity") % 5).alias("stars"))
    read = _through(spark, lambda p: sinks.write_csv(rows, p), readers.ratings)
    return R.item_means(R.mean_ratings(read)).select("item", F.round("mean", 6).alias("mean"), "n")


def files_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """With a cell that spans lines, dates with four digits of the year and numbers with leading zeros."""
    date = F.concat(F.month("o_orderdate").cast("string"), F.lit("/1/"), F.year("o_orderdate").cast("string"))
    product = F.concat(F.lit("00"), F.col("l_partkey").cast("string"))
    rows = Q._month_rows(spark, sf).select(date.alias("TRANSACTION_DT"), F.col("o_custkey").alias("CUSTOMER_ID"), F.lit("first, line\nsecond").alias("NOTE"), product.alias("PRODUCT_ID"))
    read = _through(spark, lambda p: rows.write.option("header", True).csv(p), readers.transactions)
    b = B.sized_baskets(read, B.day_customer(F.col("TRANSACTION_DT"), F.col("CUSTOMER_ID")), B.plain_number(F.col("PRODUCT_ID")), 3)
    return b.select("basket", F.array_join("items", "|").alias("items"), F.col("n").alias("n_lines"))


def files_businesses(spark: SparkSession, sf: str) -> DataFrame:
    s = Q._t(spark, sf, "supplier")
    attributes = F.when(F.col("s_suppkey") % 4 != 0, F.create_map(F.lit("WiFi"), F.when(F.col("s_nationkey") < 12, "free").otherwise("no")))
    rows = s.select(F.col("s_name").alias("business_id"), F.col("s_nationkey").alias("review_count"), F.round(F.col("s_acctbal") / 1000, 1).alias("stars"), attributes.alias("attributes"), F.lit("x").alias("other"))
    read = _through(spark, lambda p: rows.write.json(p), readers.businesses)
    return read.select("item", "b_review_count", "b_star", F.col("attributes")["WiFi"].alias("wifi"))


def files_users(spark: SparkSession, sf: str) -> DataFrame:
    c = Q._t(spark, sf, "customer")
    cool, fans = F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(2), F.col("c_custkey") % 7
    rows = c.select(F.col("c_name").alias("user_id"), F.col("c_custkey").alias("review_count"), F.col("c_nationkey").alias("useful"), F.lit(0).alias("funny"), cool.alias("cool"), fans.alias("fans"), F.round("c_acctbal", 2).alias("average_stars"))
    return _through(spark, lambda p: rows.write.json(p), readers.users)


def files_points(spark: SparkSession, sf: str) -> DataFrame:
    e = Q._t(spark, sf, "embeddings")
    numbers = F.transform("embedding", lambda x: F.round(x.cast("double"), 4).cast("string"))
    lines = e.select(F.concat_ws(",", F.col("vec_id").cast("string"), F.col("label").cast("string"), F.array_join(numbers, ",")).alias("line"))
    read = _through(spark, lambda p: lines.write.text(p), readers.points)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return read.select("id", "label", F.size("features").cast("long").alias("n"), F.round(total, 4).alias("total"))


def files_elements(spark: SparkSession, sf: str) -> DataFrame:
    """One file of lines, numbered in the order they stand in."""
    lines = Q._stream(spark, sf).orderBy("seq").select("element")
    return _through(spark, lambda p: sinks.text_file(lines, p), readers.elements).select("seq", "element")


def report_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    b = cut(Q._brand_baskets(spark, sf))
    return sinks.itemset_lines(Q.I.frequent_itemsets(b, Q.PAIR_SHARE * b.count()).select("itemset"), "Frequent Itemsets")


def report_communities(spark: SparkSession, sf: str) -> DataFrame:
    found = G.communities(G.label_propagation(Q._graph(spark, sf, Q.PATH_EDGE), 5))
    return _through(spark, lambda p: sinks.text_file(sinks.community_lines(found), p), lambda s, p: s.read.text(p).toDF("line"))


def report_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    found = G.edge_betweenness(Q._graph(spark, sf, Q.SPLIT_EDGE))
    return _through(spark, lambda p: sinks.text_file(sinks.betweenness_lines(found), p), lambda s, p: s.read.text(p).toDF("line"))


def report_similar(spark: SparkSession, sf: str) -> DataFrame:
    found = S.jaccard_join(Q._event_sets(spark, sf), 0.5).withColumn("similarity", F.round("similarity", 6))
    schema = "id_1 long, id_2 long, similarity double"
    return _through(spark, lambda p: sinks.csv_file(found.orderBy("id_1", "id_2"), p), lambda s, p: s.read.schema(schema).option("header", True).csv(p))


def missing_values(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls of some columns, where a seventh of all customers is unknown."""
    train, _ = Q._ratings(spark, sf)
    users = Q._users(spark, sf).where("user % 7 <> 0")
    return X.missing_counts(X.assemble(R.mean_ratings(train), Q._items(spark, sf), users, True).select("rating", "b_price", "u_balance"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of (seq, tick, element)."""
    path = f"{sf}/events.parquet"
    first = Q._t(spark, sf, "events").agg(F.min("event_id")).first()[0] or 0
    # A pattern, as a path that is one file and not a folder of them is none to a stream.
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.[p]arquet")
    seq = F.col("event_id") - first + 1
    return stream.select(seq.alias("seq"), F.floor((seq - 1) / Q.TICK).alias("tick"), F.col("user_id").cast("string").alias("element"))


def _drained(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], state: str) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{state}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()


def stream_bloom_rates(spark: SparkSession, sf: str) -> DataFrame:
    def read(own: SparkSession, path: str) -> DataFrame:
        return BloomTable(path, Q.BLOOM).rates(own).withColumn("fpr", F.round("fpr", 9))

    return _through(spark, lambda p: _drained(_events(spark, sf), "append", BloomTable(p, Q.BLOOM), p), read)


def stream_distinct_estimates(spark: SparkSession, sf: str) -> DataFrame:
    found = stateful.stream_distinct(_events(spark, sf), Q.FM)
    return _through(spark, lambda p: _drained(found, "complete", lambda batch, _: batch.write.mode("overwrite").parquet(f"{p}/out"), p), lambda s, p: s.read.parquet(f"{p}/out"))


def stream_reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """The sample after the stream's last batch."""
    found = stateful.stream_reservoir(_events(spark, sf))

    def read(own: SparkSession, path: str) -> DataFrame:
        last = own.read.parquet(f"{path}/out").groupBy().agg(F.max_by("sample", "seqnum").alias("sample"))
        return last.select(F.posexplode("sample").alias("slot", "element")).select(F.col("slot").cast("long").alias("slot"), "element")

    return _through(spark, lambda p: _drained(found, "append", lambda batch, n: batch.write.mode("overwrite").parquet(f"{p}/out/batch={n}"), p), read)


QUERIES = {
    f.__name__: f
    for f in (
        files_reviews, files_ratings, files_transactions, files_businesses, files_users, files_points, files_elements,
        report_itemsets, report_communities, report_betweenness, report_similar, missing_values,
        stream_bloom_rates, stream_distinct_estimates, stream_reservoir,
    )
}
