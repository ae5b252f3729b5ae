"""Input files as DataFrames. Schemas are explicit, so nothing is read twice to infer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut

REVIEWS = "user_id string, business_id string"
RATINGS = "user_id string, business_id string, stars double"
BUSINESSES = "business_id string, review_count long, stars double, attributes map<string,string>, categories string"
USERS = "user_id string, review_count long, useful long, funny long, cool long, fans long, average_stars double"


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, business_id) of a CSV file with a header."""
    return spark.read.schema(REVIEWS).option("header", True).csv(path)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, rating) of a CSV file user_id,business_id,stars with a header."""
    return spark.read.schema(RATINGS).option("header", True).csv(path).toDF("user", "item", "rating")


def rating_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(user, item) of such a file, whose ratings are not looked at."""
    return ratings(spark, path).select("user", "item")


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of transactions with a header and cells that may span lines; all columns are text."""
    return spark.read.option("header", True).option("multiLine", True).csv(path)


def businesses(spark: SparkSession, path: str) -> DataFrame:
    """(item, b_review_count, b_star, attributes, categories) of a JSON-lines file."""
    return spark.read.schema(BUSINESSES).json(path).toDF("item", "b_review_count", "b_star", "attributes", "categories")


def users(spark: SparkSession, path: str) -> DataFrame:
    """(user, u_review_count, useful, funny, cool, fans, u_star) of a JSON-lines file."""
    return spark.read.schema(USERS).json(path).toDF("user", "u_review_count", "useful", "funny", "cool", "fans", "u_star")


def points(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, features) of lines id,label,f1,f2,... without a header."""
    parts = F.split("value", ",")
    features = F.transform(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x.cast("double"))
    return spark.read.text(path).select(parts[0].cast("long").alias("id"), parts[1].alias("label"), features.alias("features"))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(seq, element) of a file with one element a line, numbered from 1 in the order they stand in."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return numbered_rows(lines.withColumnRenamed("value", "element"), "at").select("seq", "element")


def numbered_rows(rows: DataFrame, by: str) -> DataFrame:
    """Rows with ``seq`` from 1 in the order of ``by``: ranges are numbered by themselves and shifted by
    the sizes of those before, a table of one row per range."""
    from pyspark.sql import Window as W

    # Written, as both branches below must see the same ranges.
    placed = cut(rows.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min(by).alias("__first"))
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(W.orderBy("__first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("__part").orderBy(by))
    return placed.withColumn("__nth", nth).join(sizes.select("__part", "__base"), "__part").withColumn("seq", F.col("__nth") + F.col("__base")).drop("__part", "__nth", "__base")
