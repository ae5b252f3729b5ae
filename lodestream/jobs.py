"""Jobs from arguments to files: ``python -m lodestream.jobs NAME ARGUMENT...``, or by ``spark-submit``.

Each takes the paths of its inputs and of its report in any file system that Spark knows; ``--help`` lists
them. Reports are single files, as they are made for people and other programs; what they report is computed
by the operators of this library.
"""

from __future__ import annotations

import inspect
import sys
import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import hash_family
from .functions.lineage import checkpoint_dir, cut
from .operators import baskets, cluster, features, graph, itemsets, recommend, similarity
from .sources import readers, sinks
from .sources.sampled import sampled_stream
from .streaming import sketches, stateful
from .streaming.tables import BloomTable


# Names of the files in a folder that models are trained from.
TRAIN, BUSINESSES, USERS = "yelp_train.csv", "business.json", "user.json"


def _itemset_job(own: DataFrame, support: int, out_path: str) -> None:
    own = cut(own)
    n = own.count()
    share = support / max(n, 1)
    sinks.itemset_report_file(cut(itemsets.son_candidates(own, share)), cut(itemsets.son_itemsets(own, share)), out_path)


def frequent_itemsets(spark: SparkSession, case: int, support: int, in_path: str, out_path: str) -> None:
    """Itemsets in at least SUPPORT baskets of user_id,business_id lines: a user's businesses (CASE 1) or the other way round (2)."""
    rows = readers.reviews(spark, in_path)
    basket, item = ("user_id", "business_id") if case == 1 else ("business_id", "user_id")
    _itemset_job(baskets.baskets(rows, basket, item), support, out_path)


def transaction_itemsets(spark: SparkSession, threshold: int, support: int, in_path: str, out_path: str) -> None:
    """Itemsets in at least SUPPORT baskets of a customer's day with more than THRESHOLD lines of a transaction file."""
    rows = readers.transactions(spark, in_path)
    key, product = baskets.day_customer(F.col("TRANSACTION_DT"), F.col("CUSTOMER_ID")), baskets.plain_number(F.col("PRODUCT_ID"))
    _itemset_job(baskets.sized_baskets(rows, key, product, threshold), support, out_path)


def _review_graph(spark: SparkSession, threshold: int, in_path: str) -> DataFrame:
    return cut(graph.co_graph(readers.reviews(spark, in_path), "user_id", "business_id", threshold))


def communities(spark: SparkSession, threshold: int, in_path: str, out_path: str) -> None:
    """Communities by label propagation of users who share at least THRESHOLD businesses."""
    found = graph.communities(graph.label_propagation(_review_graph(spark, threshold, in_path), 5))
    sinks.text_file(sinks.community_lines(found), out_path)


def betweenness(spark: SparkSession, threshold: int, in_path: str, betweenness_path: str, communities_path: str) -> None:
    """Betweenness of the edges of that graph, and its communities by removing edges."""
    edges = _review_graph(spark, threshold, in_path)
    sinks.text_file(sinks.betweenness_lines(graph.edge_betweenness(edges)), betweenness_path)
    parts = graph.communities(graph.girvan_newman(edges).select("id", F.col("component").alias("label")))
    sinks.text_file(sinks.community_lines(parts), communities_path)


def similar_items(spark: SparkSession, in_path: str, out_path: str) -> None:
    """Businesses whose sets of raters are similar by 0.5 or more, by min-hash bands."""
    sets = cut(similarity.members(readers.rating_pairs(spark, in_path), "item", "user"))
    found = similarity.lsh_join(sets, 0.5).toDF("business_id_1", "business_id_2", "similarity")
    sinks.csv_file(found.orderBy("business_id_1", "business_id_2"), out_path)


def _predictions(rows: DataFrame, out_path: str) -> None:
    sinks.csv_file(rows.select(F.col("user").alias("user_id"), F.col("item").alias("business_id"), "prediction").orderBy("user_id", "business_id"), out_path)


def predict_by_items(spark: SparkSession, train_path: str, test_path: str, out_path: str) -> None:
    """Ratings of the test file's pairs from similar items."""
    _predictions(recommend.predict_item_cf(readers.ratings(spark, train_path), readers.rating_pairs(spark, test_path)), out_path)


def _model(spark: SparkSession, folder: str, test_path: str) -> DataFrame:
    train, test = readers.ratings(spark, f"{folder}/{TRAIN}"), readers.rating_pairs(spark, test_path).distinct()
    items = cut(features.featurize_items(readers.businesses(spark, f"{folder}/{BUSINESSES}").drop("categories")))
    users = readers.users(spark, f"{folder}/{USERS}")
    columns = [c for c in (*items.columns, *users.columns) if c not in ("item", "user")]
    model = features.fit_gbt(cut(features.assemble(train, items, users, True)), columns)
    return features.predict_gbt(model, features.assemble(test, items, users, False), columns).select("user", "item", "model")


def predict_by_model(spark: SparkSession, folder: str, test_path: str, out_path: str) -> None:
    """Ratings of the test file's pairs by boosted trees over the training ratings, items and users of FOLDER."""
    _predictions(_model(spark, folder, test_path).withColumnRenamed("model", "prediction"), out_path)


def predict_by_both(spark: SparkSession, folder: str, test_path: str, out_path: str) -> None:
    """Both predictions blended."""
    near = recommend.predict_item_cf(readers.ratings(spark, f"{folder}/{TRAIN}"), readers.rating_pairs(spark, test_path))
    _predictions(recommend.hybrid(near, _model(spark, folder, test_path)), out_path)


def cluster_points(spark: SparkSession, in_path: str, clusters: int, out_path: str) -> None:
    """CLUSTERS clusters of a file of points, in five rounds by summaries."""
    labels, rounds = cluster.bfr(readers.points(spark, in_path).select("id", "features"), clusters)
    head = spark.createDataFrame([(-1, 0, "The intermediate results:"), (1, -(2**62), ""), (1, 1 - 2**62, "The clustering results:")], "part int, at long, line string")
    lines = sinks.bfr_lines(rounds, labels).unionByName(head).orderBy("part", "at")
    sinks.text_file(lines.select("line"), out_path)


def _run(stream: DataFrame, each) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint_dir(stream.sparkSession)}/stream-{uuid4().hex}").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/report-{uuid4().hex}"


def bloom_filter(spark: SparkSession, in_path: str, size: int, asks: int, out_path: str) -> None:
    """False-positive rate of a Bloom filter after each of ASKS batches of SIZE lines drawn from a file."""
    table = BloomTable(_folder(spark), hash_family(30))
    _run(sampled_stream(spark, in_path, size, asks), table)
    sinks.csv_file(table.rates(spark).orderBy("tick").toDF("Time", "FPR"), out_path)


def distinct_counts(spark: SparkSession, in_path: str, size: int, asks: int, out_path: str) -> None:
    """Distinct lines of each of ASKS batches of SIZE, and their estimate by Flajolet-Martin."""
    folder, family = _folder(spark), hash_family(50)
    _run(sampled_stream(spark, in_path, size, asks), sinks.appender(folder, lambda batch: sketches.flajolet_martin(batch, size, family)))
    sinks.csv_file(sinks.collated(spark, folder, "tick long, truth long, estimate long", "tick").toDF("Time", "Ground Truth", "Estimation"), out_path)


def fixed_sample(spark: SparkSession, in_path: str, size: int, asks: int, out_path: str) -> None:
    """What some slots of a sample of 100 lines hold after each batch that ends at a multiple of 100."""
    folder, shown = _folder(spark), (0, 20, 40, 60, 80)
    names = [f"{i}_id" for i in shown]
    _run(stateful.stream_reservoir(sampled_stream(spark, in_path, size, asks)), sinks.appender(folder, lambda batch: batch.select("seqnum", *[F.get("sample", F.lit(i)).alias(n) for i, n in zip(shown, names, strict=True)])))
    schema = ", ".join(["seqnum long", *[f"{n} string" for n in names]])
    sinks.csv_file(sinks.collated(spark, folder, schema, "seqnum"), out_path)


JOBS = {
    f.__name__.replace("_", "-"): f
    for f in (frequent_itemsets, transaction_itemsets, communities, betweenness, similar_items, predict_by_items, predict_by_model, predict_by_both, cluster_points, bloom_filter, distinct_counts, fixed_sample)
}


def usage() -> str:
    lines = ["python -m lodestream.jobs NAME ARGUMENT...", ""]
    for name, job in JOBS.items():
        arguments = [p.upper() for p in list(inspect.signature(job).parameters)[1:]]
        lines += [f"  {name} {' '.join(arguments)}", f"      {job.__doc__.split(chr(10))[0]}"]
    return "\n".join(lines)


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    """Run one job; 2 for a name or number of arguments that there is none of."""
    job = JOBS.get(arguments[0]) if arguments else None
    parameters = list(inspect.signature(job).parameters.values())[1:] if job else []
    if job is None or len(arguments) - 1 != len(parameters):
        print(usage(), file=sys.stderr)
        return 2
    began = time.time()
    given = [int(a) if p.annotation == "int" else a for p, a in zip(parameters, arguments[1:], strict=True)]
    job(spark or SparkSession.builder.appName(f"lodestream {arguments[0]}").getOrCreate(), *given)
    print(f"Duration: {time.time() - began:.1f} s")
    return 0


def console() -> int:
    return main(sys.argv[1:])


if __name__ == "__main__":
    sys.exit(console())
