"""Every query over the batch and stream operators on the provided tables, and the SQL with the same rows.

Inputs are derived alike on both sides: baskets are orders with their parts' brands, or a customer's
month; raters are customers, rated items brands, a rating 1 to 5 from the quantity; the graph joins
customers who bought the same parts; the stream is ``events`` in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_family
from ..functions.lineage import cut
from ..operators import baskets as B
from ..operators import cluster as C
from ..operators import features as X
from ..operators import graph as G
from ..operators import itemsets as I
from ..operators import recommend as R
from ..operators import similarity as S
from ..streaming import sketches as K

#: A pair of brands in this share of all orders, and so on, is frequent.
PAIR_SHARE, SET_SHARE = 0.03, 0.0025
#: Customers who share so many parts have an edge; more for what looks at all pairs of vertices, and for what takes
#: the graph apart edge by edge.
EDGE, PATH_EDGE, SPLIT_EDGE = 3, 5, 7
TICK = 100
BLOOM, FM = hash_family(30, size=997, seed=7), hash_family(48, seed=11)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    line = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = _t(spark, sf, "part").select("p_partkey", "p_brand")
    return line.join(part, line.l_partkey == part.p_partkey)


def _brand_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return B.baskets(_sales(spark, sf), "l_orderkey", "p_brand")


def _shown(itemsets: DataFrame) -> DataFrame:
    return itemsets.select("length", F.array_join("itemset", "|").alias("itemset"), "support")


def baskets_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _brand_baskets(spark, sf).select("basket", F.array_join("items", "|").alias("items"), F.size("items").cast("long").alias("n"))


def baskets_brands(spark: SparkSession, sf: str) -> DataFrame:
    """The other orientation: a brand's orders, counted and summed."""
    b = B.baskets(_sales(spark, sf), "p_brand", "l_orderkey")
    return b.select("basket", F.size("items").cast("long").alias("n"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"))


def _month_rows(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def baskets_min_size(spark: SparkSession, sf: str) -> DataFrame:
    """Customer-months with more than three lines, keyed by month/day/yy-customer."""
    date = F.concat(F.month("o_orderdate").cast("string"), F.lit("/1/"), F.year("o_orderdate").cast("string"))
    b = B.sized_baskets(_month_rows(spark, sf), B.day_customer(date, F.col("o_custkey")), B.plain_number(F.concat(F.lit("00"), F.col("l_partkey").cast("string"))), 3)
    return b.select("basket", F.array_join("items", "|").alias("items"), F.col("n").alias("n_lines"))


def frequent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = cut(_brand_baskets(spark, sf))
    return _shown(I.frequent_itemsets(b, PAIR_SHARE * b.count(), 2).where("length = 2"))


def frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    b = cut(_brand_baskets(spark, sf))
    return _shown(I.frequent_itemsets(b, SET_SHARE * b.count()))


def son_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(I.son_itemsets(_brand_baskets(spark, sf), PAIR_SHARE))


def frequent_itemsets_months(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parts bought together in a customer's month, of months with more than three lines."""
    part = _t(spark, sf, "part").select("p_partkey", "p_type")
    rows = _month_rows(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey"))
    key = F.concat_ws("-", F.date_format("o_orderdate", "yyyyMM"), F.col("o_custkey").cast("string"))
    b = cut(B.sized_baskets(rows, key, F.col("p_type"), 3))
    return _shown(I.frequent_itemsets(b, 0.2 * b.count()))


def _weights(spark: SparkSession, sf: str, least: int) -> DataFrame:
    rows = _month_rows(spark, sf).select("o_custkey", "l_partkey")
    return G.co_counts(rows, "o_custkey", "l_partkey").where(F.col("weight") >= least)


def _graph(spark: SparkSession, sf: str, least: int = EDGE) -> DataFrame:
    return cut(G.mirrored(_weights(spark, sf, least).select("src", "dst")))


def co_purchase_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf, EDGE)


def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return G.label_propagation(_graph(spark, sf), 5)


def label_communities(spark: SparkSession, sf: str) -> DataFrame:
    c = G.communities(G.label_propagation(_graph(spark, sf), 5))
    return c.select("label", F.array_join(F.transform("members", lambda m: m.cast("string")), "|").alias("members"), "size")


def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return G.connected_components(_graph(spark, sf))


def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    return G.shortest_paths(_graph(spark, sf, PATH_EDGE)).select("s", "t", F.col("d").cast("long").alias("d"), "sigma")


def edge_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return G.edge_betweenness(_graph(spark, sf, PATH_EDGE)).select("src", "dst", F.round("betweenness", 5).alias("betweenness"))


def girvan_newman(spark: SparkSession, sf: str) -> DataFrame:
    return G.girvan_newman(_graph(spark, sf, SPLIT_EDGE))


def betweenness_removal(spark: SparkSession, sf: str) -> DataFrame:
    """One round of edge removal: the components without the edges of the largest betweenness."""
    graph = _graph(spark, sf, SPLIT_EDGE)
    left = G.without_top_edges(graph, G.edge_betweenness(graph), digits=5)
    return G.connected_components(left, graph.select(F.col("src").alias("id")).distinct())


def community_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Modularity of the communities that labels give, null if no customers share so many parts."""
    graph = _graph(spark, sf, PATH_EDGE)
    parts = G.label_propagation(graph, 5).withColumnRenamed("label", "component")
    q = G.modularity(graph, parts, graph.count() // 2)
    return spark.createDataFrame([(q,)], "modularity double").select(F.round("modularity", 6).alias("modularity"))


def _brand_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's buyers, for parts as sets."""
    return S.members(_month_rows(spark, sf), "o_custkey", "l_partkey")


def _event_sets(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return S.members(e, "user_id", "k")


def jaccard_users(spark: SparkSession, sf: str) -> DataFrame:
    return S.jaccard_join(_event_sets(spark, sf), 0.5).withColumn("similarity", F.round("similarity", 6))


def jaccard_customers(spark: SparkSession, sf: str) -> DataFrame:
    return S.jaccard_join(_brand_customers(spark, sf), 0.1).withColumn("similarity", F.round("similarity", 6))


def minhash_signatures(spark: SparkSession, sf: str) -> DataFrame:
    sets = _event_sets(spark, sf)
    numbers = S.numbered(sets, "element")
    return S.minhash(sets.join(numbers, "element").select("id", "number"), numbers.count()).select("id", F.col("nth").cast("long").alias("nth"), "value")


def lsh_users(spark: SparkSession, sf: str) -> DataFrame:
    return S.lsh_join(_event_sets(spark, sf), 0.5).withColumn("similarity", F.round("similarity", 6))


def _ratings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of (user, item, rating): orders whose key ends in 0 are the test."""
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rows = _sales(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_orderkey", F.col("o_custkey").alias("user"), F.col("p_brand").alias("item"), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"))
    return rows.where("l_orderkey % 10 <> 0").drop("l_orderkey"), rows.where("l_orderkey % 10 = 0").drop("l_orderkey")


def item_means(spark: SparkSession, sf: str) -> DataFrame:
    return R.item_means(R.mean_ratings(_ratings(spark, sf)[0])).select("item", F.round("mean", 6).alias("mean"), "n")


def item_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return R.item_pearson(R.mean_ratings(_ratings(spark, sf)[0])).withColumn("corr", F.round("corr", 6))


def item_cf(spark: SparkSession, sf: str) -> DataFrame:
    return R.predict_item_cf(*_ratings(spark, sf)).withColumn("prediction", F.round("prediction", 4))


def hybrid_item_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The blend with a fixed model, an item's mean rating, in place of trees."""
    train, test = _ratings(spark, sf)
    means = R.item_means(R.mean_ratings(train)).select("item", F.col("mean").alias("model"))
    model = test.select("user", "item").distinct().join(means, "item")
    return R.hybrid(R.predict_item_cf(train, test), model).withColumn("prediction", F.round("prediction", 4))


def hybrid_tiered(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _ratings(spark, sf)
    means = R.item_means(R.mean_ratings(train)).select("item", F.col("mean").alias("model"))
    model = test.select("user", "item").distinct().join(means, "item")
    return R.tiered_hybrid(R.predict_item_cf(train, test), model).withColumn("prediction", F.round("prediction", 4))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("item")).agg(F.count(F.lit(1)).alias("b_review_count"), F.round(F.avg("p_retailprice"), 4).alias("b_price"), F.round(F.avg("p_size"), 4).alias("b_size"))


def _users(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer")
    segments = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return c.select(F.col("c_custkey").alias("user"), F.col("c_acctbal").alias("u_balance"), *[(F.col("c_mktsegment") == s).cast("int").alias(f"u_{s.lower()}") for s in segments])


def assembled_features(spark: SparkSession, sf: str) -> DataFrame:
    """What trees are trained on: training ratings with the columns of their brands and customers."""
    train, _ = _ratings(spark, sf)
    return X.assemble(R.mean_ratings(train).withColumn("rating", F.round("rating", 6)), _items(spark, sf), _users(spark, sf), True)


def item_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute maps coded as numbers: suppliers with two flags, one of them often missing, and a category."""
    s = _t(spark, sf, "supplier")
    flag = F.when(F.col("s_acctbal") > 0, "True").otherwise("False")
    some = F.when(F.col("s_suppkey") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("s_suppkey") % 2 == 0, "True").otherwise("False"))
    kinds = F.map_from_arrays(F.array(F.lit("InCredit"), F.lit("Delivery"), F.lit("WiFi"), F.lit("Music")), F.array(flag, some, F.when(F.col("s_nationkey") < 12, "free").otherwise("no"), F.lit("x")))
    return X.featurize_items(s.select(F.col("s_suppkey").alias("item"), kinds.alias("attributes")))


FEATURES = ["b_review_count", "b_price", "b_size", "u_balance", "u_automobile", "u_building", "u_furniture", "u_household", "u_machinery"]


def _gbt(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    train, test = _ratings(spark, sf)
    items, users = _items(spark, sf), _users(spark, sf)
    model = X.fit_gbt(cut(X.assemble(R.mean_ratings(train), items, users, True)), FEATURES)
    asked = X.assemble(test.select("user", "item").distinct(), items, users, False)
    return train, test, X.predict_gbt(model, asked, FEATURES).select("user", "item", "model")


def gbt_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _gbt(spark, sf)[2].withColumnRenamed("model", "prediction")


def hybrid_predictions(spark: SparkSession, sf: str) -> DataFrame:
    train, test, model = _gbt(spark, sf)
    return R.hybrid(R.predict_item_cf(train, test), model)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def cluster_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each component of each summary."""
    s = C.summaries(_points(spark, sf))
    each = s.select("cluster", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("at", "v"))
    return each.select("cluster", (F.col("at") + 1).cast("long").alias("dim"), "n", F.round("v.total", 5).alias("total"), F.round("v.squares", 5).alias("squares"))


def nearest_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's nearest summary of the labelled ones, within twice the root of the dimension."""
    p = _points(spark, sf)
    return C.nearest_within(p.drop("cluster"), cut(C.summaries(p))).withColumn("distance", F.round("distance", 5))


def _bfr_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, discard set, compression set): the summaries of the first five labels and of the others."""
    p = _points(spark, sf)
    return p.drop("cluster"), cut(C.summaries(p.where("cluster < 5"))), cut(C.summaries(p.where("cluster >= 5")))


def bfr_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """One round's assignment: to the discard set, else to the compression set."""
    points, discard, compressed = _bfr_sets(spark, sf)
    near = cut(C.nearest_within(points, discard))
    close = C.nearest_within(points.join(near, "id", "left_anti"), compressed)
    rows = [d.select("id", F.lit(part).alias("part"), "cluster") for part, d in (("discard", near), ("compression", close))]
    return rows[0].unionByName(rows[1])


def bfr_update(spark: SparkSession, sf: str) -> DataFrame:
    """The discard set after that round."""
    points, discard, _ = _bfr_sets(spark, sf)
    after = C.merged(discard, C.summaries(points.join(C.nearest_within(points, discard).select("id", "cluster"), "id")))
    each = after.select("cluster", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("at", "v"))
    return each.select("cluster", (F.col("at") + 1).cast("long").alias("dim"), "n", F.round("v.total", 5).alias("total"), F.round("v.squares", 5).alias("squares"))


def bfr_labels(spark: SparkSession, sf: str) -> DataFrame:
    return C.bfr(_points(spark, sf).drop("cluster"), 10)[0]


def bfr_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return C.bfr(_points(spark, sf).drop("cluster"), 10)[1]


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").agg(F.min("event_id")).first()[0] or 0
    return _t(spark, sf, "events").select((F.col("event_id") - e + 1).alias("seq"), F.col("user_id").cast("string").alias("element"))


def bloom_rates(spark: SparkSession, sf: str) -> DataFrame:
    return K.bloom_rates(_stream(spark, sf), TICK, BLOOM).withColumn("fpr", F.round("fpr", 9))


def distinct_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return K.flajolet_martin(_stream(spark, sf), TICK, FM)


def distinct_estimates_by_element(spark: SparkSession, sf: str) -> DataFrame:
    return K.flajolet_martin_by_element(_stream(spark, sf), TICK, FM)


def distinct_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return K.accuracy(K.flajolet_martin(_stream(spark, sf), TICK, FM)).withColumn("ratio", F.round("ratio", 9))


def reservoir(spark: SparkSession, sf: str) -> DataFrame:
    return K.reservoir(_stream(spark, sf))


def reservoir_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return K.reservoir_snapshots(_stream(spark, sf), TICK)


QUERIES = {
    f.__name__: f
    for f in (
        baskets_orders, baskets_brands, baskets_min_size, frequent_pairs, frequent_itemsets, son_itemsets, frequent_itemsets_months,
        co_purchase_graph, label_propagation, label_communities, connected_components, shortest_paths, edge_betweenness, betweenness_removal, community_modularity, girvan_newman,
        jaccard_users, jaccard_customers, minhash_signatures, lsh_users,
        item_means, item_pearson, item_cf, hybrid_item_mean, hybrid_tiered, assembled_features, item_attributes, gbt_predictions, hybrid_predictions,
        cluster_summaries, nearest_cluster, bfr_assignment, bfr_update, bfr_labels, bfr_rounds,
        bloom_rates, distinct_estimates, distinct_estimates_by_element, distinct_accuracy, reservoir, reservoir_snapshots,
    )
}
