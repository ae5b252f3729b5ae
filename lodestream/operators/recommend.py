"""Rating prediction from similar items, and blends with a model's predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def mean_ratings(rows: DataFrame) -> DataFrame:
    """(user, item, rating): the mean of repeated ratings."""
    return rows.groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def item_means(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item").agg(F.avg("rating").alias("mean"), F.count(F.lit(1)).alias("n"))


def item_pearson(ratings: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(item_a, item_b, corr, n) over the users who rated both, their means taken over those; 0 where
    either is constant. ``pairs`` (item_a, item_b) limits it to those asked for; pairs without a
    common user have no row. Sums of products combine before they are shuffled."""
    a = ratings.select("user", F.col("item").alias("item_a"), F.col("rating").alias("x"))
    b = ratings.select("user", F.col("item").alias("item_b"), F.col("rating").alias("y"))
    met = a.join(b, "user").where("item_a < item_b") if pairs is None else pairs.join(a, "item_a").join(b, ["user", "item_b"])
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return met.groupBy("item_a", "item_b").agg(F.covar_pop("x", "y").alias("cov"), spread.alias("spread"), F.count(F.lit(1)).alias("n")).select(
        "item_a", "item_b", F.when(F.col("spread") > 1e-12, F.col("cov") / F.col("spread")).otherwise(0.0).alias("corr"), "n"
    )


def predict_item_cf(train: DataFrame, test: DataFrame, cold_item: float = 3.84, power: float = 2.5, few: int = 10, most: float = 6.0, neighbours: int | None = None, exclude_self: bool = False, clip: tuple[float, float] | None = None) -> DataFrame:
    """(user, item, prediction, n) for distinct pairs of ``test`` (user, item) from ``train`` (user, item,
    rating).

    All items the user rated weigh |correlation|^power. With fewer than ``few`` of them negative
    ones count too, with the rating turned round (``most`` - r); else positive ones only. The weighted
    mean is averaged with the item's mean; without weights the item's mean stands. An item nobody
    rated gets ``cold_item``; for a user without ratings n is 0. The item itself, if rated, is
    among its neighbours, unless ``exclude_self``. ``neighbours`` keeps only so many of the largest
    correlation. ``clip`` (least, most) bounds predictions.
    """
    ratings = mean_ratings(train)
    asked = test.select("user", "item").distinct()
    near = asked.join(ratings.select("user", F.col("item").alias("other"), "rating"), "user")
    near = near.where("item <> other") if exclude_self else near
    wanted = near.select(F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).distinct()
    pearson = item_pearson(ratings, wanted).select("item_a", "item_b", "corr")
    near = near.withColumns({"item_a": F.least("item", "other"), "item_b": F.greatest("item", "other")})
    near = near.join(pearson, ["item_a", "item_b"], "left").withColumn("w", F.coalesce("corr", F.lit(0.0)))
    if neighbours is not None:
        order = W.partitionBy("user", "item").orderBy(F.col("w").desc(), "other")
        near = near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= neighbours)
    strength = F.pow(F.abs("w"), power)
    up, down = F.when(F.col("w") > 0, strength), F.when(F.col("w") < 0, strength)
    sums = near.groupBy("user", "item").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(up * F.col("rating")), F.lit(0.0)).alias("up_r"),
        F.coalesce(F.sum(up), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(down * (F.lit(most) - F.col("rating"))), F.lit(0.0)).alias("down_r"),
        F.coalesce(F.sum(down), F.lit(0.0)).alias("down"),
    )
    both = F.col("n") < few
    top = F.col("up_r") + F.when(both, F.col("down_r")).otherwise(0.0)
    weight = F.col("up") + F.when(both, F.col("down")).otherwise(0.0)
    out = asked.join(item_means(ratings).select("item", "mean"), "item", "left").join(sums, ["user", "item"], "left")
    blended = F.when(weight > 0, (top / weight + F.col("mean")) / 2).otherwise(F.col("mean"))
    prediction = F.when(F.col("mean").isNull(), F.lit(cold_item)).otherwise(blended)
    if clip is not None:
        prediction = F.least(F.greatest(prediction, F.lit(float(clip[0]))), F.lit(float(clip[1])))
    return out.select("user", "item", prediction.alias("prediction"), F.coalesce("n", F.lit(0)).alias("n"))


def hybrid(cf: DataFrame, model: DataFrame, over: int = 20, many: float = 0.2, few: float = 0.01) -> DataFrame:
    """(user, item, prediction): ``cf`` (prediction, n) and ``model`` (model) blended, the first at share
    ``many`` where it had more than ``over`` neighbours, else ``few``."""
    share = F.when(F.col("n") > over, F.lit(many)).otherwise(F.lit(few))
    return model.join(cf, ["user", "item"]).select("user", "item", (share * F.col("prediction") + (1 - share) * F.col("model")).alias("prediction"))


def tiered_hybrid(cf: DataFrame, model: DataFrame) -> DataFrame:
    """As ``hybrid``, with shares 0.5, 0.4, 0.2, 0.1 above 10, 5, 3, 2 neighbours and none below."""
    n = F.col("n")
    share = F.when(n > 10, 0.5).when(n > 5, 0.4).when(n > 3, 0.2).when(n > 2, 0.1).otherwise(0.0)
    return model.join(cf, ["user", "item"]).select("user", "item", (share * F.col("prediction") + (1 - share) * F.col("model")).alias("prediction"))
