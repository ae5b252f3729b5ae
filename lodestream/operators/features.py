"""Features of items and users, and boosted trees over them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attribute names as they occur in the item files.
DROPPED = ("BusinessParking", "Ambience", "BestNights", "GoodForMeal", "HairSpecializesIn", "Music")
CATEGORIES = ("AgesAllowed", "Alcohol", "BYOBCorkage", "NoiseLevel", "RestaurantsAttire", "Smoking", "WiFi")


def _column(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name)


def attribute_names(items: DataFrame, dropped: tuple[str, ...] = DROPPED, categories: tuple[str, ...] = CATEGORIES) -> tuple[list[str], list[tuple[str, str]]]:
    """(names of flags, (name, value) of categories) among the attributes of all items. As many as
    the schema has columns, so they come to the driver."""
    pairs = items.where("attributes IS NOT NULL").select(F.explode("attributes").alias("name", "value"))
    kept = pairs.where(~F.col("name").isin(*dropped))
    flags = [r[0] for r in kept.where(~F.col("name").isin(*categories)).select("name").distinct().orderBy("name").collect()]
    values = [(r[0], r[1]) for r in kept.where(F.col("name").isin(*categories) & F.col("value").isNotNull()).distinct().orderBy("name", "value").collect()]
    return flags, values


def featurize_items(items: DataFrame, collapse: bool = False, **names: tuple[str, ...]) -> DataFrame:
    """Items with their ``attributes`` map as numeric columns: a flag is 1, 0 for ``False``, 0.5 where it is
    missing; a category has one 0/1 column per value. ``collapse`` is the coarser coding in which any
    value present is 1 and every category column is 1."""
    flags, values = attribute_names(items, **names)
    missing = F.lit(0.5)

    def flag(name: str) -> Column:
        value = F.col("attributes")[name]
        present = F.lit(1.0) if collapse else F.when(F.lower(value) == "false", 0.0).otherwise(1.0)
        return F.when(value.isNull(), missing).otherwise(present).alias(_column(name))

    def category(name: str, value: str) -> Column:
        hit = F.lit(1.0) if collapse else F.coalesce((F.col("attributes")[name] == value).cast("double"), F.lit(0.0))
        return hit.alias(_column(f"{name}_{value}"))

    rest = [c for c in items.columns if c != "attributes"]
    return items.select(*rest, *[flag(n) for n in flags], *[category(n, v) for n, v in values])


def top_categories(items: DataFrame, column: str = "categories", most: int = 100) -> DataFrame:
    """Items with a 0/1 column for each of the ``most`` commonest entries of a comma-separated list."""
    entries = items.select(F.explode(F.array_distinct(F.split(F.regexp_replace(column, " ", ""), ","))).alias("c")).where("c <> ''")
    top = [r["c"] for r in entries.groupBy("c").count().orderBy(F.col("count").desc(), "c").limit(most).collect()]
    own = F.split(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), " ", ""), ",")
    return items.select("*", *[F.array_contains(own, c).cast("int").alias(_column(f"category_{c}")) for c in top])


def assemble(rows: DataFrame, items: DataFrame, users: DataFrame, train: bool) -> DataFrame:
    """Rows (user, item, ...) with the columns of their item and user. In training, rows of unknown items
    go; in prediction they stay with nulls. Unknown users always stay."""
    return rows.join(items, "item", "inner" if train else "left").join(users, "user", "left")


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: how many nulls each column has."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def _filled(df: DataFrame, columns: list[str], missing: float) -> DataFrame:
    """Trees here take no missing values: a value outside the data stands in, with a flag beside it."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in columns}
    return df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in columns}).withColumns(filled)


def _stages(columns: list[str], label: str, trees: int, rate: float, seed: int, depth: int) -> tuple[VectorAssembler, GBTRegressor]:
    inputs = [*columns, *[f"{c}__missing" for c in columns]]
    return VectorAssembler(inputCols=inputs, outputCol="features"), GBTRegressor(labelCol=label, featuresCol="features", predictionCol="model", maxIter=trees, stepSize=rate, seed=seed, maxDepth=depth)


def fit_gbt(train: DataFrame, columns: list[str], label: str = "rating", trees: int = 100, rate: float = 0.1, seed: int = 1, depth: int = 5, missing: float = -1.0) -> PipelineModel:
    """Gradient-boosted regression trees. The same rows, in any order, and seed give the same model only
    with the same partitions; errors, not bits, are what two runs share."""
    return Pipeline(stages=list(_stages(columns, label, trees, rate, seed, depth))).fit(_filled(train, columns, missing))


def predict_gbt(model: PipelineModel, rows: DataFrame, columns: list[str], missing: float = -1.0) -> DataFrame:
    """Rows with the model's prediction in ``model``."""
    kept = [*rows.columns, "model"]
    return model.transform(_filled(rows, columns, missing)).select(*[F.col(c) for c in rows.columns if c not in columns], *[c for c in columns if c in kept], "model")


def search_gbt(train: DataFrame, columns: list[str], label: str = "rating", rates: tuple[float, ...] = (0.001, 0.01, 0.1), depths: tuple[int, ...] = (3, 4, 5), samples: tuple[float, ...] = (0.6, 0.8, 1.0), trees: int = 20, folds: int = 3, seed: int = 1) -> CrossValidatorModel:
    """Grid search over step, depth and subsampling by cross-validated RMSE."""
    assembler, gbt = _stages(columns, label, trees, 0.1, seed, 5)
    grid = ParamGridBuilder().addGrid(gbt.stepSize, list(rates)).addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.subsamplingRate, list(samples)).build()
    search = CrossValidator(estimator=Pipeline(stages=[assembler, gbt]), estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label, predictionCol="model"), numFolds=folds, seed=seed)
    return search.fit(_filled(train, columns, -1.0))
