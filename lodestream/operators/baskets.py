"""Baskets: which items go together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, items): the distinct items of each basket in order. Swap the two columns for baskets
    the other way round. Null items don't count; a null basket is one basket."""
    return rows.groupBy(F.col(basket).alias("basket")).agg(F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))


def sized_baskets(rows: DataFrame, basket: Column, item: Column, over: int) -> DataFrame:
    """As ``baskets``, of baskets with more than ``over`` rows, repeated items counted."""
    keyed = rows.select(basket.alias("basket"), item.alias("item"))
    grouped = keyed.groupBy("basket").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.where(F.col("n") > over).select("basket", "items", "n")


def day_customer(date: Column, customer: Column) -> Column:
    """A basket key from a date written as month/day/year with four digits: the year shortened to two,
    then the customer. ``11/1/2000`` and ``7`` give ``11/1/00-7``."""
    short = F.concat(F.left(date, F.length(date) - 4), F.right(date, F.lit(2)))
    return F.concat_ws("-", short, customer.cast("string"))


def plain_number(text: Column) -> Column:
    """A number's text without leading zeros; null if it is none."""
    return text.try_cast("bigint").cast("string")
