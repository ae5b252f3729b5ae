from collections import Counter
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import baskets as B
from lodestream.operators import itemsets as I

ROWS = [("u1", "a"), ("u1", "b"), ("u1", "c"), ("u1", "a"), ("u2", "a"), ("u2", "b"), ("u3", "a"), ("u3", "b"), ("u3", "c"), ("u4", "c"), ("u5", "a"), ("u6", "b"), ("u6", None)]


def brute(baskets, support, longest=9):
    counts = Counter(c for b in baskets for k in range(1, longest + 1) for c in combinations(sorted(set(b)), k))
    return {c: n for c, n in counts.items() if n >= support}


def got(df):
    return {tuple(r["itemset"]): r["support"] for r in df.collect()}


def test_baskets_both_ways(spark):
    rows = spark.createDataFrame(ROWS, "user string, item string")
    by_user = {r["basket"]: r["items"] for r in B.baskets(rows, "user", "item").collect()}
    assert by_user["u1"] == ["a", "b", "c"] and by_user["u6"] == ["b"]
    by_item = {r["basket"]: r["items"] for r in B.baskets(rows, "item", "user").collect()}
    assert by_item["a"] == ["u1", "u2", "u3", "u5"] and by_item[None] == ["u6"]


def test_itemsets_with_one_exactly_at_support(spark):
    b = B.baskets(spark.createDataFrame(ROWS, "user string, item string"), "user", "item")
    expected = brute([r["items"] for r in b.collect()], 2)
    assert expected[("a", "b", "c")] == 2
    assert got(I.frequent_itemsets(b, 2)) == expected
    assert got(I.frequent_itemsets(b, 3, 2)) == {k: v for k, v in expected.items() if v >= 3 and len(k) <= 2}
    assert got(I.son_itemsets(b, 2 / 6)) == expected


def test_no_baskets_and_empty_baskets(spark):
    none = spark.createDataFrame([], "basket string, items array<string>")
    assert got(I.frequent_itemsets(none, 1)) == {} and got(I.son_itemsets(none, 0.5)) == {}
    assert got(I.frequent_itemsets(spark.createDataFrame([("x", [])], none.schema), 1)) == {}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.sampled_from("abcdef")), min_size=1, max_size=12), st.integers(1, 4))
def test_both_plans_equal_brute_force(spark, sets, support):
    b = spark.createDataFrame([(str(i), sorted(s)) for i, s in enumerate(sets)], "basket string, items array<string>").repartition(3)
    expected = brute(sets, support)
    assert got(I.frequent_itemsets(b, support)) == expected
    assert got(I.son_itemsets(b, (support - 0.5) / len(sets))) == expected


def test_size_filter_counts_repeats_and_normalises(spark):
    rows = [("11/1/2000", "7", "0042")] * 3 + [("11/1/2000", "7", "5"), ("11/2/2000", "7", "1"), ("11/2/2000", "7", "2"), ("11/2/2000", "7", "x")]
    df = spark.createDataFrame(rows, "date string, customer string, product string")
    out = B.sized_baskets(df, B.day_customer(F.col("date"), F.col("customer")), B.plain_number(F.col("product")), 3).collect()
    assert [(r["basket"], r["items"], r["n"]) for r in out] == [("11/1/00-7", ["42", "5"], 4)]


@pytest.mark.parametrize("support", [1, 2])
def test_local_itemsets(support):
    baskets = [["a", "b", "c"], ["a", "b"], ["c"]]
    assert set(I.local_itemsets(baskets, support)) == set(brute(baskets, support))


def test_very_many_small_partitions_make_no_more_candidates(spark):
    rows = [(str(i), sorted({"a", "b", f"x{i % 50}"})) for i in range(600)] + [("long", [f"y{k:02d}" for k in range(16)])]
    b = spark.createDataFrame(rows, "basket string, items array<string>").repartition(300)
    candidates = I.son_candidates(b, 0.03)
    assert candidates.count() < 400 and got(I.son_itemsets(b, 0.03)) == brute([r[1] for r in rows[:-1]], 0.03 * 601)
    chunked = I.son_candidates(b, 0.5, chunk=20, least=2)
    assert {tuple(r["itemset"]) for r in chunked.collect()} >= {("a",), ("b",), ("a", "b")}
