import math
import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import recommend as R
from lodestream.operators import similarity as S

SETS = {"a": {1, 2, 3}, "b": {2, 3}, "c": {3, 4, 5, 6}, "d": {1, 2}, "e": {9}, "f": {1, 2, 3}}


def frame(spark, sets):
    return spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "id string, element long")


def brute(sets, least):
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) > 0}


@pytest.mark.parametrize("least", [0.2, 0.5, 2 / 3, 1.0])
def test_join_is_exact_at_and_above_the_threshold(spark, least):
    assert {(r[0], r[1]): r[2] for r in S.jaccard_join(frame(spark, SETS), least).collect()} == pytest.approx(brute(SETS, least))


def test_join_on_random_sets(spark):
    draw = random.Random(5)
    sets = {f"s{i}": set(draw.sample(range(30), draw.randint(1, 12))) for i in range(60)}
    found = {(r[0], r[1]): r[2] for r in S.jaccard_join(frame(spark, sets), 0.4).collect()}
    assert found == pytest.approx(brute(sets, 0.4))
    lsh = {(r[0], r[1]): r[2] for r in S.lsh_join(frame(spark, sets), 0.4).collect()}
    assert lsh.items() <= found.items() and len(lsh) >= 0.9 * len(found)


@pytest.mark.parametrize("products", [0, 1e9])
def test_frequent_elements_and_copies_make_few_rows(spark, monkeypatch, products):
    """Copies of sets of frequent elements are one set in the join, and blocks and rows find the same pairs."""
    monkeypatch.setattr(S, "PRODUCTS", products)
    monkeypatch.setattr(S, "BLOCK", 7)
    draw, joined = random.Random(6), []
    kinds = [frozenset(draw.sample(range(20), draw.randint(6, 14))) for _ in range(25)]
    sets = {f"s{i:03}": kinds[i % 25] for i in range(200)}
    plain = S._classes_join
    monkeypatch.setattr(S, "_classes_join", lambda classes, least: joined.append(classes.count()) or plain(classes, least))
    found = [tuple(r) for r in S.jaccard_join(frame(spark, sets), 0.5).collect()]
    assert joined == [len(set(kinds))]
    assert {(a, b): s for a, b, s in found} == pytest.approx(brute(sets, 0.5)) and len(found) == len(brute(sets, 0.5))
    if products:
        lsh = [tuple(r) for r in S.lsh_join(frame(spark, sets), 0.5).collect()]
        monkeypatch.setattr(S, "HEAVY", 1e9)
        assert sorted(lsh) == sorted(tuple(r) for r in S.lsh_join(frame(spark, sets), 0.5).collect())


def test_numbers_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(x,) for x in ("b", "a", "d", "b", None)], "v string")
    assert sorted(tuple(r) for r in S.numbered(df, "v").collect()) == [("a", 0), ("b", 1), ("d", 2)]


def ratings(spark, rows):
    return spark.createDataFrame(rows, "user string, item string, rating double")


def test_pearson_edges(spark):
    rows = [("u", "x", 1.0), ("v", "x", 3.0), ("w", "x", 5.0), ("u", "y", 2.0), ("v", "y", 2.0), ("w", "y", 5.0), ("u", "k", 4.0), ("v", "k", 4.0), ("z", "o", 1.0), ("u", "s", 5.0)]
    found = {(r["item_a"], r["item_b"]): (r["corr"], r["n"]) for r in R.item_pearson(ratings(spark, rows)).collect()}
    assert found[("x", "y")] == (pytest.approx(6 / math.sqrt(8 * 6)), 3)
    assert found[("k", "x")] == (0.0, 2)  # constant
    assert found[("s", "x")] == (0.0, 1)  # one common user
    assert not any("o" in pair for pair in found)  # none


def brute_cf(train, test):
    mean = {}
    for u, i, r in train:
        mean.setdefault((u, i), []).append(r)
    rated = {k: sum(v) / len(v) for k, v in mean.items()}
    users = {u for u, _ in rated}
    by_item = {i: {u: r for (u, j), r in rated.items() if j == i} for _, i in rated}
    out = {}
    for u, i in set(test):
        if i not in by_item:
            out[u, i] = 3.84
            continue
        avg = sum(by_item[i].values()) / len(by_item[i])
        top = weight = 0.0
        near = [j for v, j in rated if v == u] if u in users else []
        for j in near:
            common = by_item[i].keys() & by_item[j].keys()
            a, b = [by_item[i][v] for v in common], [by_item[j][v] for v in common]
            w = 0.0
            if common:
                ma, mb = sum(a) / len(a), sum(b) / len(b)
                spread = math.sqrt(sum((x - ma) ** 2 for x in a) * sum((x - mb) ** 2 for x in b))
                w = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / spread if spread > 1e-9 else 0.0
            if w > 1e-12 or (w < -1e-12 and len(near) < 10):
                s = abs(w) ** 2.5
                top += s * (rated[u, j] if w > 0 else 6 - rated[u, j])
                weight += s
        out[u, i] = (top / weight + avg) / 2 if weight else avg
    return out


def test_predictions_equal_a_plain_computation(spark):
    draw = random.Random(3)
    train = [(f"u{draw.randrange(12)}", f"i{draw.randrange(14)}", float(draw.randint(1, 5))) for _ in range(160)]
    test = [(f"u{draw.randrange(14)}", f"i{draw.randrange(16)}") for _ in range(60)]
    out = R.predict_item_cf(ratings(spark, train), spark.createDataFrame(test, "user string, item string")).collect()
    assert {(r["user"], r["item"]): r["prediction"] for r in out} == pytest.approx(brute_cf(train, test))
    n = {r["user"]: r["n"] for r in out}
    assert all(v == 0 for u, v in n.items() if u in ("u12", "u13"))
    sizes = [len({i for v, i, _ in train if v == u}) for u in {t[0] for t in test}]
    assert min(sizes) < 10 <= max(sizes)  # both rules for negative weights are met


def test_an_item_can_be_kept_from_its_own_neighbours_and_predictions_clipped(spark):
    draw = random.Random(5)
    train = sorted({(f"u{draw.randrange(9)}", f"i{draw.randrange(9)}"): (f"u{0}", "", 0.0) for _ in range(70)})
    train = [(u, i, float(draw.randint(1, 5))) for u, i in train]
    asked = spark.createDataFrame([(u, i) for u, i, _ in train[:25]] + [("u1", "i8")], "user string, item string")
    plain = {(r["user"], r["item"]): r["n"] for r in R.predict_item_cf(ratings(spark, train), asked).collect()}
    other = {(r["user"], r["item"]): r["n"] for r in R.predict_item_cf(ratings(spark, train), asked, exclude_self=True).collect()}
    rated = {(u, i) for u, i, _ in train}
    assert other == {k: n - (k in rated) for k, n in plain.items()}
    clipped = [r["prediction"] for r in R.predict_item_cf(ratings(spark, train), asked, clip=(2.5, 3.0)).collect()]
    assert len(clipped) == len(plain) and all(2.5 <= p <= 3.0 for p in clipped)


def test_blends(spark):
    cf = spark.createDataFrame([("u", "a", 5.0, 20), ("u", "b", 5.0, 21), ("v", "a", 5.0, 3), ("v", "b", 5.0, 0)], "user string, item string, prediction double, n long")
    model = cf.select("user", "item", F.lit(1.0).alias("model"))
    assert {(r[0], r[1]): r[2] for r in R.hybrid(cf, model).collect()} == pytest.approx({("u", "a"): 1.04, ("u", "b"): 1.8, ("v", "a"): 1.04, ("v", "b"): 1.04})
    assert {(r[0], r[1]): r[2] for r in R.tiered_hybrid(cf, model).collect()} == pytest.approx({("u", "a"): 3.0, ("u", "b"): 3.0, ("v", "a"): 1.4, ("v", "b"): 1.0})


def test_set_joins_read_their_sets_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    rows = [(i, j) for i in range(40) for j in range(i % 7, i % 7 + 5)]
    for join in (S.jaccard_join, S.lsh_join):
        before = seen.value
        sets = spark.createDataFrame(rows, "id long, element long").mapInPandas(counted, "id long, element long")
        pairs = join(sets, 0.5).where(F.col("id_1") % 7 == F.col("id_2") % 7).count()
        assert pairs == sum(1 for a in range(40) for b in range(a) if a % 7 == b % 7)
        assert seen.value - before == len(rows)


@pytest.mark.parametrize("least", [0.1, 1 / 3, 0.5, 1.0])
def test_pairs_of_blocks_are_dealt_out_and_exact(spark, monkeypatch, least):
    draw = random.Random(7)
    sets = {i: set(draw.sample(range(24), draw.randint(1, 20))) for i in range(150)}
    sets = {i: s for i, s in sets.items() if all(s != t for j, t in sets.items() if j < i)}
    for name, value in (("BLOCK", 16), ("ROWS", 5), ("MOST_HITS", 3)):
        monkeypatch.setattr(S, name, value)
    classes = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<long>")
    numbers = spark.createDataFrame([(e, e) for e in range(24)], "element long, number long")
    found = S._blocked_join(classes, numbers, len(sets), 24, least)
    expected = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(r[0], r[1]): r[2] for r in found.collect()} == {p: v for p, v in expected.items() if v >= least}
    assert found.rdd.getNumPartitions() >= 4
