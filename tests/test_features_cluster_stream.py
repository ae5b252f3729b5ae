import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions.hashing import bytes_mod, hash_family, hashed, trailing_zeros
from lodestream.operators import cluster as C
from lodestream.operators import features as X
from lodestream.sources.sampled import sampled_stream
from lodestream.streaming import sketches as K
from lodestream.streaming import stateful as T


def test_attributes(spark):
    rows = [("x", {"Wifi": "False", "WiFi": "free", "Music": "loud"}), ("y", {"Wifi": "True", "WiFi": None}), ("z", None)]
    out = X.featurize_items(spark.createDataFrame(rows, "item string, attributes map<string,string>")).collect()
    assert [r.asDict() for r in sorted(out)] == [{"item": "x", "Wifi": 0.0, "WiFi_free": 1.0}, {"item": "y", "Wifi": 1.0, "WiFi_free": 0.0}, {"item": "z", "Wifi": 0.5, "WiFi_free": 0.0}]
    coarse = X.featurize_items(spark.createDataFrame(rows, "item string, attributes map<string,string>"), collapse=True).collect()
    assert [r["Wifi"] for r in sorted(coarse)] == [1.0, 1.0, 0.5]


def test_unknown_items_go_in_training_only(spark):
    rows = spark.createDataFrame([("u", "x", 1.0), ("v", "q", 2.0), ("w", "x", 3.0)], "user string, item string, rating double")
    items = spark.createDataFrame([("x", 7)], "item string, b int")
    users = spark.createDataFrame([("u", 9)], "user string, f int")
    assert {r["user"] for r in X.assemble(rows, items, users, True).collect()} == {"u", "w"}
    out = X.assemble(rows, items, users, False)
    assert {(r["user"], r["b"], r["f"]) for r in out.collect()} == {("u", 7, 9), ("v", None, None), ("w", 7, None)}
    assert X.missing_counts(out).first().asDict() == {"item": 0, "user": 0, "rating": 0, "b": 1, "f": 2}


def test_top_categories(spark):
    df = spark.createDataFrame([("a", "Food, Bars"), ("b", "Food"), ("c", None)], "item string, categories string")
    assert [r["category_Food"] for r in X.top_categories(df, most=1).orderBy("item").collect()] == [1, 1, 0]


def test_trees_beat_the_mean(spark):
    draw = random.Random(2)
    rows = [(i, "i", float(x > 5) * 3 + draw.random(), float(x) if draw.random() > 0.1 else None) for i, x in ((i, draw.uniform(0, 10)) for i in range(400))]
    df = spark.createDataFrame(rows, "user long, item string, rating double, f double").coalesce(1)
    out = X.predict_gbt(X.fit_gbt(df, ["f"], trees=5), df, ["f"])
    mean = df.agg(F.avg("rating")).first()[0]
    rmse = lambda c: out.agg(F.sqrt(F.avg(F.pow(F.col("rating") - c, 2)))).first()[0]
    assert rmse(F.col("model")) < 0.7 * rmse(F.lit(mean))


def test_grid_search_finds_the_deeper_trees(spark):
    draw = random.Random(3)
    rows = [(i, float((x > 2) + (x > 4) * 2 + (x > 6) * 3 + (x > 8) * 5), x) for i, x in ((i, draw.uniform(0, 10)) for i in range(200))]
    df = spark.createDataFrame(rows, "user long, rating double, f double").coalesce(1)
    found = X.search_gbt(df, ["f"], rates=(0.1,), depths=(1, 3), samples=(1.0,), trees=2, folds=2)
    assert len(found.avgMetrics) == 2 and found.avgMetrics[1] < found.avgMetrics[0]
    assert found.bestModel.stages[-1].getMaxDepth() == 3 and X.predict_gbt(found.bestModel, df, ["f"]).where("model IS NULL").isEmpty()


def test_nearest_cluster_is_the_same_in_blocks(spark):
    draw = random.Random(8)
    points = spark.createDataFrame([(i, i % 30, [draw.gauss(i % 30, 1), draw.gauss(0, 1)]) for i in range(300)], "id long, cluster int, features array<double>")
    s = C.summaries(points).cache()
    assert sorted(C.nearest_within(points.drop("cluster"), s).collect()) == sorted(C.nearest_within(points.drop("cluster"), s, most=7).collect())


def test_reclustered_points_go_to_a_near_compression_cluster(spark, monkeypatch):
    near = [(i, [100.0 + i % 3, 50.0 + i % 2]) for i in range(6)]
    state = C.BFR(2)
    points = lambda rows: spark.createDataFrame(rows, "id long, features array<double>")
    monkeypatch.setattr(C, "k_means", lambda own, k, seed: own.withColumn("cluster", F.lit(0)))
    state._recluster(points(near))
    assert (state.compressed.count(), state.small.count()) == (1, 6)
    state._recluster(points([(10, [101.0, 50.5]), (11, [500.0, 1.0]), (12, [501.0, 2.0])]))
    assert state.compressed.count() == 2 and state.retained.count() == 0
    names = {r["id"]: r["cluster"] for r in state.small.collect()}
    assert names[10] == names[0] != names[11] == names[12] and state.compressed.agg(F.sum("n")).first()[0] == 9


def test_merging_keeps_every_point_and_fewer_small_clusters(spark):
    draw = random.Random(6)
    rows = [(i, [draw.gauss(10 * (i % 3), 1), draw.gauss(0, 1)]) for i in range(240)] + [(1000 + i, [90 + draw.gauss(0, 8), draw.gauss(90, 8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    plain, merged = C.bfr(df, 3, rounds=3), C.bfr(df, 3, rounds=3, merge=True)
    for labels, rounds in (plain, merged):
        last = rounds.orderBy("round").collect()[-1]
        assert labels.count() == labels.select("id").distinct().count() == 280 == last["ds_points"] + last["cs_points"] + last["rs_points"]
    clusters = [r.orderBy("round").collect()[-1]["cs_clusters"] for _, r in (plain, merged)]
    assert clusters[1] <= clusters[0]


def test_distance_gate_is_strict_and_needs_variance(spark):
    points = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [2.0, 2.0]), (3, 1, [5.0, 5.0]), (4, 1, [5.0, 7.0])], "id long, cluster int, features array<double>")
    s = C.summaries(points)
    assert {(r["cluster"], r["n"], tuple(r["total"]), tuple(r["squares"])) for r in s.collect()} == {(0, 2, (2.0, 2.0), (4.0, 4.0)), (1, 2, (10.0, 12.0), (50.0, 74.0))}
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, [3.0, 3.0]), (9, [2.9, 3.0])], "id long, features array<double>")
    found = {r["id"]: (r["cluster"], r["distance"]) for r in C.nearest_within(asked, s).collect()}
    assert found[7] == (0, 0.0) and 8 not in found and found[9][0] == 0  # 8 is at exactly twice the root of 2


def test_bfr_keeps_every_point_once(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(10 * (i % 3), 1), draw.gauss(0, 1)]) for i in range(300)] + [(1000 + i, [200.0 * (i + 1), -300.0 * i]) for i in range(3)]
    labels, rounds = C.bfr(spark.createDataFrame(rows, "id long, features array<double>"), 3, rounds=3)
    got = {r["id"]: r["cluster"] for r in labels.collect()}
    assert len(got) == labels.count() == 303 and set(got.values()) <= {-1, 0, 1, 2}
    assert sum(got[i] >= 0 for i in range(300)) > 240
    last = rounds.orderBy("round").collect()[-1]
    assert last["ds_points"] + last["cs_points"] + last["rs_points"] == 303


def test_small_clusters_are_half_as_many_as_loose_points(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(C, "k_means", lambda points, k, seed: (asked.append(k), points.withColumn("cluster", F.col("id")))[1])
    C.BFR(3)._recluster(spark.range(4000).withColumn("features", F.array(F.lit(0.0))))
    assert asked == [2001]


def test_clustering_queries_see_whole_vectors(spark, tmp_path):
    from lodestream.plans import registry

    rows = [(i, i % 4, [0.0] * 8 + [100.0 * (i % 4)] * 8) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {len(r["features"]) for r in registry._points(spark, str(tmp_path)).collect()} == {16}
    labels = {r["id"]: r["cluster"] for r in registry.bfr_labels(spark, str(tmp_path)).collect()}
    assert len(labels) == 100 and len({c for c in labels.values() if c >= 0}) == 4


@pytest.mark.parametrize("text", ["8812", "é", "", "mixed-日本-ids"])
def test_bytes_as_one_integer(spark, text):
    p = 1_048_573
    out = spark.createDataFrame([(text,)], "t string").select(bytes_mod(F.col("t"), F.lit(p).cast("long"))).first()[0]
    assert out == int.from_bytes(text.encode(), "big") % p


def test_trailing_zeros(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (8,), (12,)], "x long").select(trailing_zeros(F.col("x"))).collect()] == [1, 0, 3, 2]


def sequential(words, size, family):
    bits, seen, fp, n, rates = set(), set(), 0, 0, []
    for i, w in enumerate(words):
        own = {((a * int.from_bytes(w.encode(), "big") + b) % p) % family.size for a, b, p in family.params}
        if w not in seen:
            n += 1
            fp += own <= bits
        seen.add(w)
        bits |= own
        if (i + 1) % size == 0:
            rates.append(fp / n)
    return rates


def test_bloom_equals_a_one_by_one_filter(spark):
    draw = random.Random(6)
    words = [str(draw.randrange(400)) for _ in range(600)]
    family = hash_family(4, size=211, seed=3)
    df = spark.createDataFrame(list(enumerate(words, 1)), "seq long, element string")
    assert [r["fpr"] for r in K.bloom_rates(df, 50, family).orderBy("tick").collect()] == pytest.approx(sequential(words, 50, family))


def estimated(words, family, groups=3):
    tail = lambda x: len(bin(x)) - len(bin(x).rstrip("0")) if x else 1
    most = [max(tail(((a * int.from_bytes(w.encode(), "big") + b) % p) % family.size) for w in words) for a, b, p in family.params]
    part = len(most) // groups
    return int(sorted(sum(2**m for m in most[g * part : (g + 1) * part]) / part for g in range(groups))[groups // 2])


def test_distinct_estimates(spark):
    words = [str(i % 40) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(words, 1)), "seq long, element string")
    family = hash_family(48, seed=5)
    out = K.flajolet_martin(df, 200, family)
    assert [(r["truth"], r["estimate"]) for r in out.collect()] == [(40, estimated(words[:200], family))] * 2
    assert K.accuracy(out).first()[0] == pytest.approx(40 / estimated(words[:200], family))
    assert {r["truth"] for r in K.flajolet_martin_by_element(df, 200, family).collect()} == {40}


def replayed(words, slots=100):
    uniform = lambda x, m, c: ((x % 1_000_003) * m + c) % 2_147_483_648 / 2_147_483_648
    held = [None] * slots
    for seq, w in enumerate(words, 1):
        if seq <= slots:
            held[seq - 1] = w
        elif uniform(seq, 1_103_515_245, 12_345) * seq < slots:
            held[int(uniform(seq, 69_069, 1) * slots)] = w
    return held


@pytest.mark.parametrize("n", [60, 100, 1050])
def test_reservoir_equals_a_one_by_one_sample(spark, n):
    words = [f"e{i}" for i in range(n)]
    df = spark.createDataFrame(list(enumerate(words, 1)), "seq long, element string")
    held = replayed(words)
    assert {r["slot"]: r["element"] for r in K.reservoir(df).collect()} == {i: w for i, w in enumerate(held) if w}
    ends = [r["seqnum"] for r in K.reservoir_snapshots(df, 150).orderBy("seqnum").collect()]
    assert ends == [e for e in sorted({*range(150, n + 1, 150), n}) if e % 100 == 0]


def run(spark, out, name, mode="append"):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_streams_hold_what_the_relations_say(spark):
    lines = [f"e{i}" for i in range(50)]
    family = hash_family(4, size=997, seed=3)
    stream = lambda: sampled_stream(spark, lines, size=100, asks=4, seed=9)
    rows = run(spark, stream(), "drawn")
    assert len(rows) == 400 and {r["seq"] for r in rows} == set(range(1, 401))
    df = spark.createDataFrame(rows, "seq long, tick long, element string").select("seq", "element")
    sample = {r["seqnum"]: r["sample"] for r in run(spark, T.stream_reservoir(stream()), "sample")}
    last = {r["slot"]: r["element"] for r in K.reservoir(df).collect()}
    assert sample[400] == [last[i] for i in range(100)]
    bloom = run(spark, T.stream_bloom(stream(), family), "bloom")
    firsts = K.bloom_first_seen(df, family)
    assert sum(r["fresh"] for r in bloom) == firsts.where("NOT false_positive").count() and sum(r["repeats"] + r["fresh"] for r in bloom) == 400
    fm = hash_family(48, seed=5)
    estimates = {r["tick"]: r["estimate"] for r in run(spark, T.stream_distinct(stream(), fm), "fm", "complete")}
    assert estimates == {r["tick"]: r["estimate"] for r in K.flajolet_martin(df, 100, fm).collect()}


def test_hash_family_is_fixed():
    family = hash_family(3, seed=1)
    assert family == hash_family(3, seed=1) != hash_family(3, seed=2)
    assert all(2**19 <= p and all(p % d for d in range(2, 1200) if d * d <= p) for _, _, p in family.params)


def test_hashed_is_the_family(spark):
    family = hash_family(5, seed=4)
    out = spark.createDataFrame([("abc",)], "t string").select(hashed(F.col("t"), family)).first()[0]
    x = int.from_bytes(b"abc", "big")
    assert out == [((a * x + b) % p) % family.size for a, b, p in family.params]
