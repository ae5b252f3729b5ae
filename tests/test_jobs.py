"""Jobs from files to files, on tables small enough to check by hand."""

import csv
import json
import random

import pytest

from lodestream import jobs
from lodestream.functions.hashing import hash_family
from lodestream.sources.sampled import sampled_stream
from lodestream.streaming import sketches
from lodestream.streaming.tables import BloomTable


def run(spark, *arguments):
    assert jobs.main([str(a) for a in arguments], spark) == 0


def write(path, head, rows):
    path.write_text("\n".join([*([head] if head else []), *rows]) + "\n")
    return path


def table(path):
    with open(path, newline="") as f:
        return list(csv.DictReader(f))


def test_arguments_are_checked(spark, capsys):
    assert jobs.main([], spark) == jobs.main(["no-such"], spark) == jobs.main(["communities", "1"], spark) == 2
    said = capsys.readouterr().err
    assert all(name in said for name in jobs.JOBS) and "frequent-itemsets CASE SUPPORT IN_PATH OUT_PATH" in said


def test_itemset_reports(spark, tmp_path):
    rows = ["1,a", "1,b", "1,c", "2,a", "2,b", "3,a", "3,b", "3,c", "4,c", "4,c"]
    source = write(tmp_path / "in.csv", "user_id,business_id", rows)
    run(spark, "frequent-itemsets", 1, 2, source, tmp_path / "one.txt")
    lines = (tmp_path / "one.txt").read_text().split("\n")
    at = lines.index("Frequent Itemsets:")
    assert lines[0] == "Candidates:" and lines[at - 1] == ""
    assert lines[at + 1 : at + 6] == ["('a'),('b'),('c')", "", "('a', 'b'),('a', 'c'),('b', 'c')", "", "('a', 'b', 'c')"]
    run(spark, "frequent-itemsets", 2, 3, source, tmp_path / "two.txt")
    assert "('1'),('3')" in (tmp_path / "two.txt").read_text()
    days = write(tmp_path / "t.csv", "TRANSACTION_DT,CUSTOMER_ID,PRODUCT_ID", ["11/1/2000,7,007", "11/1/2000,7,8", "11/1/2000,7,8", "11/2/2000,7,7", "11/2/2000,7,8", "11/1/2000,9,7"])
    run(spark, "transaction-itemsets", 1, 2, days, tmp_path / "three.txt")
    assert (tmp_path / "three.txt").read_text().split("Frequent Itemsets:\n")[1] == "('7'),('8')\n\n('7', '8')\n"


def test_graph_reports(spark, tmp_path):
    near = {"a": "12", "b": "123", "c": "23", "d": "56", "e": "567", "f": "67"}
    both = [f"{u},{b}" for u, own in near.items() for b in own] + ["c,9", "d,9"]
    source = write(tmp_path / "in.csv", "user_id,business_id", both)
    run(spark, "communities", 1, source, tmp_path / "lpa.txt")
    assert set("abcdef") == set((tmp_path / "lpa.txt").read_text().replace("'", "").replace(", ", "").replace("\n", ""))
    run(spark, "betweenness", 1, source, tmp_path / "b.txt", tmp_path / "c.txt")
    assert (tmp_path / "b.txt").read_text().split("\n")[0] == "('c', 'd'),9.0"
    assert (tmp_path / "c.txt").read_text() == "'a', 'b', 'c'\n'd', 'e', 'f'\n"


def test_similar_items_and_predictions(spark, tmp_path):
    draw = random.Random(2)
    rows = sorted({(f"u{draw.randrange(20)}", f"b{draw.randrange(8)}") for _ in range(110)})
    train = write(tmp_path / "yelp_train.csv", "user_id,business_id,stars", [f"{u},{b},{draw.randint(1, 5)}.0" for u, b in rows[:-10]])
    test = write(tmp_path / "test.csv", "user_id,business_id,stars", [f"{u},{b},3.0" for u, b in rows[-10:]] + ["u1,new,1.0"])
    write(tmp_path / "business.json", None, [json.dumps({"business_id": f"b{i}", "review_count": i, "stars": 3.5, "attributes": {"WiFi": "free" if i % 2 else "no"}}) for i in range(8)])
    write(tmp_path / "user.json", None, [json.dumps({"user_id": f"u{i}", "review_count": i, "useful": 0, "funny": 0, "cool": 0, "fans": i, "average_stars": 3.0}) for i in range(20)])
    run(spark, "similar-items", train, tmp_path / "s.csv")
    raters = {}
    for u, b in rows[:-10]:
        raters.setdefault(b, set()).add(u)
    for r in table(tmp_path / "s.csv"):
        a, b = raters[r["business_id_1"]], raters[r["business_id_2"]]
        assert float(r["similarity"]) == pytest.approx(len(a & b) / len(a | b)) and len(a & b) >= len(a | b) / 2
    for name, first in (("predict-by-items", train), ("predict-by-model", tmp_path), ("predict-by-both", tmp_path)):
        run(spark, name, first, test, tmp_path / f"{name}.csv")
        out = table(tmp_path / f"{name}.csv")
        assert {(r["user_id"], r["business_id"]) for r in out} == {*rows[-10:], ("u1", "new")} and all(0 < float(r["prediction"]) < 6 for r in out)
    assert {r["prediction"] for r in table(tmp_path / "predict-by-items.csv") if r["business_id"] == "new"} == {"3.84"}


def test_cluster_report(spark, tmp_path):
    draw = random.Random(4)
    source = write(tmp_path / "p.txt", None, [f"{i},x,{draw.gauss(i % 2 * 50, 1)},{draw.gauss(0, 1)}" for i in range(120)])
    run(spark, "cluster-points", source, 2, tmp_path / "out.txt")
    lines = (tmp_path / "out.txt").read_text().split("\n")
    assert lines[0] == "The intermediate results:" and [x.split(":")[0] for x in lines[1:6]] == [f"Round {i}" for i in range(1, 6)]
    assert lines[6:8] == ["", "The clustering results:"] and [int(x.split(",")[0]) for x in lines[8:128]] == list(range(120))


def test_stream_reports(spark, tmp_path):
    source = write(tmp_path / "ids.txt", None, [f"e{i}" for i in range(60)])
    run(spark, "bloom-filter", source, 50, 3, tmp_path / "bloom.csv")
    assert [r["Time"] for r in table(tmp_path / "bloom.csv")] == ["0", "1", "2"] and float(table(tmp_path / "bloom.csv")[0]["FPR"]) >= 0
    run(spark, "distinct-counts", source, 50, 3, tmp_path / "fm.csv")
    assert [r["Time"] for r in table(tmp_path / "fm.csv")] == ["0", "1", "2"] and all(20 < int(r["Ground Truth"]) <= 50 for r in table(tmp_path / "fm.csv"))
    run(spark, "fixed-sample", source, 100, 3, tmp_path / "sample.csv")
    out = table(tmp_path / "sample.csv")
    assert [r["seqnum"] for r in out] == ["100", "200", "300"] and list(out[0]) == ["seqnum", "0_id", "20_id", "40_id", "60_id", "80_id"]


def test_filter_kept_as_tables_equals_the_relation(spark, tmp_path):
    family = hash_family(4, size=199, seed=3)
    table_ = BloomTable(str(tmp_path / "state"), family)
    query = sampled_stream(spark, [f"e{i}" for i in range(300)], 80, 5, seed=2).writeStream.foreachBatch(table_).start()
    query.processAllAvailable()
    query.stop()
    drawn = [(t * 80 + i + 1, t, e) for t in range(5) for i, e in enumerate(sample(t, 80, 300))]
    df = spark.createDataFrame(drawn, "seq long, tick long, element string")
    expected = [(r["tick"], r["fpr"]) for r in sketches.bloom_rates(df.select("seq", "element"), 80, family).orderBy("tick").collect()]
    assert [(r["tick"], r["fpr"]) for r in table_.rates(spark).orderBy("tick").collect()] == expected and expected[-1][1] > 0
    table_(df.where("tick = 4"), 4)
    assert [(r["tick"], r["fpr"]) for r in table_.rates(spark).orderBy("tick").collect()][:4] == expected[:4]


def sample(tick, size, lines):
    draw = random.Random(f"2:{tick}")
    return [f"e{draw.choice(range(lines))}" for _ in range(size)]
