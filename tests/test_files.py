import json

from lodestream.sources import readers, sinks


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,business_id,stars\nu,x,4.0\nv,y,1.5\n")
    assert [tuple(r) for r in readers.ratings(spark, f"{tmp_path}/r.csv").collect()] == [("u", "x", 4.0), ("v", "y", 1.5)]
    assert readers.rating_pairs(spark, f"{tmp_path}/r.csv").columns == ["user", "item"]
    (tmp_path / "s.csv").write_text("user_id,business_id\nu,x\n")
    assert readers.reviews(spark, f"{tmp_path}/s.csv").count() == 1
    (tmp_path / "t.csv").write_text('TRANSACTION_DT,CUSTOMER_ID,PRODUCT_ID\n11/1/2000,7,"00\n42"\n')
    assert readers.transactions(spark, f"{tmp_path}/t.csv").first()["PRODUCT_ID"] == "00\n42"
    (tmp_path / "b.json").write_text(json.dumps({"business_id": "x", "review_count": 3, "stars": 4.5, "attributes": {"WiFi": "free"}, "other": 1}) + "\n" + json.dumps({"business_id": "y", "attributes": None}) + "\n")
    assert [(r["item"], r["attributes"]) for r in readers.businesses(spark, f"{tmp_path}/b.json").collect()] == [("x", {"WiFi": "free"}), ("y", None)]
    (tmp_path / "u.json").write_text(json.dumps({"user_id": "u", "review_count": 3, "fans": 2, "average_stars": 3.5}) + "\n")
    assert readers.users(spark, f"{tmp_path}/u.json").first()["u_star"] == 3.5
    (tmp_path / "p.txt").write_text("3,a,1.5,2\n4,b,0,-1\n")
    assert [(r["id"], r["features"]) for r in readers.points(spark, f"{tmp_path}/p.txt").collect()] == [(3, [1.5, 2.0]), (4, [0.0, -1.0])]
    (tmp_path / "e.txt").write_text("x\ny\nz\n")
    assert sorted(tuple(r) for r in readers.elements(spark, f"{tmp_path}/e.txt").collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_reports(spark, tmp_path):
    sets = spark.createDataFrame([(["b"],), (["a"],), (["a", "b"],)], "itemset array<string>")
    sinks.itemset_report(sets, sets.limit(0), f"{tmp_path}/out")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["Candidates:", "('a'),('b')", "('a', 'b')", "Frequent Itemsets:"]
    communities = spark.createDataFrame([(["c", "d"],), (["a"],)], "members array<string>")
    assert [r[0] for r in sinks.community_lines(communities).collect()] == ["'a'", "'c', 'd'"]
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 2.0)], "src string, dst string, betweenness double")
    assert [r[0] for r in sinks.betweenness_lines(edges).collect()] == ["('b', 'c'),2.0", "('a', 'b'),0.5"]
    sinks.write_csv(edges, f"{tmp_path}/csv", one_file=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    rounds = spark.createDataFrame([(1, 2, 3, 4, 5)], "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")
    labels = spark.createDataFrame([(9, -1)], "id long, cluster int")
    assert [r["line"] for r in sinks.bfr_lines(rounds, labels).collect()] == ["Round 1: 2,3,4,5", "9,-1"]


def test_appender_overwrites_a_replayed_batch(spark, tmp_path):
    write = sinks.appender(f"{tmp_path}/log")
    for _ in range(2):
        write(spark.createDataFrame([(0, 0.5)], "tick int, fpr double"), 0)
    write(spark.createDataFrame([(1, 0.25)], "tick int, fpr double"), 1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/log").count() == 2


def test_one_file_is_written_by_several_tasks_and_in_order(spark, tmp_path):
    rows, tasks = spark.range(3000).selectExpr("id * 7919 % 3000 AS a", "concat('x, ', id) AS `b c`"), []
    sinks._one_file(rows.repartition(3), f"{tmp_path}/one", lambda own, p: tasks.append(own.rdd.getNumPartitions()) or own.write.csv(p))
    assert tasks == [3]
    for _ in range(2):
        sinks.csv_file(rows.repartitionByRange(5, "a").sortWithinPartitions("a"), f"{tmp_path}/r.csv")
        lines = (tmp_path / "r.csv").read_text().split("\n")
        assert lines[:2] == ["a,b c", '0,"x, 0"'] and lines[-1] == "" and [int(x.split(",")[0]) for x in lines[1:-1]] == list(range(3000))
    sinks.csv_file(rows.limit(0), f"{tmp_path}/none.csv")
    sinks.text_file(rows.where("a < 0").select("b c"), f"{tmp_path}/none.txt")
    assert (tmp_path / "none.csv").read_text() == "a,b c\n" and (tmp_path / "none.txt").read_text() == ""
    assert sorted(p.name for p in tmp_path.iterdir() if p.name[0] != ".") == ["none.csv", "none.txt", "one", "r.csv"]
