"""The stages on a small corpus, each judged on its own input, and on tables that are awkward or empty."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestream.llm import mixing, packing, secrets, toxicity

from .test_operators import LONG, classes, edited, prose, toxic_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    draw = random.Random(9)
    texts = {i: t for i, t, _ in toxic_rows(260, 6)}
    texts |= {300 + i: edited(texts[i], 70, i) for i in range(12)} | {330: texts[5], 331: LONG, 332: "", 333: None, 334: "token = abcdefgh12345678 " + prose(40, 1), 335: "x" * 3000}
    rows = [(i, t, None if i % 7 == 0 else "en", draw.choice(["a", "b", "c", None]), None if t is None else len(t), "mine") for i, t in texts.items()]
    spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, bad) for i, _, bad in toxic_rows(260, 6)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_every_stage_does_its_work_on_what_it_gets(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out, before = spark.read.parquet(f"{tmp_path}/{k}"), docs.collect()
        after = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and {r["taken"] for r in after} == {"mine"}
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            low = [r for r in before if toxicity.score_texts(model, [r["text"]])[0][0] < 0.7]
            assert sorted(map(repr, after)) == sorted(map(repr, low)) and 0 < len(low) < len(before)
        elif name == "near_dedup":
            label = classes([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted(set(label.values()))
        elif name == "secrets":
            text = {r["doc_id"]: r["text"] for r in after}
            assert len(after) == len(before)
            assert text[334].startswith("[SECRET] ") and not re.search(secrets.KINDS["assign"][0], text[334])
            assert all(text[r["doc_id"]] == r["text"] for r in before if r["doc_id"] != 334)
        elif name == "mixing":
            sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
            wanted = {r["source"]: int(r["target"]) for r in mixing.mix(sized).collect()}
            got = dict.fromkeys(wanted, 0)
            for r in after:
                got[r["source"]] += len(r["text"].split())
            assert got == wanted
        else:
            encode = packing.encoder(packing.default_tokenizer())
            assert sum(r["length"] for r in after) == sum(len(encode(r["text"] or "")) + 1 for r in before)
        docs = out


def test_run_is_the_stages_in_a_row(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    ends = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end OR n > 2048").count() == 0


def test_no_documents_at_all(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
