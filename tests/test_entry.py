"""Every query against its SQL on the smallest tables."""

import glob
import os
import warnings
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__ as entry
from lodestream.functions.lineage import checkpoint_dir
from lodestream.plans import files, oracles, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    assert rows({**registry.QUERIES, **files.QUERIES}[name](spark, DATA).toPandas()) == rows(con.execute(oracles.ORACLES[name]).df())


@pytest.mark.parametrize(("gone", "left"), [("lodestream.llm.registry", set()), ("corpus_pipeline", {"op0_some"}), (None, {"op0_some", "pipeline"})])
def test_what_cannot_be_imported_is_left_out(monkeypatch, gone, left):
    run = lambda spark, sf_dir: None
    modules = {"lodestream.llm.registry": SimpleNamespace(QUERIES={"op0_some": run}, ORACLES={"op0_some": "SELECT 1"}), "corpus_pipeline": SimpleNamespace(run=run, ORACLE_SQL=None)}

    def find(name):
        if name == gone:
            raise ImportError(f"no {name}")
        return modules[name]

    monkeypatch.setattr(entry.importlib, "import_module", find)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert set(entry.queries()) == {*registry.QUERIES, *files.QUERIES, *left} and set(entry.oracle_sql()) == {*oracles.ORACLES, *(left & {"op0_some"})}
    assert [gone in str(w.message) for w in said] == [True, True] * (gone is not None)


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    set_ = []
    made = lambda master, path: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: path), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=set_.append))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(made("spark://somewhere:7077", None))
    assert checkpoint_dir(made("spark://somewhere:7077", "hdfs:///shared")) == "hdfs:///shared" == set_[-1]
    assert os.path.isdir(checkpoint_dir(made("local[4]", None)))


def test_contract(spark):
    assert entry.entry(spark).columns == ["length", "itemset", "support"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("gbt_predictions", "hybrid_predictions"):
        assert entry.queries()[name](spark, DATA).count() > 0
