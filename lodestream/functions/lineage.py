"""Cutting the lineage of plans of several steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch that deletes an execution's shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Only where it is
    unset and driver and executors are one process (tests, one machine) is a temporary one made and set."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lodestream-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: computed once, so that what follows does not
    replay what came before it and survives lost executors. What its plan has shuffled is deleted
    once it is written, as nothing can ask for it again."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)
