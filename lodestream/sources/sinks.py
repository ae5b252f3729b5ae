"""Results as files. Each formatter makes a DataFrame of lines, so writing stays with the executors;
reports whose order matters are sorted, which one range exchange does."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(items: Column) -> Column:
    """``'a', 'b'``."""
    return F.concat(F.lit("'"), F.array_join(items, "', '"), F.lit("'"))


def itemset_lines(itemsets: DataFrame, title: str) -> DataFrame:
    """(section, length, line): a title, then one line per length with its itemsets as ``('a', 'b')``,
    comma-joined in order, single ones as ``('a')``."""
    shown = itemsets.select(F.size("itemset").alias("length"), "itemset", F.concat(F.lit("("), quoted(F.col("itemset")), F.lit(")")).alias("shown"))
    lines = shown.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("itemset", "shown"))).alias("own"))
    lines = lines.select(F.lit(title).alias("section"), "length", F.array_join(F.transform("own", lambda x: x["shown"]), ",").alias("line"))
    head = itemsets.sparkSession.createDataFrame([(title, 0, f"{title}:")], "section string, length int, line string")
    return head.unionByName(lines)


def itemset_report(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """The two sections of a report as text files, in order."""
    both = itemset_lines(candidates, "Candidates").unionByName(itemset_lines(frequent, "Frequent Itemsets"))
    both.orderBy("section", "length").select("line").write.mode("overwrite").text(path)


def itemset_report_file(candidates: DataFrame, frequent: DataFrame, path: str) -> None:
    """The two sections of a report as one text file, with a blank line before each length but the first and
    before the second section."""
    both = itemset_lines(candidates, "Candidates").unionByName(itemset_lines(frequent.select("itemset"), "Frequent Itemsets"))
    opens = (F.col("length") > 1) | ((F.col("length") == 0) & (F.col("section") != "Candidates"))
    blanks = both.where(opens).select("section", "length", F.lit(0).alias("at"), F.lit("").alias("line"))
    text_file(both.withColumn("at", F.lit(1)).unionByName(blanks).orderBy("section", "length", "at").select("line"), path)


def community_lines(communities: DataFrame) -> DataFrame:
    """Lines ``'a', 'b'`` of (members), by size, then first member."""
    return communities.orderBy(F.size("members"), F.col("members")[0]).select(quoted(F.transform("members", lambda m: m.cast("string"))).alias("line"))


def betweenness_lines(edges: DataFrame, digits: int = 5) -> DataFrame:
    """Lines ``('a', 'b'),0.5`` of (src, dst, betweenness), the largest first."""
    pair = F.concat(F.lit("("), quoted(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))), F.lit("),"))
    return edges.orderBy(F.col("betweenness").desc(), "src", "dst").select(F.concat(pair, F.round("betweenness", digits).cast("string")).alias("line"))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` for results that are known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def bfr_lines(rounds: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, at, line): the line of each round, then ``id,cluster`` of each point."""
    first = rounds.select(F.lit(0).alias("part"), F.col("round").cast("long").alias("at"), F.concat(F.lit("Round "), "round", F.lit(": "), F.concat_ws(",", "ds_points", "cs_clusters", "cs_points", "rs_points")).alias("line"))
    return first.unionByName(labels.select(F.lit(1).alias("part"), F.col("id").alias("at"), F.concat_ws(",", "id", "cluster").alias("line"))).orderBy("part", "at")


def appender(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each batch as CSV under its number. A batch that is replayed
    overwrites what it wrote, so each is there once."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")

    return write


def _one_file(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], head: Callable[[DataFrame, str], None] | None = None) -> None:
    """Write ``df`` in its order as one file at ``path``, in whatever file system that names: its partitions side by side, then
    one after another behind what ``head`` writes of no rows. Written beside it and renamed at the end, so that a reader never
    sees half of it."""
    spark, trial = df.sparkSession, f"{path}.{uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    files = make(path).getFileSystem(conf)

    def parts(folder: str) -> list:
        found = [f.getPath() for f in files.listStatus(make(folder)) if f.getPath().getName().startswith("part-")]
        return sorted(found, key=lambda p: (int(p.getName().split("-")[1]), p.getName()))

    write(df, f"{trial}/rows")
    own = parts(f"{trial}/rows")
    if head:
        head(df.limit(0).coalesce(1), f"{trial}/head")
        own = parts(f"{trial}/head") + own
    whole = own[0]
    if len(own) > 1:
        whole = make(f"{trial}/whole")
        out = files.create(whole)
        try:
            for part in own:
                lines = files.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(lines, out, 1 << 20, False)
                finally:
                    lines.close()
        finally:
            out.close()
    files.delete(make(path), True)
    files.rename(whole, make(path))
    files.delete(make(trial), True)


def text_file(lines: DataFrame, path: str) -> None:
    """A column of lines as one text file; for reports, which are read by people."""
    _one_file(lines, path, lambda df, p: df.write.text(p))


def csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with a header."""
    _one_file(df, path, lambda own, p: own.write.csv(p), lambda own, p: own.write.option("header", True).csv(p))


def collated(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """What ``appender`` wrote under ``path``, in order."""
    return spark.read.schema(schema).option("header", True).csv(path).select(*[c.split()[0] for c in schema.split(", ")]).orderBy(order)
