"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir, which the driver and all executors see.

    On a cluster that setting must be there. A session whose tasks run in the driver's own process, as in tests, gets
    a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="demandlens-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder as a table and read them back."""
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Just the named columns of a documents table; other columns, clashing or not, are left out.

    A column that is missing is null. doc_id is read as a long, text columns as strings.
    """
    have = set(docs.columns)
    kinds = {"doc_id": "long", "conv_id": "long", "turn": "long", "item_id": "long"}
    return docs.select(
        *((F.col(f"`{n}`") if n in have else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names)
    )


def id_crc(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, order: list[Column], value: str, tag: str) -> DataFrame:
    """Write df to the shared folder in the order given and read it back with ``start``, the sum of ``value`` over all rows before.

    The rows are dealt by range, sorted within each partition and summed there; only the sums, one row for
    each partition, meet in one task. A partition's number is kept as ``part``.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), tag)
    sums = placed.groupBy("part").agg(F.sum(value).alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))
    upto = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(before), "part").withColumn("start", F.col("base") + F.coalesce(F.sum(value).over(upto), F.lit(0))).drop("base")


def components(edges: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (a long, b long): rows (node, root), root the least node.

    Alternating large-star and small-star steps; every step is a min per node and a join, so a hub is
    pre-aggregated before its shuffle and its join partition can be split. The edges of every round are
    written to the shared folder; the rounds end when their count and checksum stay. Self loops are ignored.
    Nodes without an edge have no row.
    """

    def state(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())

    edges = stored(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), tag)
    now = state(edges)
    for _ in range(max_rounds):
        if not now[0]:
            return edges.selectExpr("a AS node", "b AS root")
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        after = stored(
            large.join(low2, "a").selectExpr("b AS a", "m AS b").union(low2.selectExpr("a", "m AS b")).where("a <> b").distinct(), tag
        )
        before, now, edges = now, state(after), after
        if now == before:
            return edges.selectExpr("a AS node", "b AS root").union(edges.selectExpr("b AS node", "b AS root").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
