"""Session construction and table loading."""

from __future__ import annotations

import os
import re
import tempfile
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "demandlens", cpus: int | None = None, partitions: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from the caller."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = CONF | {
        "spark.sql.shuffle.partitions": str(partitions or cpus),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (conf | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of stored tables that ask for one part of a keyed step, about half a million rows of links.
PART_BYTES = 8 << 20


def parts_for(df: DataFrame) -> int:
    """How many parts the files that df is made of ask for; 0 if the session's cores take them in one go. Only their sizes are read."""
    files, spark = df.inputFiles(), df.sparkSession
    if not files:
        return 0
    paths = [re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(f)) for f in files]  # as they are named, patterns taken as names
    size = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0] or 0
    parts = -(-size // PART_BYTES)
    return parts if parts > spark.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The rows dealt by keys into so many parts (0: as they are), so that what a task groups or sorts doesn't grow with the table."""
    return df.repartition(parts, *keys) if parts else df


def whole_unions(spark: SparkSession) -> None:
    """Unions of rows dealt alike are dealt again before they are grouped or joined.

    Spark 4.1 takes such a union as dealt already, even if its sides are read in other parts once it runs: rows of one key then
    stay apart, or a join stops for unequal numbers of partitions.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: How many times larger rows may be in memory than in their files: ids and names of few kinds shrink by up to 170.
UNPACKED = 100


def honest_sizes(spark: SparkSession) -> None:
    """Tables are broadcast by what their rows take, not by their compressed files, so that a broadcast doesn't grow with the tables."""
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a session of one process makes its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="demandlens-")
        context.setCheckpointDir(folder)
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, read back from the shared folder."""
    whole_unions(df.sparkSession)
    shared_root(df.sparkSession)
    return df.checkpoint()
