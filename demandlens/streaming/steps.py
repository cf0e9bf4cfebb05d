"""Counts of pipeline steps over event time, and the first event of each id, from a growing folder of Parquet files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandlens.session import shared_root


def source(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """The files below a path as a stream, at most so many to a batch; the times in ``ts``, which name no zone, are read as UTC."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("+00:00")).cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, step_name, n, total_ms) of events (ts, event_type, value); rows later than the watermark are left out, so state is bounded."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), F.col("event_type").alias("step_name"))
    counted = found.agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 1000)).alias("total_ms"))
    start = F.expr("timestampadd(SECOND, unix_seconds(w.start), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return counted.select(start.alias("window_start"), "step_name", "n", "total_ms")


def first_seen(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events without those that repeat an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Work off all that is there, and read the result from the shared folder: ``complete`` for the whole table, ``append`` for rows that are final."""
    spark = stream.sparkSession
    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
