"""Tables kept up to date by streams: batches are applied once each, and what one leaves is there for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.sinks.sync import sync_jobs
from demandlens.sinks.versioned import VersionedTable

Step = Callable[[DataFrame, int], object]


def apply_stream(stream: DataFrame, step: Step, checkpoint: str) -> None:
    """Work off all batches of a stream that are there; a batch that comes again after a failure is the step's to pass over."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: step(rows, batch)).trigger(availableNow=True).start()
    query.awaitTermination()


def record_candidates(table: VersionedTable, writer: str, catalog: DataFrame, flag_at: int = 5) -> Step:
    """A step that adds the counts of unknown names (normalized) to a table (normalized, n, flagged); names of the catalog (normalized) are none."""

    def step(rows: DataFrame, batch: int) -> bool:
        if table.holds(writer, batch):
            return False
        more = rows.where("normalized <> ''").groupBy("normalized").agg(F.count("*").alias("more")).join(catalog.select("normalized").distinct(), "normalized", "left_anti")
        known = table.read()
        if known is not None:
            more = more.join(known, "normalized", "left").withColumn("more", F.col("more") + F.coalesce("n", F.lit(0)))
        changes = more.select("normalized", F.col("more").cast("long").alias("n"), (F.col("more") >= flag_at).alias("flagged"))
        return table.upsert(writer, batch, changes)

    return step


def sync_window(table: VersionedTable, writer: str, sources: list[str], most: int, listings: Callable[[list[str]], DataFrame], at: str, batch: int) -> list[str]:
    """Synchronise the jobs of the next ``most`` sources of a rolling window; the offset is carried in the table. The sources taken, none if the batch is there."""
    state = table.state()
    if table.holds(writer, batch, state) or not sources:
        return []
    at_source = int(state.carried.get(f"{writer}.offset", 0)) % len(sources)
    taken = [sources[(at_source + i) % len(sources)] for i in range(min(most, len(sources)))]
    sync_jobs(table, writer, batch, listings(taken), at, carried={f"{writer}.offset": str((at_source + len(taken)) % len(sources))})
    return taken
