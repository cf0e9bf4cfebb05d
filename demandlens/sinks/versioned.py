"""A keyed table in a shared folder, changed by whole batches.

Rows lie in buckets by a hash of their key. A batch writes the buckets that it touches anew, as Parquet beside the old ones, and then a
manifest, a small JSON file of the next number that names the folder of every bucket. Spark's committer moves that one file into its place
last, so a reader sees a batch whole or not at all, and what a failed batch has staged is never read. The manifest also keeps the last
batch of each writer, counters summed over batches, and values to carry to the next one; a batch that is there already is passed over. One writer at a time
commits to a table, as a streaming query's batches do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_MANIFEST = "schema string, folders map<string,string>, batches map<string,long>, counters map<string,long>, carried map<string,string>"


@dataclass
class State:
    """What the newest manifest says; of a table not yet written, version -1 and nothing else."""

    version: int = -1
    schema: str | None = None
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    carried: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    """Rows of distinct ``key`` columns below ``path``. A null in a key is a value like others; the number of buckets stays."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), list(key), buckets

    def state(self) -> State:
        try:
            rows = self.spark.read.schema(f"{_MANIFEST}, version long").json(f"{self.path}/manifests")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return State()
        newest = rows.orderBy(F.desc("version")).first()
        if newest is None:
            return State()
        folders = {int(b): folder for b, folder in (newest["folders"] or {}).items()}
        return State(newest["version"], newest["schema"], folders, *(dict(newest[c] or {}) for c in ("batches", "counters", "carried")))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: Iterable[int] | None = None, state: State | None = None) -> DataFrame | None:
        """The current rows, or those of some buckets; None before the first batch."""
        state = state or self.state()
        if state.schema is None:
            return None
        schema = StructType.fromDDL(state.schema)
        wanted = state.folders if only is None else state.folders.keys() & set(only)
        paths = [f"{state.folders[b]}/_bucket={b}" for b in sorted(wanted)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def holds(self, writer: str, batch: int, state: State | None = None) -> bool:
        """Whether a writer's batch, or a later one of it, is in the table."""
        return (state or self.state()).batches.get(writer, -1) >= batch

    def upsert(self, writer: str, batch: int, changes: DataFrame, deleted: DataFrame | None = None, counters: dict[str, int] | None = None, carried: dict[str, str] | None = None) -> bool:
        """Put the rows of ``changes`` in place of those of their keys, drop the keys of ``deleted``, and commit; False if the batch is there.

        Changes have distinct keys and, from the second batch on, the columns of the table; a key both changed and deleted is changed. An empty batch
        is a commit too, and its first one fixes the columns.
        """
        before = self.state()
        if self.holds(writer, batch, before):
            return False
        schema = StructType.fromDDL(before.schema) if before.schema else changes.schema
        changes = changes.select([F.col(c.name).cast(c.dataType) for c in schema])
        keys = changes.select(*self.key)
        if deleted is not None:
            keys = keys.unionByName(deleted.select(*self.key))
        touched = sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())
        folders = dict(before.folders)
        if touched:
            after = changes
            old = self.read(touched, before)
            if old is not None:
                gone = keys.distinct().select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])
                equal = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)]
                after = old.join(gone, equal, "left_anti").unionByName(changes)
            staged = f"{self.path}/data/{uuid.uuid4().hex}"
            after.withColumn("_bucket", self.bucket()).repartitionByRange("_bucket", *self.key).write.partitionBy("_bucket").parquet(staged)
            written = self.spark.read.schema(StructType([*schema, StructField("_bucket", IntegerType())])).parquet(staged)
            filled = {r[0] for r in written.select("_bucket").distinct().collect()}
            for b in touched:
                folders.pop(b, None)
                if b in filled:
                    folders[b] = staged
        totals = dict(before.counters)
        for name, n in (counters or {}).items():
            totals[name] = totals.get(name, 0) + n
        self._commit(State(before.version + 1, _ddl(schema), folders, before.batches | {writer: batch}, totals, before.carried | (carried or {})))
        return True

    def _commit(self, after: State) -> None:
        folders = {str(b): folder for b, folder in after.folders.items()}
        values = (after.schema, folders, after.batches, after.counters, after.carried, after.version)
        row = self.spark.createDataFrame([values], f"{_MANIFEST}, version long").coalesce(1)
        row.write.mode("error").json(f"{self.path}/manifests/n={after.version}")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in schema)
