"""Importance resampling towards a target distribution over a persisted sparse count matrix (operator 12).

The document-by-bucket counts are written once as blocks of compressed sparse rows. Everything else reads these blocks: column
sums give the distribution of the raw documents, those of the target's own blocks the target's, and the product of the matrix with
the buckets' gains gives each document's weight. Gumbel noise by document turns weights into a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.util import doc_columns, in_order, stored

#: A block ends after so many documents or entries, whichever comes first; a document is never split. Readers hold thousands of blocks at once,
#: by their number and whatever their size, so blocks are small.
BLOCK_ROWS, BLOCK_ENTRIES = 1024, 1000
#: So many entries and documents are written, and so many blocks multiplied, at once.
BATCH_ENTRIES, BATCH_BLOCKS = 100_000, 256
BLOCKS = "doc_ids array<long>, words array<long>, indptr array<long>, buckets array<int>, counts array<long>"
_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("indptr", pa.list_(pa.int64())), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
#: Bytes of words (digits, letters, all beyond ASCII) with A-Z lower-cased; others are blanks.
_LETTERS = bytes(b if b > 127 or chr(b).isdigit() else b | 32 if chr(b).isalpha() else 32 for b in range(256))


def entries(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, buckets and counts of a text's runs of up to ``longest`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    found: Counter = Counter(words)
    for n in range(2, longest + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    at = np.fromiter((zlib.crc32(w) % buckets for w in found), dtype=np.int32, count=len(found))
    own, place = np.unique(at, return_inverse=True)
    times = np.fromiter(found.values(), dtype=np.int64, count=len(found))
    counts = np.zeros(len(own), dtype=np.int64)
    np.add.at(counts, place, times)
    return len(words), own, counts


def count_matrix(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """The matrix of (doc_id, text) rows, written to the shared folder: one row of BLOCKS for each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, indptr, columns, counts = [], [], [0], [], []
        rows, held = [], 0

        def block() -> dict:
            return {"doc_ids": ids, "words": words, "indptr": indptr, "buckets": np.concatenate(columns), "counts": np.concatenate(counts)}

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                n, at, times = entries(text, longest, buckets)
                ids.append(doc_id)
                words.append(n)
                indptr.append(indptr[-1] + len(at))
                columns.append(at)
                counts.append(times)
                if len(ids) >= BLOCK_ROWS or indptr[-1] >= BLOCK_ENTRIES:
                    rows.append(block())
                    held += len(ids) + indptr[-1]
                    ids, words, indptr, columns, counts = [], [], [0], [], []
                    if held >= BATCH_ENTRIES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if ids:
            rows.append(block())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return stored(doc_columns(texts, "doc_id", "text").mapInArrow(work, BLOCKS), "csr")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].flatten().to_numpy(zero_copy_only=False)


def column_sums(matrix: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): sums of the matrix's columns; each task sends one row for each bucket at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            np.add.at(sums, _flat(batch, "buckets"), _flat(batch, "counts"))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["bucket", "n"])

    return matrix.select("buckets", "counts").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets: 1000 times the log ratio of the smoothed distributions, rounded down."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, words, n_features, weight): the matrix times the gains, over the number of features, rounded down."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_BLOCKS):
                some = batch.slice(k, BATCH_BLOCKS)
                # each block's indptr begins at 0, so a difference across two blocks is none of a document
                lasts = np.cumsum(np.diff(some["indptr"].offsets.to_numpy()))[:-1] - 1
                indptr = np.concatenate([[0], np.cumsum(np.delete(np.diff(_flat(some, "indptr")), lasts))])
                counts = _flat(some, "counts")
                upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[indptr]
                n, total = np.diff(upto(counts)), np.diff(upto(counts * gain[_flat(some, "buckets")]))
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([some["doc_ids"].flatten(), some["words"].flatten(), pa.array(n), pa.array(weight)], names=["doc_id", "words", "n_features", "weight"])

    return matrix.mapInArrow(work, "doc_id long, words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; the ``percent`` of rows with the highest scores have a rank.

    Of the rows with at least ``least_words`` words, that many per cent, rounded down, are drawn; ties go to the smaller
    doc_id, null last, and among rows that repeat an id in any order. A null, empty or blank text has no feature and weight
    0. A null doc_id draws its noise from an empty id. An empty target is a uniform one; empty documents give no rows.
    Only doc_id and text are read. To the driver come ``buckets`` gains and two numbers. Scores are whole numbers
    from the gains' range and 2^32 steps of noise, so the histogram that finds the lowest score drawn has under 100,000 rows.
    """
    matrix = count_matrix(docs, longest, buckets)
    wanted = column_sums(count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets), buckets)
    table = gains(column_sums(matrix, buckets), wanted, buckets).collect()
    gain = np.zeros(buckets, dtype=np.int64)
    gain[[r["bucket"] for r in table]] = [r["gain"] for r in table]

    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))
    scored = stored(weights(matrix, gain).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    steps = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).selectExpr("score", "sum(n) OVER (ORDER BY score DESC) AS upto")
    lowest = steps.where(F.col("upto") >= drawn).agg(F.max("score")).first()[0] if drawn else None
    high = able & (F.col("score") >= F.lit(lowest)) if drawn else F.lit(False)
    first = in_order(scored.where(high).withColumn("one", F.lit(1)), [F.desc("score"), F.asc_nulls_last("doc_id")], "one", "drawn")
    ranked = first.select("doc_id", "n_features", "weight", "score", F.when(F.col("start") < drawn, F.col("start") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~high).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
