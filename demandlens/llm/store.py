"""Token-ID output as a content-addressed store (operator 3).

Below one path lie three tables:

* ``chunks``: address (sha256 of the bytes) and data, every distinct chunk once; ids are little-endian
  unsigned 16-bit integers (32-bit for vocabularies above 65,536 ids);
* ``recipes``: one row for each document in ascending doc_id order (null first): start, n_tokens, the
  addresses of its chunks in order, and the Merkle root over them;
* ``manifest``: Merkle nodes over at most 1,024 recipes each, then over the blocks of each file, then one
  for the whole store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.encoding import batches, encoder
from demandlens.llm.util import doc_columns, in_order, shared_folder, stored

END = 0
WINDOW, LEAST, MOST, MEAN_BITS = 8, 64, 4096, 9
FAN_OUT = 1024
_ODD_MULTIPLIERS = (np.arange(1, WINDOW + 1, dtype=np.uint32) * np.uint32(0x9E3779B1)) | np.uint32(1)


def cut_points(ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """Where each stream's chunks end: a rolling hash of the last WINDOW ids ends a chunk of LEAST ids or more, MOST is the longest."""
    mixed = ids.astype(np.uint32) * np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(15)
    rolled = np.zeros(len(ids), dtype=np.uint32)
    for j in range(min(WINDOW, len(ids))):
        rolled[j:] += mixed[: len(ids) - j] * _ODD_MULTIPLIERS[j]
    rolled ^= rolled >> np.uint32(16)
    marks = np.flatnonzero((rolled * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends = np.cumsum(lengths)
    low, high = np.searchsorted(marks, ends - lengths, "right"), np.searchsorted(marks, ends, "left")
    out = []
    for k, end in enumerate(ends.tolist()):
        last, cuts = end - int(lengths[k]), []
        for mark in marks[low[k] : high[k]].tolist():
            while mark - last > MOST:
                last += MOST
                cuts.append(last)
            if mark - last >= LEAST:
                cuts.append(mark)
                last = mark
        while end - last > MOST:
            last += MOST
            cuts.append(last)
        out.append([*cuts, end])
    return out


def merkle(nodes: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node rises as it is."""
    nodes = list(nodes) or [b""]
    while len(nodes) > 1:
        nodes = [hashlib.sha256(b"".join(nodes[k : k + 2])).digest() if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return hashlib.sha256(b"root" + nodes[0]).digest()


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo the CRC-32 polynomial."""
    product = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


_SHIFTS: dict[int, int] = {}


def joined_crc(crc: int, more: int, n_bytes: int) -> int:
    """crc32 of a byte string of crc ``crc`` followed by one of ``n_bytes`` bytes of crc ``more``."""
    if n_bytes not in _SHIFTS:
        power, square, n = 1 << 31, 1 << 23, n_bytes
        while n:
            if n & 1:
                power = _times(power, square)
            square, n = _times(square, square), n >> 1
        _SHIFTS[n_bytes] = power
    return _times(_SHIFTS[n_bytes], crc) ^ more


def write_store(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Encode every row's whole text (null: empty), append END, and write the store below ``path``.

    Rows with equal doc_id are kept, each with a recipe of its own, ordered by their Merkle root; a null
    doc_id comes first. Other columns are ignored. An empty table gives empty tables.
    """
    spark = docs.sparkSession

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for part in parts:
            texts = part["text"].tolist()
            for lo, hi in batches(texts):
                bare, lengths = enc.encode(texts[lo:hi])
                ends = np.cumsum(lengths)
                ids = np.insert(bare, ends, END)
                n_all = lengths + 1
                rows, at = [], 0
                for cuts in cut_points(ids, n_all):
                    data = []
                    for end in cuts:
                        data.append(ids[at:end].tobytes())
                        at = end
                    addresses = [hashlib.sha256(x).digest() for x in data]
                    rows.append((merkle(addresses), addresses, data))
                root, addresses, data = zip(*rows, strict=True)
                yield pd.DataFrame({"doc_id": part["doc_id"].iloc[lo:hi].astype("Int64").to_numpy(), "n_tokens": n_all, "root": root, "addresses": addresses, "data": data})

    schema = "doc_id long, n_tokens long, root binary, addresses array<binary>, data array<binary>"
    encoded = stored(doc_columns(docs, "doc_id", "text").mapInPandas(encode, schema), "encoded")
    chunks = encoded.select(F.explode(F.arrays_zip("addresses", "data")).alias("c")).select(F.col("c.addresses").alias("address"), F.col("c.data").alias("data"))
    chunks.dropDuplicates(["address"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    order = [F.col("doc_id").asc_nulls_first(), F.col("root").asc()]
    recipes = in_order(encoded.drop("data"), order, "n_tokens", "recipes").select("doc_id", "start", "n_tokens", "root", "addresses", "part")
    recipes.repartitionByRange("start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """Merkle nodes (level, part, block, n_documents, n_tokens, hash) over recipes; level 2 has one row for the whole store.

    Blocks hold FAN_OUT consecutive recipes of a part at most, so no group is unbounded but for the list of
    block hashes of a part, whose length is a part's rows / FAN_OUT.
    """
    from pyspark.sql import Window

    ranked = recipes.select("part", "start", "n_tokens", "root", F.row_number().over(Window.partitionBy("part").orderBy("start")).alias("r"))

    def level(rows: DataFrame, k: int, keys: list[str], order: str, digest: str, n) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(digest).alias("d"))))
        return rows.groupBy(*keys).agg(F.sum(n).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.min(order).alias("first"), F.sha2(F.array_join(F.transform(listed, lambda x: x["d"]), ""), 256).alias("h")).select(
            F.lit(k).alias("level"), *keys, "n_documents", "n_tokens", "first", F.unhex("h").alias("hash")
        )

    blocks = level(ranked.withColumn("block", F.floor((F.col("r") - 1) / FAN_OUT)), 0, ["part", "block"], "start", "root", F.lit(1))
    parts = level(blocks, 1, ["part"], "first", "hash", F.col("n_documents")).withColumn("block", F.lit(None).cast("long"))
    whole = level(parts.withColumn("store", F.lit(0)), 2, ["store"], "first", "hash", F.col("n_documents")).drop("store").withColumns({"part": F.lit(None).cast("int"), "block": F.lit(None).cast("long")})
    return blocks.unionByName(parts).unionByName(whole)


def read_chunks(spark: SparkSession, path: str, vocabulary_size: int) -> DataFrame:
    """Each stored chunk read back: address, n ids, crc32 of the ids as 32-bit integers, and whether its bytes have its address."""
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for address, data in zip(part["address"], part["data"], strict=True):
                ids = np.frombuffer(data, dtype=kind)
                rows.append((address, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(data).digest() == bytes(address)))
            yield pd.DataFrame(rows, columns=["address", "n", "crc", "sound"])

    return spark.read.parquet(f"{path}/chunks").mapInPandas(digest, "address binary, n long, crc long, sound boolean")


def read_documents(spark: SparkSession, path: str, vocabulary_size: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified, n_chunks) of every document, from the store's files alone.

    Chunks are read, checked against their addresses and digested where they lie; only the digests go to the
    recipes, whose crc32 is joined from those of their chunks in order. ``verified``: all addresses are sound,
    lengths add up, and the Merkle root is that of the recipe.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    steps = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("addresses").alias("k", "address"))
    found = steps.join(read_chunks(spark, path, vocabulary_size), "address", "left")
    listed = found.groupBy("start").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"),
        F.array_sort(F.collect_list(F.struct("k", "address", "n", "crc", "sound"))).alias("steps"),
    )

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for n_tokens, root, steps in zip(part["n_tokens"], part["root"], part["steps"], strict=True):
                crc, n, good = 0, 0, merkle([bytes(s["address"]) for s in steps]) == bytes(root)
                for s in steps:
                    if not s["sound"]:
                        good = False
                        continue
                    crc = joined_crc(crc, s["crc"], 4 * s["n"])
                    n += s["n"]
                rows.append((crc, good and n == n_tokens, len(steps)))
            crc, good, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "start": part["start"], "n_tokens": part["n_tokens"], "ids_crc32": list(crc), "verified": list(good), "n_chunks": list(n)})

    return listed.mapInPandas(join, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean, n_chunks long")


def read_ids(spark: SparkSession, path: str, vocabulary_size: int) -> DataFrame:
    """(doc_id, start, ids) of every document, rebuilt from its recipe and the chunks."""
    kind = "<u2" if vocabulary_size <= 1 << 16 else "<u4"

    @F.pandas_udf("array<long>")
    def unpack(data: pd.Series) -> pd.Series:
        return data.map(lambda xs: np.concatenate([np.frombuffer(x, dtype=kind) for x in xs]).astype(np.int64))

    steps = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("addresses").alias("k", "address"))
    found = steps.join(spark.read.parquet(f"{path}/chunks"), "address")
    listed = found.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "data"))).alias("steps"))
    return listed.select("doc_id", "start", unpack(F.transform("steps", lambda s: s["data"])).alias("ids"))


def token_store(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Write the store and return what its files say of every document."""
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    path = path or shared_folder(docs.sparkSession, "tokens")
    write_store(docs, path, vocabulary)
    return read_documents(docs.sparkSession, path, encoder(vocabulary).vocabulary)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
