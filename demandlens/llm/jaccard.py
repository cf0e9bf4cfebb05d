"""Jaccard join of n-gram sets over a forest of R-trees on count vectors (operator 13).

A set of shingles is hashed into groups; how many fall into each group is a point. Two sets have at most the sum of the
coordinates' minima in common, so points too far apart can't link. The points are indexed by trees:

- Sizes are cut into classes, and the sets of a class, with those of the next that are near enough in size, differ in at most
  ``most`` members. The groups are dealt into more slabs than that, so the points of two linked sets are equal in some slab: in
  the slab's tree they lie in the same node, whose box has no extent in the slab's coordinates. Such a node is a key.
- A node's points are packed along a space-filling curve into pages, each with the box of its points. Pages of a node are
  compared only if their boxes allow enough overlap, then their points by the sum of minima over all DIMS groups, and over FINE groups
  of which the counts' parities are kept: counts that differ in parity differ by one at least.
- Pairs that survive are verified on their whole sets.

Equal sets are one point. A node's pivot is compared first, which joins dense groups without their pairs; links inside a group add nothing
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.util import components, doc_columns, stored

#: Coordinates of a whole point, and those of the coarser one by which boxes are compared first.
DIMS, COARSE = 64, 8
#: Groups of which a point has the parities alone, a bit each.
FINE = 512
#: Points of a page.
PAGE = 64
#: Groups of a slab, by the upper bits of a hash.
GROUPS = 1 << 16
#: A slab of no more members names no node if enough other slabs are left.
FAINT = 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Classes:
    """Size classes for links of ``num`` / ``den`` of the union.

    Linked sets of sizes a <= b have a * den >= b * num and differ in a + b - 2i members, i being what they have in common, which is at
    most a * (den - num) / num. Class c holds sizes from ``lower[c]`` up to below ``lower[c + 1]``.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.step = -(-num // (den - num))
        #: Below the first step sizes link to equal sets alone.
        self.lower = [1, self.step]

    def _upto(self, size: int) -> None:
        while self.lower[-1] <= size:
            at = self.lower[-1]
            self.lower.append(max(at + self.step, at * 3 // 2, -(-at * self.den // self.num)))

    def of(self, size: int) -> int:
        self._upto(size)
        return int(np.searchsorted(self.lower, size, side="right")) - 1

    def most(self, c: int) -> int:
        """Members in which a set of class c and one no smaller that links to it differ."""
        self._upto(self.lower[c])
        return (self.lower[c + 1] - 1) * (self.den - self.num) // self.num

    def slabs(self, c: int) -> int:
        most = self.most(c)
        return most + max(1, most // 4) if most else 0

    def trees(self, size: int) -> list[int]:
        """The classes in whose trees a set is filed: its own, and the one below if that holds sizes it can link to."""
        c = self.of(size)
        below = c > 0 and (self.lower[c] - 1) * self.den >= size * self.num
        return [c, c - 1] if below else [c]


def shingle_set(text: str | None, k: int) -> tuple[np.ndarray, bytes]:
    """Sorted 64-bit hashes of the distinct k-word shingles of a text with A-Z lower-cased, and 128 bits that name the set.

    A text of fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64), b""
    joined = b" ".join(words)
    if len(words) <= k:
        hashes = np.array([xxhash.xxh3_64_intdigest(joined)], dtype=np.uint64)
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: len(words) - k])]
        parts = map(joined.__getitem__, map(slice, starts, ends[k - 1 :]))
        hashes = np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(starts)))
    return hashes, xxhash.xxh3_128_digest(hashes.tobytes())


def nodes(hashes: np.ndarray, classes: Classes) -> np.ndarray:
    """Keys of the tree nodes in which a set lies: for each slab of each of its trees, the slab's point by its product with random numbers."""
    groups = mixed(hashes & np.uint64(GROUPS - 1)) | np.uint64(1)
    out = []
    for c in classes.trees(len(hashes)):
        slabs = classes.slabs(c)
        if not slabs:
            continue
        slab = ((hashes >> np.uint64(24)) % np.uint64(slabs)).astype(np.int64)
        order = np.argsort(slab, kind="stable")
        members = np.bincount(slab, minlength=slabs)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(groups[order], dtype=np.uint64)])
        ends = np.cumsum(members)
        point = upto[ends] - upto[ends - members]
        keys = mixed(point + mixed(np.arange(slabs, dtype=np.uint64) + np.uint64(c << 40)))
        # some slab of equal points is never faint if fewer slabs are faint than must be equal
        strong = members > FAINT
        out.append(keys[strong] if slabs - strong.sum() < slabs - classes.most(c) else keys)
    return np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)


def point(hashes: np.ndarray) -> np.ndarray:
    """Members by group, at DIMS groups."""
    return np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=DIMS)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Parities of the members by group, at FINE groups, as longs."""
    odd = np.bincount((hashes >> np.uint64(65 - FINE.bit_length())).astype(np.int64), minlength=FINE) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def curve(p: np.ndarray) -> int:
    """Place of a point on a Z-order curve over its four sums of 16 coordinates, 12 leading bits each."""
    four = p.reshape(4, -1).sum(axis=1)
    shift = max(0, int(four.max()).bit_length() - 12)
    return sum((int(four[d]) >> shift >> b & 1) << (4 * b + d) for b in range(12) for d in range(4))


_SETS = pa.schema([("doc_id", pa.int64()), ("sid", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])
_WHOLE = pa.schema([("doc_id", pa.int64()), ("sid", pa.binary()), ("place", pa.int64()), ("point", pa.list_(pa.int32())), ("fine", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])


def sets(docs: DataFrame, words: int, num: int, den: int, whole: bool = False) -> DataFrame:
    """(doc_id, sid, n, keys) of every row, or with ``whole`` (doc_id, sid, place, point, fine, hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, rows, held = Classes(num, den), [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                hashes, sid = shingle_set(text.as_py(), words)
                if whole:
                    p = point(hashes)
                    rows.append({"doc_id": doc_id, "sid": sid, "place": curve(p), "point": p, "fine": parities(hashes), "hashes": hashes.view(np.int64)})
                    held += len(hashes)
                else:
                    keys = nodes(hashes, classes) if len(hashes) else None
                    rows.append({"doc_id": doc_id, "sid": sid, "n": len(hashes), "keys": keys})
                    held += 0 if keys is None else len(keys)
                if held > 200_000 or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, _WHOLE if whole else _SETS)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _WHOLE if whole else _SETS)

    ddl = "doc_id long, sid binary, place long, point array<int>, fine array<long>, hashes array<long>" if whole else "doc_id long, sid binary, n long, keys array<long>"
    return doc_columns(docs, "doc_id", "text").mapInArrow(work, ddl)


def _crossing(filed: DataFrame) -> DataFrame:
    """Rows of the nodes in which more than one label lies."""
    spread = filed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return filed.join(spread.select("key").hint("merge"), "key", "left_semi")


def _near(a: str, b: str, num: int, den: int) -> Column:
    """Sizes that can reach the similarity."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def _verified(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """(p_label, q_label) of the pairs (p, q) of nodes that link: by the sum of minima first, then by their whole sets."""
    bound = F.aggregate(F.zip_with("p_point", "q_point", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    total = F.col("p_n") + F.col("q_n")
    enough = lambda common: common * (num + den) >= total * num
    points = whole.select("node", "point")
    for side in "pq":
        pairs = pairs.join(points.select(F.col("node").alias(side), F.col("point").alias(f"{side}_point")).hint("merge"), side)
    left = pairs.where(enough(bound)).drop("p_point", "q_point")
    hashes = whole.select("node", "hashes")
    for side in "pq":
        left = left.join(hashes.select(F.col("node").alias(side), F.col("hashes").alias(f"{side}_set")).hint("merge"), side)
    return left.where(enough(F.size(F.array_intersect("p_set", "q_set")))).select(F.col("p_label").alias("a"), F.col("q_label").alias("b"))


_PAGE = "key long, page long, low array<int>, high array<int>, n_low long, n_high long, label_low long, label_high long, node array<long>, n array<long>, label array<long>, point array<int>, fine array<long>"


def pages(filed: DataFrame) -> DataFrame:
    """Pages of PAGE points of each node (key, node, n, label, place, point, fine), packed along the curve, with their boxes.

    Dealt by range over key and place, so the points of one node fill several tasks.
    """
    kinds = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _PAGE.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(rows: list[dict]) -> dict:
            points = np.array([r["point"] for r in rows], dtype=np.int32)
            coarse = points.reshape(len(rows), COARSE, -1).sum(axis=2)
            columns = {c: [r[c] for r in rows] for c in ("node", "n", "label")}
            ends = {"n_low": min(columns["n"]), "n_high": max(columns["n"]), "label_low": min(columns["label"]), "label_high": max(columns["label"])}
            return {"key": rows[0]["key"], "page": rows[0]["node"], "low": coarse.min(axis=0), "high": coarse.max(axis=0), **ends, **columns, "point": points.ravel(), "fine": np.concatenate([r["fine"] for r in rows])}

        def out() -> Iterator[dict]:
            rows: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if rows and (row["key"] != rows[0]["key"] or len(rows) == PAGE):
                        yield page(rows)
                        rows = []
                    rows.append(row)
            if rows:
                yield page(rows)

        some: list[dict] = []
        for p in out():
            some.append(p)
            if len(some) == 200:
                yield pa.RecordBatch.from_pylist(some, schema)
                some = []
        if some:
            yield pa.RecordBatch.from_pylist(some, schema)

    order = ["key", "place", "node"]
    return filed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, _PAGE)


def page_pairs(packed: DataFrame, num: int, den: int) -> DataFrame:
    """(p, q, p_n, q_n, p_label, q_label): pairs of points of different labels, of one node, that the sum of minima over all groups allows."""

    def side(s: str) -> DataFrame:
        cols = [F.col(c).alias(f"{s}_{c}") for c in packed.columns if c not in ("key", "low", "high")]
        box = [F.col(c)[d].alias(f"{s}_{c}{d}") for c in ("low", "high") for d in range(COARSE)]
        return packed.select("key", *cols, *box)

    minima = sum((F.least(f"p_high{d}", f"q_high{d}") for d in range(COARSE)), F.lit(0))
    gap = sum((F.greatest(F.lit(0), F.col(f"p_low{d}") - F.col(f"q_high{d}"), F.col(f"q_low{d}") - F.col(f"p_high{d}")) for d in range(COARSE)), F.lit(0))
    meet = (F.col("p_page") <= F.col("q_page")) & (F.least("p_label_low", "q_label_low") < F.greatest("p_label_high", "q_label_high"))
    sizes = (F.col("p_n_high") * den >= F.col("q_n_low") * num) & (F.col("q_n_high") * den >= F.col("p_n_low") * num)
    boxes = (minima * (num + den) >= (F.col("p_n_low") + F.col("q_n_low")) * num) & (gap * (num + den) <= (F.col("p_n_high") + F.col("q_n_high")) * (den - num))
    met = side("p").join(side("q").hint("merge"), "key").where(meet & sizes & boxes)
    names = [f"{s}_{c}" for s in "pq" for c in ("node", "n", "label", "point", "fine")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = {c: np.array(batch[c][k].values) for c in names}
                p, q = (value[f"{s}_point"].reshape(-1, DIMS) for s in "pq")
                pn, qn = value["p_n"], value["q_n"]
                common = np.stack([np.minimum(x, q).sum(axis=1) for x in p])
                p_fine, q_fine = (value[f"{s}_fine"].view(np.uint64).reshape(-1, FINE // 64) for s in "pq")
                odd = np.bitwise_count(p_fine[:, None] ^ q_fine[None]).sum(axis=2, dtype=np.int64)
                common = np.minimum(common, (pn[:, None] + qn[None, :] - odd) // 2)
                good = common * (num + den) >= (pn[:, None] + qn[None, :]) * num
                good &= value["p_label"][:, None] != value["q_label"][None, :]
                if np.array_equal(value["p_node"], value["q_node"]):
                    good &= np.triu(np.ones_like(good), 1)
                i, j = np.nonzero(good)
                swap = value["p_node"][i] > value["q_node"][j]
                both = [(np.where(swap, value[f"q_{c}"][j], value[f"p_{c}"][i]), np.where(swap, value[f"p_{c}"][i], value[f"q_{c}"][j])) for c in ("node", "n", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for pair in both for x in pair], names=["p", "q", "p_n", "q_n", "p_label", "q_label"])

    return met.select(*names).mapInArrow(work, "p long, q long, p_n long, q_n long, p_label long, q_label long").distinct()


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set of word shingles, and the smallest doc_id reachable by links.

    Two rows link if what their sets have in common is ``num`` / ``den`` of their union or more. A null, empty or blank text has an empty
    set and links with nothing, so its component is itself. Rows with a null doc_id link others but name no component; a component of such
    rows alone has null. Rows that repeat an id are returned each; with different texts they are different rows. Only doc_id and
    text are read, texts whole. An empty table gives no rows.
    """
    rows = stored(sets(docs, words, num, den), "sets")
    once = rows.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("doc_id").alias("least"))
    once = stored(once.withColumn("node", F.monotonically_increasing_id()), "once")
    met = stored(_crossing(once.select(F.explode("keys").alias("key"), F.col("node").alias("label"))), "met")
    open_ = met.select("key", F.col("label").alias("node"), "label").join(once.select("node", "n").hint("merge"), "node")

    wanted = stored(once.select("node", "sid", "least").join(met.select(F.col("label").alias("node")).distinct().hint("merge"), "node", "left_semi"), "wanted")
    texts = doc_columns(docs, "doc_id", "text")
    texts = texts.join(wanted.select("least").distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    whole = sets(texts, words, num, den, whole=True).join(wanted.select("sid", "node").hint("merge"), "sid").dropDuplicates(["sid"])
    whole = stored(whole.select("node", "place", "point", "fine", "hashes"), "whole")
    open_ = stored(open_, "open")

    pivots = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("x"), "node", "n")).alias("s")).select("key", F.col("s.node").alias("q"), F.col("s.n").alias("q_n"))
    both = stored(open_.join(pivots.hint("merge"), "key").where("node <> q"), "tried")
    tried = both.where(_near("n", "q_n", num, den)).select(F.col("node").alias("p"), "q", F.col("n").alias("p_n"), "q_n", F.col("node").alias("p_label"), F.col("q").alias("q_label"))
    linked = stored(_verified(tried.distinct(), whole, num, den), "linked")
    dense = stored(components(linked, "dense"), "roots")
    labels = dense.select("node", F.col("root").alias("label"))
    rest = both.select("key", "node", "n").join(labels.hint("merge"), "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    rest = stored(_crossing(stored(rest, "rest")), "crossing")
    packed = stored(pages(rest.join(whole.select("node", "place", "point", "fine").hint("merge"), "node")), "pages")
    links = stored(_verified(stored(page_pairs(packed, num, den), "pairs"), whole, num, den), "links")
    roots = stored(components(links.unionByName(dense.selectExpr("node AS a", "root AS b")), "links"), "roots")

    rooted = stored(once.select("sid", "node", "least").join(roots.hint("merge"), "node", "left").select("sid", "least", F.coalesce("root", "node").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stored(rooted.join(names.hint("merge"), "root").select("sid", "component_id"), "names")
    linked = rows.where("n > 0").select("doc_id", "sid", "n").join(found.hint("merge"), "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
