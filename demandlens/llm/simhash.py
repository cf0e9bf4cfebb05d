"""SimHash near-duplicates by multi-index hashing (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.llm.util import components, doc_columns, stored

#: From so many distinct fingerprints on, two wide segments cost less than three narrow ones.
WIDE_FROM = 28_000_000
#: Sets of shingles meet if one of so many bands of so many least hashes agrees.
BANDS, ROWS = 24, 5
#: A band key of more sets is split by further permutations; at the last level all pairs under a key are compared.
CROWD, LEVELS = 5000, 2
#: Pivots are chosen anew, so many times at most, while the pairs of different labels under keys are more than so many for each row.
TURNS, PAIRS_A_ROW = 5, 2
#: Longs of a set's marks, each of whose bits is the parity of the hashes that fall on it.
MARKS = 8


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles of a text with A-Z lower-cased; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    parts = map(joined.__getitem__, map(slice, starts, ends[k - 1 :]))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype=np.uint64, count=len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is set if more than half of the hashes have it; 0 without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; a null, empty or blank text has 0."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fp = [fingerprint(shingle_hashes(t, words)) for t in part["text"].tolist()]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "fp": np.array(fp, dtype=np.int64)})

    return doc_columns(docs, "doc_id", "text").mapInPandas(work, "doc_id long, fp long")


def segments(distance: int, wide: bool) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of segments of the 64 bits such that fingerprints within the distance agree in one within its radius.

    The radii plus one of all segments add up to more than the distance, so it can't exceed every radius.
    """
    n = 2 if wide else 3
    radii = [(distance + 1) // n + (k < (distance + 1) % n) - 1 for k in range(n)]
    while radii and radii[-1] < 0:
        radii.pop()
    widths = [64 // len(radii) + (k < 64 % len(radii)) for k in range(len(radii))]
    shifts = [sum(widths[:k]) for k in range(len(radii))]
    return list(zip(shifts, widths, radii, strict=True))


def ball(width: int, radius: int) -> list[int]:
    """Masks of all patterns with at most ``radius`` of ``width`` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _key(fp: Column, place: int, shift: int, width: int) -> Column:
    """A segment's value with the segment's place above it; a segment of all bits is the fingerprint."""
    if width == 64:
        return fp
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(place << 40)


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def cluster(prints: DataFrame, distance: int = 4, wide: bool | None = None) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint under links of at most ``distance`` differing bits.

    1. Every fingerprint is filed under its segments' values. The two pivots of each value (the fingerprint of
       most documents, and one by hash), found by a pre-aggregated max and min, link to those that lie within the
       distance; this joins dense groups without forming their pairs.
    2. The Hamming balls of the segments are enumerated for each fingerprint. Probes of values under which only
       the prober's own component lies are dropped against one row for each value; the others fetch the
       table's fingerprints, whose complete distance is verified. Links inside a component add nothing and
       are left out, so the components are those of all links.
    """
    fps = stored(prints.groupBy("fp").agg(F.count("*").alias("n")), "fps")
    if wide is None:
        wide = fps.count() >= WIDE_FROM
    parts = segments(distance, wide)
    keys = F.explode(F.array(*[_key(F.col("fp"), k, shift, width) for k, (shift, width, _) in enumerate(parts)]))
    table = fps.select("fp", "n", keys.alias("key"))
    pivots = table.groupBy("key").agg(
        F.count("*").alias("members"), F.max(F.struct("n", "fp"))["fp"].alias("p1"), F.min(F.struct(F.xxhash64("fp").alias("x"), "fp"))["fp"].alias("p2")
    ).where("members > 1")
    near = table.join(pivots, "key").select("fp", F.explode(F.array("p1", "p2")).alias("p"))
    edges = near.where((F.col("fp") != F.col("p")) & (differing("fp", "p") <= distance)).selectExpr("fp AS a", "p AS b")
    first = components(edges, "dense")
    labelled = stored(fps.join(first, fps["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("label")), "labelled")

    table = labelled.select("fp", "label", keys.alias("key"))
    spread = table.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    probes = None
    for k, (shift, width, radius) in enumerate(parts):
        own = labelled.select("fp", "label", _key(F.col("fp"), k, shift, width).alias("own"))
        masks = F.array(*[F.lit(x).cast("long") for x in ball(width, radius)])
        some = own.select("fp", "label", "own", F.explode(masks).alias("mask")).select("fp", "label", F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
        probes = some if probes is None else probes.unionByName(some)
    open_ = probes.join(spread, "key").where("low <> label OR high <> label").select(F.col("fp").alias("q"), F.col("label").alias("ql"), "key")
    links = open_.join(table, "key").where((F.col("q") > F.col("fp")) & (F.col("ql") != F.col("label")) & (differing("q", "fp") <= distance))
    more = components(links.selectExpr("ql AS a", "label AS b"), "links")
    return labelled.join(more, labelled["label"] == more["node"], "left").select("fp", F.coalesce("root", "label").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, wide: bool | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    component_id is the smallest doc_id reachable over links, the row's own included. A null, empty or blank text has
    fingerprint 0 and links like any other. Rows with a null doc_id link too but give no component_id; a component
    of such rows alone has null. Repeated rows are returned each. Other columns are not read.
    """
    prints = stored(fingerprints(docs, words), "prints")
    found = cluster(prints, distance, wide)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    rooted = stored(found.join(least, "fp"), "rooted")
    names = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    return prints.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(found: np.ndarray, level: int = 0) -> np.ndarray:
    """BANDS keys of a set of hashes, each of the ROWS least values under as many permutations; levels differ in these."""
    odd = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(level << 20)) | np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024, None] * odd).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys + row)
    return keys.view(np.int64)


def marks(found: np.ndarray) -> np.ndarray:
    """Parities of a set of hashes by their leading bits: the marks of two sets differ in no more bits than the sets in members."""
    at = found >> np.uint64(64 - (64 * MARKS - 1).bit_length())
    odd = np.bincount(at.astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def shingle_sets(docs: DataFrame, words: int, level: int = 0, whole: bool = False) -> DataFrame:
    """(doc_id, fp, sid, n, bands) for every row: fingerprint, name and size of its set of shingles, and the set's band keys.

    With ``whole`` the set itself and its marks are returned too. A text without words has an empty set and no bands.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 1000):
                some = part.iloc[at : at + 1000]
                rows = []
                for text in some["text"].tolist():
                    hashes = shingle_hashes(text, words)
                    found = np.unique(hashes)
                    sid = int(_mixed(found).sum(dtype=np.uint64).view(np.int64))
                    bands = band_keys(found, level) if len(found) else None
                    rows.append((fingerprint(hashes), sid, len(found), bands, *([found.view(np.int64), marks(found)] if whole else [])))
                out = pd.DataFrame(rows, columns=["fp", "sid", "n", "bands", *(["hashes", "marks"] if whole else [])])
                out.insert(0, "doc_id", some["doc_id"].astype("Int64").array)
                yield out

    columns = "doc_id long, fp long, sid long, n int, bands array<long>" + (", hashes array<long>, marks array<long>" if whole else "")
    return doc_columns(docs, "doc_id", "text").mapInPandas(work, columns)


def _crossing(rows: DataFrame) -> DataFrame:
    """Rows filed under a key at which more than one label lies."""
    spread = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return rows.join(spread.select("key").hint("merge"), "key", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """(a, b) labels of the pairs whose sets have that many tenths of their union in common, or more."""
    for side in "pq":
        mine = sets.select(F.col("doc_id").alias(f"{side}_doc"), F.col("sid").alias(f"{side}_sid"), F.col("hashes").alias(f"{side}_set"))
        pairs = pairs.join(mine.hint("merge"), [f"{side}_doc", f"{side}_sid"])
    common = F.size(F.array_intersect("p_set", "q_set"))
    return pairs.where(common * 10 >= tenths * (F.col("p_n") + F.col("q_n") - common)).selectExpr("p_label AS a", "q_label AS b")


def _sized(tenths: int) -> Column:
    """Sets of these sizes can reach the similarity, and their links aren't known."""
    return (F.col("p_label") != F.col("q_label")) & (F.least("p_n", "q_n") * 10 >= F.greatest("p_n", "q_n") * tenths)


_FIELDS = ("doc", "sid", "n", "label")


def _side(rows: DataFrame, side: str, more: tuple = ()) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{side}_{c}") for c in (*_FIELDS, *more)])


def _all_pairs(rows: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """Distinct pairs of different labels under a key that can reach the similarity by their sizes and marks.

    Sets of sizes adding up to s have ``tenths`` of their union in common only if they differ in at most
    s * (10 - tenths) / (10 + tenths) members, which bounds the bits in which their marks differ. So the join itself leaves
    out nearly all pairs of lesser similarity, however many lie under a key, and no other. A pair is made under the least of
    the keys that it shares.
    """
    names = tuple(f"m{k}" for k in range(MARKS))
    known = sets.select(F.col("doc_id").alias("doc"), "sid", *[F.col("marks")[k].alias(m) for k, m in enumerate(names)])
    held = rows.groupBy("doc", "sid").agg(F.collect_set("key").alias("keys"))
    marked = rows.join(known.hint("merge"), ["doc", "sid"]).join(held.hint("merge"), ["doc", "sid"])
    apart = sum((F.bit_count(F.col(f"p_{m}").bitwiseXOR(F.col(f"q_{m}"))) for m in names), F.lit(0))
    close = apart * (10 + tenths) <= (F.col("p_n") + F.col("q_n")) * (10 - tenths)
    first = F.array_min(F.array_intersect("p_keys", "q_keys")) == F.col("key")
    more = (*names, "keys")
    met = _side(marked, "p", more).join(_side(marked, "q", more).hint("merge"), "key").where((F.col("p_sid") < F.col("q_sid")) & _sized(tenths) & close & first)
    return met.select(*[f"{side}_{c}" for side in "pq" for c in _FIELDS]).distinct()


def _dense(rows: DataFrame) -> bool:
    """Whether pairs of different labels under keys are many for the rows filed there."""
    per = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    pairs, n = per.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.sum("n")).first()
    return n is not None and pairs > PAIRS_A_ROW * n


def _relabelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, rows["label"] == roots["node"], "left").withColumn("label", F.coalesce("root", "label")).drop("node", "root")


def similar_sets(docs: DataFrame, prints: DataFrame, labelled: DataFrame, words: int, tenths: int) -> DataFrame:
    """(label, root) of labels that links between different sets of shingles join; labels without such a link may be missing.

    1. Every set, once for all its copies, is filed under its band keys. Keys at which one label lies are dropped.
    2. One pivot for each key, the same for all keys that hold it, is compared with the others filed there; this joins
       dense groups without forming their pairs. While many pairs of different labels are left, other pivots follow.
    3. The pairs of different labels that are left under a key are compared, those whose marks allow the similarity. A
       key of more than CROWD sets is first split by band keys of further permutations and goes through steps 2 and 3
       again; at the last of LEVELS nothing is split, so no pair is left out.

    Sets are compared whole; only rows with a doc_id take part.
    """
    texts = doc_columns(docs, "doc_id", "text")
    known = prints.where("doc_id IS NOT NULL AND n > 0")
    once = known.groupBy("fp", "sid").agg(F.min(F.struct("doc_id", "n", "bands")).alias("s"))
    filed = once.join(labelled.hint("merge"), "fp").select(F.explode("s.bands").alias("key"), F.col("s.doc_id").alias("doc"), "sid", F.col("s.n").alias("n"), "label")
    open_ = stored(_crossing(stored(filed, "filed")), "open")
    wanted = stored(open_.select("doc").distinct(), "wanted")
    asked = texts.join(wanted.hint("merge"), F.col("doc_id") == F.col("doc"), "left_semi")
    sets = stored(shingle_sets(asked, words, whole=True).select("doc_id", "sid", "hashes", "marks").dropDuplicates(["doc_id", "sid"]), "sets")

    links = None
    rows = open_
    for level in range(1, LEVELS + 1):
        for turn in range(TURNS):
            if turn and not _dense(rows):
                break
            pivots = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("sid", F.lit(level + LEVELS * turn)).alias("x"), "doc", "sid", "n", "label")).alias("s")).select("key", "s.*")
            pairs = _side(rows, "p").join(_side(pivots, "q").hint("merge"), "key").where(_sized(tenths)).drop("key").distinct()
            roots = stored(components(_similar(pairs, sets, tenths), "dense_sets"), "roots")
            dense = roots.selectExpr("node AS a", "root AS b")
            links = dense if links is None else links.unionByName(dense)
            rows = stored(_crossing(_relabelled(rows, roots)), "open")

        crowded = rows.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > CROWD).select("key")
        crowded = stored(crowded if level < LEVELS else crowded.where("false"), "crowded")
        calm = rows.join(crowded.hint("merge"), "key", "left_anti")
        links = links.unionByName(stored(_similar(_all_pairs(calm, sets, tenths), sets, tenths), "links"))
        if not crowded.limit(1).count():
            break
        rest = stored(rows.join(crowded.hint("merge"), "key", "left_semi"), "rest")
        asked = texts.join(rest.select("doc").distinct().hint("merge"), F.col("doc_id") == F.col("doc"), "left_semi")
        again = shingle_sets(asked, words, level).select(F.col("doc_id").alias("doc"), "sid", "bands").dropDuplicates(["doc", "sid"])
        finer = rest.join(again.hint("merge"), ["doc", "sid"]).withColumn("band", F.explode("bands"))
        rows = stored(_crossing(stored(finer.select(F.xxhash64("key", "band").alias("key"), "doc", "sid", "n", "label"), "finer")), "open")
    return components(links, "sets").selectExpr("node AS label", "root")


def one_of_each(docs: DataFrame, words: int = 5, distance: int = 4, tenths: int = 8) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of their component; one row for each id.

    Two rows link if their fingerprints differ in at most ``distance`` bits, or if their sets of word shingles have
    ``tenths`` of their union in common: the former are found by multi-index hashing, the latter by bands of least
    hashes (at similarity 0.8 the bands meet with a probability of 0.99993, above it with a higher one) and compared
    whole. Rows with a null doc_id stay: nothing names the group they would stand for; they link others by their
    fingerprint alone. Texts without words are one group. Other columns are not read.
    """
    prints = stored(shingle_sets(docs, words), "prints")
    labelled = stored(cluster(prints, distance).withColumnRenamed("root", "label"), "labelled")
    more = similar_sets(docs, prints, labelled, words, tenths)
    rooted = labelled.join(more.hint("merge"), "label", "left").select("fp", F.coalesce("root", "label").alias("root"))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    names = stored(rooted.join(least.hint("merge"), "fp").select("root", "doc"), "rooted").groupBy("root").agg(F.min("doc").alias("_kept_id"))
    kept = names.where("_kept_id IS NOT NULL").select("_kept_id").distinct()
    # a join by shuffle at every size: the table of ids grows with the documents
    out = docs.join(stored(kept, "kept").hint("merge"), F.col("doc_id").cast("long") == F.col("_kept_id"), "left_semi")
    if prints.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id IS NULL"))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
