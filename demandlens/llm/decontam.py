"""Benchmark decontamination by SimHash of item-sized windows and multi-index Hamming blocks (operator 5); DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from demandlens.llm.util import doc_columns, stored

WORDS = 5
SIMILARITY = 0.8
#: Tables of at most so many rows of a few numbers are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Widths of the blocks of a fingerprint, and how many open bits a block has at most of which every value is filed.
WIDTHS = (64, 32, 16, 8)
OPEN_BITS = 7
_BLANKS = " \t\n\x0b\x0c\r"
_LANES = 32
_LANE = 0x0000000100000001


def words_of(text: Column) -> Column:
    """Words of a lower-cased text; none for null and blank texts."""
    bare = F.btrim(F.lower(text), F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingles(k: int) -> Column:
    """Hashes of the k-word shingles of the column ``words``, in order."""
    last = F.size("words") - k
    one = lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<long>"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows that repeat have the same pair of them and the same matches."""
    return doc_columns(docs, "doc_id", "text").where("text IS NOT NULL").withColumn("key", F.xxhash64("text"))


def _by_size(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """The columns to keep, k and the array of shingles for each shingle size; each text is cut once.

    The outer form, since a filter that Spark infers for the other would cut each text anew.
    """
    worded = rows.select(*keep, words_of(F.col("text")).alias("words"))
    both = F.array(*[F.struct(F.lit(k).alias("k"), shingles(k).alias("s")) for k in sizes])
    return worded.select(*keep, F.explode_outer(both).alias("x")).select(*keep, "x.k", "x.s")


def item_shingles(benchmark: DataFrame, words: int = WORDS) -> tuple[DataFrame, list[int]]:
    """(item_id, n, k, m, h, c): an item's words, shingle size, number of shingles, and each shingle with its count.

    An item of fewer words than a shingle is one shingle of all its words. Items without a word match nothing.
    """
    items = doc_columns(benchmark, "item_id", "text").withColumn("n", F.size(words_of(F.col("text")))).where("n > 0")
    items = stored(items.withColumn("size", F.least("n", F.lit(words))), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``words`` rows
    if not sizes:
        return items.selectExpr("item_id", "n", "0 AS k", "0 AS m", "0L AS h", "0L AS c"), []
    cut = _by_size(items, ["item_id", "n", "size"], sizes).where("k = size")
    flat = cut.select("item_id", "n", "k", F.size("s").alias("m"), F.explode_outer("s").alias("h"))
    return stored(flat.groupBy("item_id", "n", "k", "m", "h").agg(F.count("*").alias("c")), "item_shingles"), sizes


def _lanes(hash_: Column) -> list[Column]:
    """The 64 bits of a hash as 32 pairs of 32-bit counters; a text has too few shingles to overflow one."""
    return [F.shiftrightunsigned(hash_, j).bitwiseAND(F.lit(_LANE)) for j in range(_LANES)]


def _excess() -> Column:
    """From sums l0 to l31 of lanes and ``total``: for each bit, twice its count less the total."""
    lanes = F.array(*[F.col(f"l{j}") for j in range(_LANES)])
    low = F.transform(lanes, lambda x: 2 * x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.col("total"))
    high = F.transform(lanes, lambda x: 2 * F.shiftrightunsigned(x, 32) - F.col("total"))
    return F.concat(low, high)


def _bits(excess: Column, holds) -> Column:
    """A 64-bit number of the bits whose excess the condition holds for."""
    ones = F.transform(excess, lambda x, i: F.when(holds(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _block(value: Column, width: int, place: int) -> Column:
    return value if width == 64 else F.shiftrightunsigned(value, width * place).bitwiseAND(F.lit((1 << width) - 1))


def _subsets(mask: Column) -> Column:
    """All numbers whose bits lie in the mask."""
    one = F.lit(1).cast("long")
    bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", one, i).bitwiseAND(mask)), lambda x: x != 0)
    return F.aggregate(bits, F.array(F.lit(0).cast("long")), lambda a, b: F.concat(a, F.transform(a, lambda x: x.bitwiseOR(b))))


def item_index(items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(n, width, place, value, item_id, item_fp, fixed): the table in which windows of n words are looked up.

    A window of a similarity s or more shares so much with an item of m shingles that the excess of a bit differs by
    2m (1 - s) / (1 + s) at most. Bits whose excess is larger are fixed: every such window has them as the item has.
    The others are open, and their number is the item's radius. The item is filed under all values that the open
    bits of one block allow: the widest of at most OPEN_BITS open bits, and of equal ones that of fewest; an item
    without such a block is filed under no value and met by every window of its length.
    """
    sums = items.groupBy("item_id", "n", "m").agg(*[F.sum(x * F.col("c")).alias(f"l{j}") for j, x in enumerate(_lanes(F.col("h")))])
    most = F.floor(F.col("m") * F.lit(2 * (1 - similarity) / (1 + similarity)) + F.lit(1e-6))
    marked = sums.withColumn("total", F.col("m").cast("long")).withColumn("excess", _excess()).withColumn("most", most)
    prints = stored(
        marked.select(
            "item_id", "n", _bits(F.col("excess"), lambda x: x > 0).alias("item_fp"),
            _bits(F.col("excess"), lambda x: (x > F.col("most")) | (x <= -F.col("most"))).alias("fixed"),
        ),
        "item_prints",
    )
    blocks = []
    for width in WIDTHS:
        for place in range(64 // width):
            open_ = _block(F.bitwise_not("fixed"), width, place)
            n_open = F.bit_count(open_)
            blocks.append(F.struct(
                (n_open > OPEN_BITS).alias("loose"), F.lit(-width).alias("narrow"), n_open.alias("n_open"), F.lit(place).alias("place"),
                open_.alias("open"), _block(F.col("item_fp"), width, place).alias("own"),
            ))
    best = prints.withColumn("x", F.array_min(F.array(*blocks)))
    shut = F.when(F.col("x.loose"), F.array(F.lit(0).cast("long"))).otherwise(F.transform(_subsets(F.when(~F.col("x.loose"), F.col("x.open")).otherwise(0)), lambda b: b.bitwiseXOR(F.col("x.own"))))
    width, place = F.when(F.col("x.loose"), 0).otherwise(-F.col("x.narrow")), F.when(F.col("x.loose"), 0).otherwise(F.col("x.place"))
    return stored(best.select("n", width.alias("width"), place.alias("place"), F.explode(shut).alias("value"), "item_id", "item_fp", "fixed"), "item_index")


def probes(fp: Column) -> Column:
    """Where a window's fingerprint is looked up: all its blocks, and the place of items without a block."""
    blocks = [F.struct(F.lit(w).alias("width"), F.lit(p).alias("place"), _block(fp, w, p).alias("value")) for w in WIDTHS for p in range(64 // w)]
    return F.array(*blocks, F.struct(F.lit(0).alias("width"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("value")))


def windows_of(docs: DataFrame, items: DataFrame, sizes: list[int], similarity: float) -> tuple[DataFrame, DataFrame]:
    """Windows (doc_id, key, k, n, m, length, size, start) of as many words as an item has, and the shingles (doc_id, key, k, p, h) in them.

    A window has as many words as the item (the whole text if that is shorter). One that holds too few shingles of
    any item to reach the similarity s with one, fewer than s / (1 + s) of both together, is left out, which loses nothing.
    """
    rows = _keyed(docs)
    id_ = ["doc_id", "key", "k"]
    positions = _by_size(rows, ["doc_id", "key", "text"], sizes).select(*id_, F.size("s").alias("size"), F.posexplode_outer("s").alias("p", "h"))
    wanted = stored(items.select("k", "h").distinct(), "wanted")
    hits = positions.join(_small(wanted), ["k", "h"]).groupBy(*id_, "size").agg(F.array_sort(F.collect_set("p")).alias("at"))
    lengths = _small(stored(items.select("n", "k", "m").distinct(), "lengths"))
    length = F.least("m", "size")
    need = F.ceil(F.lit(similarity / (1 + similarity) - 1e-9) * (F.col("m") + F.col("length"))).cast("int")
    spots = stored(hits, "hits").join(lengths, "k").withColumn("length", length).withColumn("need", need).where(F.size("at") >= F.col("need"))
    # window starts for which the i-th to (i + need - 1)-th of those shingles lie inside
    spans = F.transform(
        F.sequence(F.lit(0), F.size("at") - F.col("need")),
        lambda i: F.struct(
            F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("length") + 1).alias("lo"),
            F.least(F.get("at", i), F.col("size") - F.col("length")).alias("hi"),
        ),
    )
    spans = F.filter(spans, lambda x: x["lo"] <= x["hi"])
    # both ends rise along the array, so a start that lies in an earlier span too lies in the one before
    later = lambda all_: F.transform(all_, lambda x, i: F.struct(F.when(i > 0, F.greatest(x["lo"], F.get(all_, i - 1)["hi"] + 1)).otherwise(x["lo"]).alias("lo"), x["hi"].alias("hi")))
    cut = F.get(F.transform(F.array(spans), later), 0)  # the spans are worked out once
    starts = F.flatten(F.transform(F.filter(cut, lambda x: x["lo"] <= x["hi"]), lambda x: F.sequence(x["lo"], x["hi"])))
    found = stored(spots.withColumn("start", F.explode(starts)).select(*id_, "n", "m", "length", "size", "start"), "windows")

    held = found.groupBy("doc_id", "key").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("length")).alias("high"))
    held = stored(held.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "held")
    again = rows.join(_small(held), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("doc_id", "key", "low", "high", "text").dropDuplicates(["doc_id", "key"])
    part = _by_size(again, ["doc_id", "key", "low", "high", "text"], sizes)
    part = part.select(*id_, "low", F.posexplode_outer(F.slice("s", F.col("low") + 1, F.col("high") - F.col("low"))).alias("i", "h")).where("i IS NOT NULL")
    return found, stored(part.select(*id_, (F.col("low") + F.col("i")).alias("p"), "h"), "shingles")


def window_prints(windows: DataFrame, shingled: DataFrame) -> DataFrame:
    """windows with their fingerprint fp: bits set in over half of a window's shingles.

    Running sums over the shingles of a text, read where a window begins and where it ends, so that the work grows
    with shingles and windows, not with their product.
    """
    id_, window = ["doc_id", "key", "k"], ["n", "m", "length", "size", "start"]
    ends = windows.select(*id_, *window, F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(-1).alias("sign")), F.struct((F.col("start") + F.col("length")).alias("p"), F.lit(1).alias("sign")))).alias("x"))
    ends = ends.select(*id_, *window, "x.p", "x.sign", F.lit(0).cast("long").alias("h"))
    blank = [F.lit(None).cast("int").alias(c) for c in window]
    both = shingled.select(*id_, *blank, "p", F.lit(0).alias("sign"), "h").unionByName(ends)
    upto = Window.partitionBy(*id_).orderBy("p", F.desc(F.col("sign") != 0)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row of a window's end adds no hash, and stands before the shingle at its place
    sums = both.select(*id_, *window, "sign", *[F.sum(x).over(upto).alias(f"l{j}") for j, x in enumerate(_lanes(F.col("h")))]).where("sign <> 0")
    found = sums.groupBy(*id_, *window).agg(*[F.sum(F.col("sign") * F.col(f"l{j}")).alias(f"l{j}") for j in range(_LANES)])
    found = found.withColumn("total", F.col("length").cast("long")).withColumn("excess", _excess())
    return stored(found.select(*id_, *window, _bits(F.col("excess"), lambda x: x > 0).alias("fp")), "window_prints")


def most_alike(pairs: DataFrame, shingled: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, m, length, start, shared): of all windows of a text between ``low`` and ``high``, the first of those that share most with an item.

    A shingle counts in a window if fewer of its kind than the item has stand before it there. So each place adds one to
    the windows of one range of starts; a running sum over the ends of these ranges gives every window's exact count.
    """
    by = ["doc_id", "key", "item_id", "m", "length"]
    near = pairs.alias("a").join(shingled.alias("s"), F.expr("a.doc_id <=> s.doc_id AND a.key = s.key AND a.k = s.k AND s.p >= a.low AND s.p < a.high"))
    near = near.select("a.doc_id", "a.key", "a.item_id", "a.m", "a.length", "a.size", "s.p", "s.h")
    met = near.join(_small(items.select("item_id", "h", "c")), ["item_id", "h"])
    met = met.groupBy(*by, "size", "h", "c").agg(F.array_sort(F.collect_list("p")).alias("at"))
    since = F.transform(
        "at", lambda p, i: F.struct(p.alias("p"), F.greatest(F.lit(0), p - F.col("length") + 1, F.when(i >= F.col("c"), F.get("at", (i - F.col("c")).cast("int")) + 1).otherwise(0)).alias("lo"))
    )
    steps = met.select(*by, "size", F.explode(F.flatten(F.transform(since, lambda x: F.array(F.struct(x["lo"].alias("start"), F.lit(1).alias("d")), F.struct((x["p"] + 1).alias("start"), F.lit(-1).alias("d")))))).alias("x"))
    steps = steps.groupBy(*by, "size", "x.start").agg(F.sum("x.d").alias("d"))
    shared = F.sum("d").over(Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = steps.withColumn("shared", shared).where(F.col("start") <= F.col("size") - F.col("length"))
    best = level.groupBy(*by).agg(F.max(F.struct("shared", (-F.col("start")).alias("before"))).alias("x"))
    return best.select(*by, (-F.col("x.before")).alias("start"), F.col("x.shared").alias("shared"))


def matches(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, bits, key): each document and item with a window alike, and the best one.

    A window has as many words as the item (the whole text if that is shorter). The windows of ``windows_of`` are
    fingerprinted and looked up in the blocks of ``item_index``, which holds every fingerprint that a window alike can
    have, so no match is lost. The exact weighted similarity of the pairs found, the shared part of both multisets of
    shingles, decides. ``bits``: in how many bits the fingerprints differ. ``start`` counts words from 0; of equal windows
    the first is given.

    Null and blank texts and items match nothing. Texts that repeat under one doc_id give one row. Other columns are
    not read.
    """
    spark = docs.sparkSession
    items, sizes = item_shingles(benchmark, words)
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, start long, n_words long, similarity double, bits int, key long")
    index = _small(item_index(items, similarity))
    windows, shingled = windows_of(docs, items, sizes, similarity)
    prints = window_prints(windows, shingled)
    asked = prints.withColumn("x", F.explode(probes(F.col("fp")))).select("*", "x.width", "x.place", "x.value").drop("x")
    same = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = asked.join(index, ["n", "width", "place", "value"]).where(same.bitwiseAND(F.col("fixed")) == 0)
    near = stored(near.select("doc_id", "key", "k", "n", "m", "length", "size", "start", "item_id", F.bit_count(same).alias("bits")), "candidates")
    pairs = near.groupBy("doc_id", "key", "k", "n", "m", "length", "size", "item_id").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("length")).alias("high"))
    best = most_alike(pairs, shingled, items).withColumn("similarity", F.col("shared") / (F.col("m") + F.col("length") - F.col("shared"))).where(F.col("similarity") >= similarity)
    at = F.expr("b.doc_id <=> c.doc_id AND b.key = c.key AND b.item_id = c.item_id AND b.start = c.start")
    return best.alias("b").join(near.alias("c"), at).select(
        "b.doc_id", "b.item_id", F.col("b.start").cast("long").alias("start"), F.col("c.n").cast("long").alias("n_words"), "b.similarity", "c.bits", "b.key"
    )


def without_matches(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of docs that match no item, with all their columns."""
    found = matches(docs, benchmark, **settings).select(F.col("doc_id").alias("_match_id"), F.col("key").alias("_match_key")).distinct()
    keyed = docs.withColumn("_text_key", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_match_id")) & (F.col("_text_key") == F.col("_match_key"))
    return keyed.join(_small(stored(found, "matched")), same, "left_anti").drop("_text_key")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"), "bits")
