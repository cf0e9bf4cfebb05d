"""Mixing sources to target weights by subset-sum budget fitting (operator 10)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlens.llm.util import doc_columns, in_order, stored, word_count

#: The last words of a budget that dynamic programming fits exactly.
DP_WORDS = 1 << 16


def targets(totals: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) of rows (source, source_size), one for each source.

    All words are shared by weights 1, 2, 3, repeating in code-point order (null last), never above ``cap`` times a
    source's own words, the excess shared again by weight. Sources in order of ``cap`` times size to weight are capped
    first: those before the first whose share of what is left doesn't exceed its bound.
    """
    by_name = in_order(totals.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], "one", "sources")
    weighed = by_name.select("source", "source_size", (F.col("start") % 3 + 1).alias("weight"))
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    sized = in_order(weighed, order, "source_size", "sources").withColumnRenamed("start", "words_before").drop("part")
    placed = stored(in_order(sized, order, "weight", "sources").withColumnRenamed("start", "weight_before"), "sources")
    total = placed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    if not total["weights"]:
        return placed.select("source", "source_size", F.lit(0.0).alias("target"))
    rate = (F.lit(float(total["words"])) - F.lit(cap) * F.col("words_before")) / (F.lit(total["weights"]) - F.col("weight_before"))
    first = placed.select("weight_before", rate.alias("rate"), (F.lit(cap) * F.col("source_size") / F.col("weight")).alias("bound")).where("rate <= bound")
    found = first.agg(F.min_by("rate", "weight_before").alias("rate")).first()["rate"]
    rate = float("inf") if found is None else found
    return placed.select("source", "source_size", F.least(F.lit(rate) * F.col("weight"), F.lit(cap) * F.col("source_size")).alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words come as near below ``budget`` as can be.

    Sizes are distinct and positive. An equal share of every size comes first; single documents, longest
    first, bring the open budget below DP_WORDS; a bounded knapsack over word totals closes it.
    """
    sizes, counts = sizes.astype(object), counts.astype(object)
    whole = int((sizes * counts).sum())
    if budget >= whole:
        return counts.astype(np.int64)
    take = np.array([c * budget // whole for c in counts], dtype=object)
    left = budget - int((sizes * take).sum())
    order = np.argsort(-sizes.astype(np.int64), kind="stable")
    while left > DP_WORDS:
        before = left
        for k in order:
            if left <= DP_WORDS:
                break
            if take[k] < counts[k] and sizes[k] <= left:
                take[k] += 1
                left -= int(sizes[k])
        if left == before:
            break
    limit = min(left, DP_WORDS)
    reach = np.zeros(limit + 1, dtype=bool)
    reach[0] = True
    by = np.full(limit + 1, -1, dtype=np.int64)  # the item that first reached a total
    items: list[tuple[int, int]] = []
    for k in order[::-1]:
        size, free, piece = int(sizes[k]), int(counts[k] - take[k]), 1
        while free > 0 and size * piece <= limit and not reach[limit]:
            piece = min(piece, free)
            if (step := size * piece) > limit:
                break
            new = np.zeros(limit + 1, dtype=bool)
            new[step:] = reach[: limit + 1 - step]
            new &= ~reach
            by[new] = len(items)
            reach |= new
            items.append((int(k), piece))
            free -= piece
            piece *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at > 0:
        k, piece = items[by[at]]
        take[k] += piece
        at -= int(sizes[k]) * piece
    return take.astype(np.int64)


def _sized(docs: DataFrame, seed: int, payload: bool) -> DataFrame:
    """What the mix decides by, beside the row itself, as ``_row``, if ``payload``: id, source, size, and a seeded hash with its bucket of 256."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if payload else []
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = (docs if payload else doc_columns(docs, "doc_id", "source", "text")).select(
        doc_id.alias("_id"), F.col("source").cast("string").alias("_source"), word_count(text).alias("_size"),
        F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(seed), F.xxhash64(text)).alias("_h"), *row,
    )
    return rows.withColumn("_b", F.shiftrightunsigned("_h", 56))


def _plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is taken of each source and size, and of the bucket in which its quota ends.

    Plan (source, size, source_size, target, rounds, edge): ``rounds`` times every row, and once more those of the buckets
    below ``edge``. Groups (g_source, g_size, g_h, g_id, n, take): rows alike in that bucket, and how many of them are taken.
    """
    buckets = stored(sized.groupBy("_source", "_size", "_b").agg(F.count("*").alias("n")), "buckets")
    histogram = buckets.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size")).agg(F.sum("n").alias("n"))
    totals = stored(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "totals")
    wanted = targets(totals)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        words, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        rounds = int(target // words) if words else 0
        rest = round(target - rounds * words)
        real = part["size"].to_numpy() > 0
        extra = np.zeros(len(part), dtype=np.int64)
        if words and rest > 0:
            extra[real] = fit_budget(part["size"].to_numpy()[real], part["n"].to_numpy()[real], rest)
        return part.assign(rounds=np.where(real, rounds, 0), extra=extra)[["source", "size", "source_size", "target", "rounds", "extra"]]

    schema = "source string, size long, source_size long, target double, rounds long, extra long"
    dealt = histogram.alias("h").join(wanted.alias("w"), F.expr("h.source <=> w.source")).select("h.source", "h.size", "h.n", "w.source_size", "w.target")
    quota = stored(dealt.groupBy("source").applyInPandas(fit, schema), "quota")

    upto = Window.partitionBy("_source", "_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).alias("k")
    ends = placed.join(quota.alias("q"), F.expr("k._source <=> q.source AND k._size = q.size AND k.before < q.extra"))
    # buckets are taken whole but for the last one that is reached
    ends = ends.groupBy("q.source", "q.size", "q.extra").agg(F.max(F.struct("k._b", "k.before", "k.n")).alias("x"))
    whole = F.col("extra") >= F.col("x.before") + F.col("x.n")
    ends = ends.select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), (F.col("x._b") + whole.cast("int")).alias("edge"), (F.col("extra") - F.col("x.before")).alias("left"))
    plan = quota.join(ends, F.expr("source <=> e_source AND size = e_size"), "left")
    plan = stored(plan.select("source", "size", "source_size", "target", "rounds", F.coalesce("edge", F.lit(0)).alias("edge"), "left"), "plan")
    inside = sized.join(plan, F.expr("_source <=> source AND _size = size AND _b = edge AND left IS NOT NULL"))
    alike = inside.groupBy("source", "size", "_h", "_id", "left").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("source", "size").orderBy("_h", F.col("_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    take = F.greatest(F.least(F.col("left") - F.coalesce(F.sum("n").over(rank), F.lit(0)), F.col("n")), F.lit(0))
    groups = alike.select(F.col("source").alias("g_source"), F.col("size").alias("g_size"), F.col("_h").alias("g_h"), F.col("_id").alias("g_id"), "n", take.alias("take"))
    return plan, stored(groups, "groups")


def _decided(rows: DataFrame, plan: DataFrame, groups: DataFrame, keep: list) -> DataFrame:
    """The columns to keep of every row, with ``_repeats``: how often the mix takes it."""
    joined = rows.join(plan, F.expr("_source <=> source_ AND _size = size_"))
    outer = joined.where("_b <> edge").select(*keep, (F.col("rounds") + (F.col("_b") < F.col("edge")).cast("long")).alias("_repeats"))
    met = joined.where("_b = edge").join(groups, F.expr("_source <=> g_source AND _size = g_size AND _h = g_h AND _id <=> g_id"), "left")
    some = F.expr("take > 0 AND take < n")
    inner = met.where(~F.coalesce(some, F.lit(False))).select(*keep, (F.col("rounds") + F.coalesce((F.col("take") > 0).cast("long"), F.lit(0))).alias("_repeats"))
    out = outer.unionByName(inner)
    if groups.where(some).isEmpty():
        return out
    # rows alike of which a part is taken: numbered by where they lie, so that a hot group is split
    split = stored(met.where(some).withColumn("_part", F.spark_partition_id()), "split")
    group = ["g_source", "g_size", "g_h", "g_id"]
    counts = split.groupBy(*group, "_part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).withColumnsRenamed({c: f"c{c}" for c in (*group, "_part")})
    same = F.expr("g_source <=> cg_source AND g_size = cg_size AND g_h = cg_h AND g_id <=> cg_id AND _part = c_part")
    rank = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(F.lit(1)))
    parted = split.join(counts, same).withColumn("_rank", F.col("before") + rank)
    return out.unionByName(parted.select(*keep, (F.col("rounds") + (F.col("_rank") <= F.col("take")).cast("long")).alias("_repeats")))


def mix(docs: DataFrame, seed: int = 10) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats, source) for every row of docs.

    A target of r whole rounds and a rest gives every document of the source r repeats; the rest is fitted
    on the histogram of exact sizes, and the documents of each size that get one repeat more are those of
    least seeded hash of id and text. Hashes fall in 256 buckets; after a pre-aggregated count of these only the bucket
    in which a quota ends is ranked, by groups of rows alike, so a hot size or source is split. A null or empty
    text has size 0 and is never taken; a null source is a source of its own, last in order. Rows that repeat a
    doc_id are taken one by one, and of rows alike any. Other columns are not read. An empty table gives no rows.
    """
    sized = stored(_sized(docs, seed, False), "sized")
    plan, groups = _plan(sized)
    keep = [F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.col("_source").alias("source")]
    found = _decided(sized, plan.withColumnsRenamed({"source": "source_", "size": "size_"}), groups, keep)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_repeats")).alias("taken"), F.col("_repeats").alias("repeats"), "source")


def mixed_rows(docs: DataFrame, seed: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it. docs is read more than once."""
    plan, groups = _plan(stored(_sized(docs, seed, False), "sized"))
    plan = plan.select(F.col("source").alias("source_"), F.col("size").alias("size_"), "rounds", "edge")
    found = _decided(_sized(docs, seed, True), plan, groups, ["_row"]).where("_repeats > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select("_row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
