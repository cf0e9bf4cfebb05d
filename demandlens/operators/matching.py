"""Set comparisons, resume matching, gaps, and vector search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions.numbers import clamp, percentage
from demandlens.functions.vectors import dot, norm


def application_comparison(applications: DataFrame, application_skills: DataFrame, links: DataFrame) -> DataFrame:
    """Skills of an application against those of its job: matched, missing and extra, by id."""
    mine = application_skills.select("application_id", "skill_set_id", F.lit(True).alias("mine"))
    asked = applications.selectExpr("id AS application_id", "job_post_id").join(links.select("job_post_id", "skill_set_id"), "job_post_id")
    asked = asked.select("application_id", "skill_set_id", F.lit(True).alias("asked"))
    both = mine.join(asked, ["application_id", "skill_set_id"], "full")
    kind = F.when(F.col("mine") & F.col("asked"), "matched").when(F.col("asked"), "missing").otherwise("extra")
    return both.select("application_id", "skill_set_id", kind.alias("kind"))


def comparison_lists(compared: DataFrame) -> DataFrame:
    def ids(kind: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("skill_set_id")))), lambda x: x.cast("string")), ",").alias(kind)

    return compared.groupBy("application_id").agg(ids("matched"), ids("missing"), ids("extra"))


def job_matches(links: DataFrame, resume: DataFrame, jobs: DataFrame, limit: int = 20) -> DataFrame:
    """Jobs that share a skill with the resume; best share first, archived jobs included."""
    marked = links.select("job_post_id", "skill_set_id").join(resume.select("skill_set_id", F.lit(1).alias("own")), "skill_set_id", "left")
    per = marked.groupBy("job_post_id").agg(F.count("own").alias("matched"), F.count("*").alias("required")).where("matched > 0")
    per = per.withColumn("match_percent", percentage(F.col("matched"), F.col("required")))
    named = per.join(jobs.selectExpr("id AS job_post_id", "title", "company_id"), "job_post_id")
    return named.orderBy(F.desc("match_percent"), F.desc("matched"), "company_id", F.lower("title"), "job_post_id").limit(limit)


def job_match_lists(links: DataFrame, resume: DataFrame, skills: DataFrame, first: int = 6) -> DataFrame:
    """(job_post_id, matched, missing, match_percent) of jobs that share a skill with the resume: the names of the shared skills and of the ``first`` others, by id."""
    per_skill = F.struct("skill_set_id", "name")
    marked = links.select("job_post_id", "skill_set_id").distinct().join(resume.select("skill_set_id", F.lit(True).alias("own")), "skill_set_id", "left").join(skills.select(F.col("id").alias("skill_set_id"), "name"), "skill_set_id")
    per = marked.groupBy("job_post_id").agg(F.array_sort(F.collect_list(F.when(F.col("own"), per_skill))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("own").isNull(), per_skill))).alias("x")).where("size(m) > 0")
    names = lambda c: F.transform(c, lambda s: s["name"])
    share = percentage(F.size("m"), F.size("m") + F.size("x"))
    return per.select("job_post_id", names("m").alias("matched"), names(F.slice("x", 1, first)).alias("missing"), share.alias("match_percent"))


def missing_categories(star: DataFrame, resume: DataFrame) -> DataFrame:
    """Categories with jobs in which the resume has no skill."""
    counts = star.groupBy("skill_category").agg(F.countDistinct("job_post_id").alias("job_count"))
    have = star.join(resume, "skill_set_id", "left_semi").select("skill_category").distinct()
    return counts.join(have, "skill_category", "left_anti")


def missing_high_demand(demands: DataFrame, resume: DataFrame, limit: int = 10) -> DataFrame:
    """Of the 2 x limit skills in most demand, those that the resume lacks, at most limit."""
    top = demands.orderBy(F.desc("demand_score"), "skill_set_id").limit(2 * limit)
    return top.join(resume, "skill_set_id", "left_anti").orderBy(F.desc("demand_score"), "skill_set_id").limit(limit)


def recommended(demands: DataFrame, limit: int = 10) -> DataFrame:
    """Demand with 25 more for rising skills."""
    priority = F.col("demand_score") + F.when(F.col("trend_type") == "rising", 25).otherwise(0)
    return demands.withColumn("priority", F.round(priority, 2)).orderBy(F.desc("priority"), "skill_name", "skill_set_id").limit(limit)


def whole_percentages(counts: DataFrame, value: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Whole percents that add up to 100 for each key: each rounded half to even, the rest goes to the first largest. Without keys for a report's few rows."""
    everything = Window.partitionBy(*(keys or []))
    share = F.bround(F.col(value) * 100.0 / F.sum(value).over(everything)).cast("long")
    rows = counts.withColumn("share", share)
    first = F.row_number().over(everything.orderBy(F.desc(value), *order)) == 1
    rest = F.lit(100) - F.sum("share").over(everything)
    return rows.withColumns({"first": first, "rest": rest}).withColumn("percent", F.col("share") + F.when(F.col("first"), F.col("rest")).otherwise(0)).drop("first", "rest", "share")


#: Vectors to a block, of queries and of others; two blocks meet in a group, whose size doesn't grow with the data.
BLOCK = 2000
#: Products of blocks differ from sums in order by far less than this.
NEAR = 1e-9


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, others: bool) -> DataFrame:
    """(query_id, id): for each query and block of vectors the pairs that may be among the ``k`` most similar, equals and what is no number included."""
    by_queries, by_vectors = (max(1, -(-rows.count() // BLOCK)) for rows in (queries, vectors))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select("id", "embedding", block("id", by_vectors).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(by_queries - 1))).alias("p")).where("embedding IS NOT NULL")
    right = queries.select("query_id", "query", block("query_id", by_queries).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(by_vectors - 1))).alias("v")).where("query IS NOT NULL")

    def unit(rows: pd.Series) -> np.ndarray:
        x = np.array([np.asarray(r, dtype="float64") for r in rows]).reshape(len(rows), -1)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def near(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": qs["query_id"][:0], "id": vs["id"][:0]})]
        sizes, asked = vs["embedding"].map(len), qs["query"].map(len)
        for n in set(sizes) & set(asked):
            mine, theirs = vs[sizes == n], qs[asked == n]
            with np.errstate(all="ignore"):
                s = unit(theirs["query"]) @ unit(mine["embedding"]).T
            known = np.where(np.isfinite(s), s, -np.inf)
            same = theirs["query_id"].to_numpy()[:, None] == mine["id"].to_numpy() if others else np.zeros(s.shape, dtype=bool)
            known[same] = -np.inf
            last = np.partition(known, -k, axis=1)[:, -k] if k < known.shape[1] else np.full(len(known), -np.inf)
            q, v = np.nonzero((~np.isfinite(s) | (known >= last[:, None] - NEAR)) & ~same)
            found.append(pd.DataFrame({"query_id": theirs["query_id"].to_numpy()[q], "id": mine["id"].to_numpy()[v]}))
        return pd.concat(found)

    kind = {**dict(vectors.dtypes), **dict(queries.dtypes)}
    return left.groupBy("v", "p").cogroup(right.groupBy("v", "p")).applyInPandas(near, f"query_id {kind['query_id']}, id {kind['id']}").distinct()


def similarities(vectors: DataFrame, queries: DataFrame, k: int, others: bool = False) -> DataFrame:
    """(query_id, id, similarity) of vectors (id, embedding) and queries (query_id, query): for each query the ``k`` most similar vectors at least,
    equals and some more included, zero vectors left out; with ``others`` none of the query's own id.

    Every block of queries meets every block of vectors as a product of matrices, which only leaves out pairs; those that stay are worked out again
    by sums in order. All pairs are looked at, so a search of n queries in m vectors takes n times m.
    """
    met = _nearest(vectors, queries, k, others)
    left = vectors.select("id", F.col("embedding").alias("e"), norm(F.col("embedding")).alias("ne"))
    right = queries.select("query_id", F.col("query").alias("q"), norm(F.col("query")).alias("nq"))
    both = met.join(left, "id").join(right, "query_id").where(F.size("e") == F.size("q"))
    return both.select("query_id", "id", (dot(F.col("e"), F.col("q")) / F.nullif(F.col("ne") * F.col("nq"), F.lit(0.0))).alias("similarity")).where("similarity IS NOT NULL")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact nearest neighbours by cosine of rows (query_id, query), k of them or as many as there are; a negative similarity is given as 0.

    Equals go by the vectors' ``name``, if they have one, then by id.
    """
    pairs = similarities(vectors, queries, k, others=True)
    by = ["id"]
    if "name" in vectors.columns:
        pairs, by = pairs.join(vectors.select("id", "name"), "id"), ["name", "id"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), *by))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("similarity", F.greatest("similarity", F.lit(0.0)))


def market_matches(resume: DataFrame, vectors: DataFrame, skills: DataFrame, demands: DataFrame) -> DataFrame:
    """(query_id, id, similarity, demand) of each active skill of a resume: itself with 1 if it is in demand, else the most
    similar skill in demand that has a vector, the first by name of equals; without one null with 0."""
    wanted = demands.select(F.col("skill_set_id").alias("id"), "demand")
    mine = resume.select(F.col("skill_set_id").alias("query_id")).join(skills.where("is_active").select(F.col("id").alias("query_id")), "query_id", "left_semi")
    own = mine.join(wanted.withColumnRenamed("id", "query_id"), "query_id", "left").withColumnRenamed("demand", "own_demand")
    offered = vectors.join(wanted, "id")
    queries = vectors.selectExpr("id AS query_id", "embedding AS query").join(own.where("own_demand IS NULL"), "query_id", "left_semi")
    pairs = similarities(offered.select("id", "embedding"), queries, 1).join(skills.select("id", "name"), "id")
    best = pairs.groupBy("query_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "name", "id")).alias("x"))
    best = best.select("query_id", F.col("x.id").alias("id"), clamp(-F.col("x.s"), 0.0, 1.0).alias("similarity")).join(wanted, "id", "left")
    both = own.join(best, "query_id", "left")
    direct = F.col("own_demand").isNotNull()
    return both.select(
        "query_id", F.when(direct, F.col("query_id")).otherwise(F.col("id")).alias("id"), F.when(direct, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"),
        F.coalesce("own_demand", "demand", F.lit(0)).cast("long").alias("demand"),
    )


def most_similar_per_market(resume: DataFrame, market: DataFrame) -> DataFrame:
    """For each market vector, its largest similarity to the resume's."""
    best = similarities(resume.selectExpr("query_id AS id", "query AS embedding"), market.selectExpr("id AS query_id", "embedding AS query"), 1)
    best = best.groupBy(F.col("query_id").alias("id")).agg(F.max("similarity").alias("best"))
    return market.select("id").join(best, "id", "left").select("id", clamp(F.coalesce("best", F.lit(0.0)), 0.0, 1.0).alias("similarity"))


def market_fit(matches: DataFrame, *keys: str) -> DataFrame:
    """Mean similarity of a resume's skills in percent, weighed by the demand of what they match; one counts as matched from 0.7 on. One row for each key, or for all."""
    weighed = F.when(F.col("demand") > 0, F.col("demand"))
    fit = clamp(F.sum(weighed * F.col("similarity")) / F.sum(weighed), 0.0, 1.0)
    return matches.groupBy(*keys).agg(F.round(100 * F.coalesce(fit, F.lit(0.0)), 1).alias("fit_percent"), F.count_if(F.col("similarity") >= 0.7).alias("matched"), F.count("*").alias("skills"))
