"""Demand and trends of skills, and counts over their categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions.numbers import demand_score, growth_ratio, percentage, trend_type
from demandlens.session import dealt, parts_for


def demand(links: DataFrame, as_of: str) -> DataFrame:
    """One row for each skill with links: counts, first and last sight, rolling distinct jobs, growth, trend and score.

    The look-back windows have no upper bound.
    """
    # a job counts in a window if its latest link to the skill lies there, so one row of each skill and job is enough
    once = links.groupBy("skill_set_id", "job_post_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    since = lambda days: F.count_if(F.col("last") >= F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {days} DAYS"))
    rows = once.groupBy("skill_set_id").agg(
        F.sum("n").alias("total_occurrences"), F.count("*").alias("unique_jobs"), F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"), since(30).alias("rolling_30"), since(90).alias("rolling_90"),
    )
    r30, r90 = F.col("rolling_30"), F.col("rolling_90")
    rows = rows.withColumn("ratio", growth_ratio(r30, r90))
    return rows.withColumns({
        "trend_type": trend_type(r30, r90, F.col("ratio")), "growth_ratio": F.round("ratio", 4), "demand_score": demand_score(F.col("unique_jobs"), r30, F.col("ratio")),
    }).drop("ratio")


def named(demands: DataFrame, skills: DataFrame) -> DataFrame:
    return demands.join(skills.selectExpr("id AS skill_set_id", "name AS skill_name"), "skill_set_id")


def ranked(demands: DataFrame, skills: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first rows by the named measures, largest first, then by name."""
    return named(demands, skills).orderBy(*[F.desc(x) for x in by], "skill_name", "skill_set_id").limit(limit)


def emerging(demands: DataFrame, skills: DataFrame, limit: int = 10) -> DataFrame:
    return ranked(demands.where("trend_type = 'rising'"), skills, ["growth_ratio", "demand_score"], limit)


def trends_with_demand(trends: DataFrame, demands: DataFrame) -> DataFrame:
    """Trends may outlive their demand: a left join."""
    return trends.select("skill_set_id", "trend_type", "growth_ratio").join(demands.select("skill_set_id", "demand_score", "unique_jobs"), "skill_set_id", "left")


def category_counts(rows: DataFrame, category: str, approved_only: bool = False) -> DataFrame:
    """Distinct jobs of each category that has any."""
    kept = rows.where("is_approved") if approved_only else rows
    pairs = kept.select(F.col(category).cast("string").alias("category"), "job_post_id").where("category IS NOT NULL")
    return dealt(pairs, parts_for(rows), "category", "job_post_id").distinct().groupBy("category").agg(F.count("job_post_id").alias("job_count"))


def category_share(counts: DataFrame, limit: int = 5) -> DataFrame:
    """Share of all categories' jobs, of the largest categories."""
    total = counts.agg(F.sum("job_count").alias("total"))
    top = counts.orderBy(F.desc("job_count"), F.lower("category"), "category").limit(limit)
    return top.crossJoin(total).select("category", "job_count", percentage(F.col("job_count"), F.col("total")).alias("share"))


def category_top_skills(demands: DataFrame, skills: DataFrame, category: str, limit: int = 10) -> DataFrame:
    mine = skills.where(F.lower("category") == category.lower())
    return ranked(demands, mine, ["demand_score"], limit)


def active_demand(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """Links of each skill to jobs that are active."""
    active = jobs.where("status = 'ACTIVE'").selectExpr("id AS job_post_id")
    return links.join(active, "job_post_id", "left_semi").groupBy("skill_set_id").agg(F.count("*").alias("demand"))


def stale(demands: DataFrame, links: DataFrame) -> DataFrame:
    """Demand rows whose skill has no link any more."""
    return demands.join(links.select("skill_set_id").distinct(), "skill_set_id", "left_anti")
