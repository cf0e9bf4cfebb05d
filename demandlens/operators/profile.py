"""The market profile: skills and categories from one pass over the links.

Categories are real bridges: bridge rows (kind, skill_set_id, category_id, is_approved) and categories (kind, id, name, is_active). A skill in several
categories counts in each; approval counts where a kind asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions.numbers import demand_score, growth_ratio, percentage, trend_type

#: Kinds whose bridge rows count only when approved.
APPROVED = ("business", "market")


def in_use(bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """(kind, category, skill_set_id): the bridge rows that count, with the names of their active categories."""
    active = categories.where("is_active").select("kind", F.col("id").alias("category_id"), F.col("name").alias("category"))
    kept = bridge.where(F.col("is_approved") | ~F.col("kind").isin(*APPROVED))
    return kept.join(active, ["kind", "category_id"]).select("kind", "category", "skill_set_id").distinct()


def category_jobs(links: DataFrame, bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """(kind, category, job_count): distinct jobs of each category's skills; categories without any are left out."""
    met = links.select("skill_set_id", "job_post_id").join(in_use(bridge, categories), "skill_set_id")
    return met.groupBy("kind", "category", "job_post_id").agg(F.lit(1)).groupBy("kind", "category").agg(F.count("*").alias("job_count"))


def measures(links: DataFrame, bridge: DataFrame, categories: DataFrame, as_of: str) -> DataFrame:
    """(kind, category, skill_set_id, job_count, rolling_30, rolling_90): one row of each category and, with kind ``skill``, of each skill.

    Links meet the bridge once; grouping sets bring down each skill's and each category's links to one row a job, and a second step counts them.
    """
    rows = links.select("skill_set_id", "job_post_id", "created_at").join(in_use(bridge, categories), "skill_set_id", "left")
    once = rows.groupingSets([["skill_set_id", "job_post_id"], ["kind", "category", "job_post_id"]], "kind", "category", "skill_set_id", "job_post_id")
    once = once.agg(F.max("created_at").alias("last"), F.grouping("kind").alias("of_skill")).where("of_skill = 1 OR kind IS NOT NULL")
    since = lambda days: F.count_if(F.col("last") >= F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {days} DAYS"))
    kind = F.when(F.col("of_skill") == 1, "skill").otherwise(F.col("kind"))
    return once.groupBy(kind.alias("kind"), "category", "skill_set_id").agg(F.count("*").alias("job_count"), since(30).alias("rolling_30"), since(90).alias("rolling_90"))


def market_profile(links: DataFrame, skills: DataFrame, bridge: DataFrame, categories: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    """(list, rank, name, value, share) of the profile's eight lists.

    top_skills (by demand score), fastest_growing and emerging (rising ones) by growth, top_business and top_market with shares of all their kind's jobs, each of
    ``limit`` rows, and all counts of business, market and esco categories. Ties go by name, case ignored for categories, then id. Ranks are cut in each task before
    they meet; the counts of categories are as many as there are.
    """
    found = measures(links, bridge, categories, as_of)
    r30, r90 = F.col("rolling_30"), F.col("rolling_90")
    grown = found.where("kind = 'skill'").join(skills.select(F.col("id").alias("skill_set_id"), "name"), "skill_set_id").withColumn("ratio", growth_ratio(r30, r90))
    grown = grown.withColumns({"growth": F.round("ratio", 4), "score": demand_score(F.col("job_count"), r30, F.col("ratio")), "trend": trend_type(r30, r90, F.col("ratio"))})

    def entry(name: str, value: str, second: Column, when: Column = F.lit(True)) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("list"), F.col(value).cast("double").alias("value"), second.cast("double").alias("second")))

    lists = F.array_compact(F.array(entry("top_skills", "score", F.lit(0)), entry("fastest_growing", "growth", F.lit(0)), entry("emerging", "growth", F.col("score"), F.col("trend") == "rising")))
    of_skills = grown.select(F.explode(lists).alias("x"), "name", F.col("name").alias("sorted_by"), "skill_set_id").select("x.*", "name", "sorted_by", "skill_set_id", F.lit(None).cast("double").alias("share"))

    counts = found.where("kind <> 'skill'").withColumn("share", percentage(F.col("job_count"), F.sum("job_count").over(Window.partitionBy("kind"))))
    names = F.when(F.col("kind").isin("business", "market"), F.array(F.concat(F.lit("top_"), "kind"), F.concat("kind", F.lit("_categories")))).otherwise(F.array(F.concat("kind", F.lit("_categories"))))
    of_kinds = counts.select(F.explode(names).alias("list"), F.col("job_count").cast("double").alias("value"), F.lit(0.0).alias("second"), F.col("category").alias("name"), F.lower("category").alias("sorted_by"), F.lit(0).cast("long").alias("skill_set_id"), "share")
    top = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("value"), F.desc("second"), "sorted_by", "name", "skill_set_id"))
    short = of_skills.unionByName(of_kinds.where("startswith(list, 'top_')")).withColumn("rank", top).where(F.col("rank") <= limit)
    whole = of_kinds.where("NOT startswith(list, 'top_')").withColumn("rank", top)
    share = F.when(F.startswith("list", F.lit("top_")), F.col("share"))
    return short.unionByName(whole).select("list", F.col("rank").cast("long").alias("rank"), "name", "value", share.alias("share"))
