"""Backfills that bring stored tables to a later form; each is a plan of next rows, and a second run changes nothing.

See also ``merges.backfill_job_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.session import whole_unions


def reset_status(jobs: DataFrame) -> DataFrame:
    """(id, status, action): every job active; null counts as another status."""
    return jobs.select("id", F.lit("ACTIVE").alias("status"), F.when(F.col("status").eqNullSafe("ACTIVE"), "keep").otherwise("update").alias("action"))


def mark_applied(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """(id, status, action): jobs with an application become APPLIED, archived ones stay."""
    asked = applications.select(F.col("job_post_id").alias("id")).where("id IS NOT NULL").distinct().withColumn("asked", F.lit(True))
    both = jobs.select("id", "status").join(asked, "id", "left")
    change = F.col("asked").isNotNull() & ~F.col("status").eqNullSafe("ARCHIVED") & ~F.col("status").eqNullSafe("APPLIED")
    return both.select("id", F.when(change, "APPLIED").otherwise(F.col("status")).alias("status"), F.when(change, "update").otherwise("keep").alias("action"))


def migrate_links(links: DataFrame, legacy: DataFrame, parent: str, origin: str) -> DataFrame:
    """Links (parent, skill_set_id, score, source_type, metadata) with those of an older bridge (parent, skill_set_id) that are missing, each once.

    New ones are manual, of score 0, and say the table that they come from; older rows with a null key are left out.
    """
    whole_unions(legacy.sparkSession)
    keys = [parent, "skill_set_id"]
    new = legacy.select(*keys).dropna().distinct().join(links.select(*keys), keys, "left_anti")
    made = new.select(*keys, F.lit(0).alias("score"), F.lit("MANUAL").alias("source_type"), F.to_json(F.struct(F.lit(origin).alias("migrated_from"))).alias("metadata"), F.lit("insert").alias("action"))
    return links.select(*keys, "score", "source_type", "metadata", F.lit("keep").alias("action")).unionByName(made)


def keyword_backfill(skills: DataFrame, keywords: DataFrame) -> DataFrame:
    """Keywords to add (skill_set_id, normalized, raw_text, source, is_primary) for skills (id, name, aliases): the name, then aliases in order.

    Of a skill's texts of one normalised form the first counts, blank ones none; those that keywords (skill_set_id, normalized) has are left out.
    """
    named = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = skills.select(F.col("id").alias("skill_set_id"), F.posexplode(named).alias("at", "text")).withColumn("raw_text", T.clean_keyword(F.col("text")))
    rows = rows.withColumn("normalized", F.lower("raw_text")).where("normalized <> ''")
    first = rows.groupBy("skill_set_id", "normalized").agg(F.min(F.struct("at", "raw_text")).alias("x")).join(keywords.select("skill_set_id", "normalized"), ["skill_set_id", "normalized"], "left_anti")
    own = F.col("x.at") == 0
    return first.select("skill_set_id", "normalized", "x.raw_text", F.when(own, "CANONICAL").otherwise("ALIAS").alias("source"), own.alias("is_primary"))


def listing_pages(sources: DataFrame) -> DataFrame:
    """(id, url, parser_type, source_name): the one page of listings of each source (id, name, base_url, url, resource); sources without any address have none."""
    url = F.coalesce(F.nullif("base_url", F.lit("")), F.nullif("url", F.lit("")))
    rows = sources.withColumn("page", url).where("page IS NOT NULL")
    return rows.select("id", F.col("page").alias("url"), T.detect_source(F.col("page"), F.col("resource")).alias("parser_type"), F.coalesce("name", F.lit("")).alias("source_name"))
