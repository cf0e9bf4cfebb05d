"""Search of jobs and applications: every token must be met by the row itself or by one of its skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.text import JOB_TYPES


def _mask(tokens: list[str], fields: list[Column]) -> Column:
    """A bit for each token that a field contains, case ignored."""
    out = F.lit(0)
    for k, token in enumerate(tokens):
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(f).contains(token.lower()), F.lit(False))
        out = out + F.when(hit, 1 << k).otherwise(0)
    return out.cast("int")


def _job_mask(tokens: list[str], fields: list[str], job_type: str) -> Column:
    """As above; a token that names a job type also meets the type's usual spelling."""
    out = F.lit(0)
    for k, token in enumerate(tokens):
        label = JOB_TYPES.get(" ".join(token.replace("_", " ").lower().split()), token)
        one = (_mask([token], [F.col(c) for c in fields]) == 1) | (_mask([label], [F.col(job_type)]) == 1)
        out = out + F.when(one, 1 << k).otherwise(0)
    return out.cast("int")


def skill_masks(skills: DataFrame, keywords: DataFrame, tokens: list[str]) -> DataFrame:
    """(skill_set_id, mask): what tokens each skill with one of its keywords meets; skills that meet none are left out.

    skills: id, name; keywords: skill_set_id, raw_text, of those in use.
    """
    both = skills.selectExpr("id AS skill_set_id", "name").join(keywords.select("skill_set_id", "raw_text"), "skill_set_id", "left")
    return both.select("skill_set_id", _mask(tokens, [F.col("name"), F.col("raw_text")]).alias("mask")).where("mask > 0").distinct()


def _of_owner(links: DataFrame, owner: str, masks: DataFrame, name: str) -> DataFrame:
    """The distinct masks of each owner's skills: at most two to the power of the number of tokens."""
    return links.select(owner, "skill_set_id").join(masks, "skill_set_id").groupBy(owner).agg(F.collect_set("mask").alias(name))


def search_jobs(jobs: DataFrame, links: DataFrame, skills: DataFrame, keywords: DataFrame, tokens: list[str]) -> DataFrame:
    """Ids of jobs (id, title, company_name, location, remote_type, employment_type, status) that the tokens fit, all those that the
    job doesn't meet itself by the same skill. Skills are filtered before they meet their links."""
    own = _job_mask(tokens, ["title", "company_name", "location", "remote_type", "employment_type", "status"], "employment_type")
    found = _of_owner(links, "job_post_id", skill_masks(skills, keywords, tokens), "masks").withColumnRenamed("job_post_id", "id")
    every = (1 << len(tokens)) - 1
    both = jobs.withColumn("own", own).join(found, "id", "left")
    by_skill = F.coalesce(F.exists("masks", lambda m: m.bitwiseOR(F.col("own")) == every), F.lit(False))
    return both.where((F.col("own") == every) | by_skill).select("id")


def search_applications(applications: DataFrame, own_skills: DataFrame, job_links: DataFrame, skills: DataFrame, keywords: DataFrame, tokens: list[str]) -> DataFrame:
    """Ids of applications (id, job_post_id, application_status and the job's fields) that the tokens fit: themselves, by one skill
    of their own, and by one skill of the job."""
    masks = skill_masks(skills, keywords, tokens)
    own = _job_mask(tokens, ["title", "company_name", "location", "remote_type", "employment_type", "application_status"], "employment_type")
    none = F.array(F.lit(0))
    mine = _of_owner(own_skills, "application_id", masks, "mine").withColumnRenamed("application_id", "id")
    asked = _of_owner(job_links, "job_post_id", masks, "asked")
    both = applications.withColumn("own", own).join(mine, "id", "left").join(asked, "job_post_id", "left")
    left, right = (F.concat(none, F.coalesce(c, F.array().cast("array<int>"))) for c in (F.col("mine"), F.col("asked")))
    fits = F.exists(left, lambda a: F.exists(right, lambda b: F.col("own").bitwiseOR(a).bitwiseOR(b) == (1 << len(tokens)) - 1))
    return both.where(fits).select("id")
