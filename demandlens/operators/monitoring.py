"""Dashboards and pipeline monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions.numbers import mean2, percentage

#: Labels of application states.
STATUS_LABELS = {"SAVED": "Saved", "APPLIED": "Applied", "REJECTED": "Rejected", "TECH": "Technical", "OFFER": "Offer"}


def kpis(jobs: DataFrame, applications: DataFrame, companies: DataFrame, sources: DataFrame, today: str) -> DataFrame:
    """One row of headline counts."""
    day = F.to_date("applied_at") == F.lit(today).cast("date")
    parts = [
        jobs.agg(F.count("*").alias("jobs")), applications.agg(F.count("*").alias("applications"), F.count_if(day).alias("applied_today")),
        companies.join(jobs.selectExpr("company_id AS id").distinct(), "id", "left_semi").agg(F.count("*").alias("companies_with_jobs")),
        sources.agg(F.count_if("enabled").alias("enabled_sources")),
    ]
    return reduce(DataFrame.crossJoin, parts)


def labelled_counts(rows: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    lookup = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("label", F.coalesce(F.try_element_at(lookup, F.col(key)), F.col(key)))


def breakdown(jobs: DataFrame, field: str, limit: int = 5) -> DataFrame:
    """Non-blank values by count; shares are of the rows shown."""
    top = jobs.where(F.coalesce(F.col(field), F.lit("")) != "").groupBy(F.col(field).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(limit)
    return top.crossJoin(top.agg(F.sum("n").alias("total"))).select("label", "n", percentage(F.col("n"), F.col("total")).alias("share"))


def snapshot(counted: DataFrame, limit: int = 6) -> DataFrame:
    """The first rows by jobs; shares are of the first."""
    top = counted.orderBy(F.desc("job_count"), "skill_name", "skill_set_id").limit(limit)
    return top.crossJoin(top.agg(F.max("job_count").alias("best"))).select("skill_set_id", "skill_name", "job_count", percentage(F.col("job_count"), F.col("best")).alias("share"))


def status_mix(jobs: DataFrame, links: DataFrame) -> DataFrame:
    counts = jobs.agg(F.count("*").alias("jobs"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("ACTIVE", "APPLIED", "ARCHIVED")])
    both = counts.crossJoin(links.agg(F.count("*").alias("links"), F.sum("score").alias("total")))
    shares = [percentage(F.col(s), F.col("jobs")).alias(f"{s}_share") for s in ("active", "applied", "archived")]
    return both.select("jobs", "active", "applied", "archived", *shares, "links", mean2(F.col("total"), F.col("links")).alias("avg_score"))


def step_summary(logs: DataFrame, limit: int = 20) -> DataFrame:
    per = logs.groupBy("step_name", "status").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"), F.sum("duration_ms").alias("total"), F.count("duration_ms").alias("timed"))
    return per.orderBy("step_name", "status").limit(limit).select("step_name", "status", "n", "last_at", mean2(F.col("total"), F.col("timed")).alias("avg_ms"))


def errors_by(logs: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    rows = logs.where((F.col("status") == "FAILED") & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), key)
    return rows.limit(limit) if limit else rows


def recent(rows: DataFrame, at: str, limit: int, key: str = "id") -> DataFrame:
    return rows.orderBy(F.col(at).desc_nulls_last(), F.desc(key)).limit(limit)


def flow_durations(logs: DataFrame, limit: int = 50) -> DataFrame:
    """Of the newest rows: a step's own duration, else the time since the older row of its run among them, else 0."""
    page = recent(logs, "created_at", limit)
    before = F.lag(F.struct("crawl_run_id", "created_at")).over(Window.orderBy("created_at", "id"))  # over the page only
    gap = F.timestamp_diff("MILLISECOND", F.col("before.created_at"), F.col("created_at"))
    own = F.when(F.col("before.crawl_run_id") == F.col("crawl_run_id"), gap).otherwise(0)
    return page.withColumn("before", before).select("id", "crawl_run_id", "step_name", F.coalesce("duration_ms", own).cast("long").alias("flow_ms"))


def latest_per(rows: DataFrame, keys: list[str], at: str = "created_at") -> DataFrame:
    """The newest row of each key, by a pre-aggregated max."""
    rest = [c for c in rows.columns if c not in keys]
    order = [at, "id", *[c for c in rest if c not in (at, "id")]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def progress(done: Column, total: Column, finished: Column) -> Column:
    """Percent with two places; an empty run is complete once it has finished."""
    share = F.floor((done * 20000 + total) / F.when(total > 0, 2 * total)) / F.lit(100.0)
    return F.coalesce(share, F.when(finished, 100.0).otherwise(0.0))


def duration_display(ms: Column) -> Column:
    """Minutes and seconds, the seconds rounded half to even."""
    seconds = F.greatest(F.bround(F.coalesce(ms, F.lit(0)) / 1000.0).cast("long"), F.lit(0))
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), seconds % 60)


#: Progress that a log row of a step and a status stands for.
STAGES = {
    ("crawl_run", "INFO"): 3, ("celery_task", "STARTED"): 5, ("crawl_run", "STARTED"): 10, ("source_crawl", "STARTED"): 20, ("source_detection", "SUCCESS"): 30,
    ("listing_discovery", "SUCCESS"): 40, ("job_extraction", "SUCCESS"): 55, ("job_source_filter", "INFO"): 60, ("company_upsert", "SUCCESS"): 65, ("job_upsert", "SUCCESS"): 70,
    ("job_close_detection", "SUCCESS"): 72, ("company_sync", "SUCCESS"): 75, ("source_sync", "SUCCESS"): 80, ("ollama_extract", "STARTED"): 82, ("ollama_extract", "SUCCESS"): 85,
    ("ollama_verify", "STARTED"): 87, ("ollama_verify", "SUCCESS"): 90, ("skillset_mapping", "SUCCESS"): 92, ("skill_scoring", "SUCCESS"): 94, ("skill_attach", "SUCCESS"): 96,
    ("skill_pipeline", "SUCCESS"): 98, ("source_crawl", "SUCCESS"): 99, ("crawl_progress", "INFO"): 99, ("crawl_run", "SUCCESS"): 100, ("crawl_run", "FAILED"): 100,
}
#: Metrics of a log row in the order shown; those with True are shown as 0 if absent.
METRICS = [
    ("jobs_created", "Created", True), ("jobs_updated", "Updated", True), ("jobs_closed", "Closed", True), ("errors", "Errors", True), ("jobs_filtered", "Filtered", False),
    ("jobs_deduped", "Deduped", False), ("skill_pipeline_jobs_processed", "Skill jobs", False), ("skills_attached", "Skills attached", False), ("skill_pipeline_failures", "Skill failures", False),
]


def stage_progress(logs: DataFrame) -> DataFrame:
    """The furthest stage of each run, from the step and status of its log rows."""
    lookup = F.create_map(*[F.lit(x) for (step, status), n in STAGES.items() for x in (f"{step} {status}", n)])
    value = F.coalesce(F.try_element_at(lookup, F.concat_ws(" ", "step_name", "status")), F.lit(0))
    return logs.groupBy("crawl_run_id").agg(F.max(value).cast("long").alias("progress"))


def display_progress(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """100 for a run that has ended; else what is complete and the stage's share of one source, below 100. Columns of runs: id, status, total_sources, progress_percentage."""
    both = runs.join(stages.withColumnRenamed("crawl_run_id", "id"), "id", "left")
    share = F.coalesce("progress", F.lit(0)) / F.when(F.col("total_sources") > 0, F.col("total_sources")).otherwise(1)
    shown = F.round(F.least(F.lit(99.0), F.col("progress_percentage") + share), 2)
    return both.select("id", F.when(F.col("status").isin("SUCCESS", "FAILED", "ABORTED"), 100.0).otherwise(shown).alias("display"))


def metric_text(metadata: Column, status: Column) -> Column:
    """The metrics of a log row's JSON as one text; empty without any, unless the row tells of a failure that isn't counted."""
    values = {k: F.get_json_object(metadata, f"$.{k}") for k, _, _ in METRICS}
    failed = status == "FAILED"
    shown = []
    for key, label, always in METRICS:
        absent = F.when(failed, "1").otherwise("0") if key == "errors" else F.lit("0") if always else F.lit(None).cast("string")
        shown.append(F.concat(F.lit(f"{label}: "), F.coalesce(values[key], absent)))
    counted = F.lit(False)
    for value in values.values():
        counted = counted | value.isNotNull()
    return F.when(counted | (failed & values["errors"].isNull()), F.array_join(F.filter(F.array(*shown), lambda x: x.isNotNull()), ", ")).otherwise("")


def error_reason(metadata: Column, error_text: Column) -> Column:
    """The error of a log row: its own, the first of its failures, the first of its sources, or the last line of its text."""
    def first_of(name: str) -> Column:
        items = F.from_json(F.get_json_object(metadata, f"$.{name}"), "array<struct<error: string>>")
        return F.try_element_at(F.filter(F.transform(items, lambda x: x["error"]), lambda e: e != ""), F.lit(1))

    lines = F.filter(F.transform(F.split(F.coalesce(error_text, F.lit("")), r"\r\n|[\r\n]"), lambda x: F.trim(x)), lambda x: x != "")
    own = F.get_json_object(metadata, "$.error")
    return F.coalesce(F.when(~own.isin("", "false", "0"), own), first_of("failures"), first_of("sources"), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def facet_search(rows: DataFrame, facets: dict[str, str], query: str, fields: list[str]) -> DataFrame:
    """Rows of equal facets in which every word of the query stands in one of the fields, case ignored."""
    out = rows
    for name, value in facets.items():
        out = out.where(F.col(name).cast("string") == value)
    for word in query.lower().split():
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.lower(F.col(f).cast("string")).contains(word), F.lit(False))
        out = out.where(hit)
    return out


def flagged_candidates(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """Candidates (name, n, flagged, reviewed) that wait for review, the most frequent first."""
    return candidates.where("flagged AND NOT reviewed").orderBy(F.desc("n"), F.lower("name"), "name").limit(limit)


def archive_list(archives: DataFrame, limit: int = 20) -> DataFrame:
    """The newest archives (id, created_at, status, archived_count) and whether each can be restored."""
    shown = archives.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return shown.select("id", "status", ((F.col("status") != "RESTORED") & (F.col("archived_count") > 0)).alias("can_restore"))


def log_projection(logs: DataFrame, sources: DataFrame, companies: DataFrame) -> DataFrame:
    """Log rows with the names of their source and company, display fields, metrics and the reason of an error."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    both = logs.join(s, "source_id", "left").join(c, "company_id", "left")
    return both.select(
        "id", "crawl_run_id", "step_name", "status", "source_name", "company_name", F.date_format("created_at", "MMM d, h:mm a").alias("shown_at"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("title_at"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso_at"),
        F.when(F.col("duration_ms").isNull(), "").otherwise(duration_display(F.col("duration_ms"))).alias("duration"), metric_text(F.col("metadata"), F.col("status")).alias("metrics"),
        error_reason(F.col("metadata"), F.col("error_text")).alias("reason"),
    )


def metric_list(metadata: Column, status: Column) -> Column:
    """The metrics of ``metric_text`` as an array of (key, label, value)."""
    failed = status == "FAILED"
    values = {k: F.get_json_object(metadata, f"$.{k}") for k, _, _ in METRICS}
    counted, items = failed & values["errors"].isNull(), []
    for key, label, always in METRICS:
        absent = F.when(failed, "1").otherwise("0") if key == "errors" else F.lit("0") if always else F.lit(None).cast("string")
        items.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.coalesce(values[key], absent).alias("value")))
        counted = counted | values[key].isNotNull()
    return F.filter(F.array(*items), lambda x: F.coalesce(counted, F.lit(False)) & x["value"].isNotNull())


LOG_FILTERS = ["status", "severity", "step_name", "source_id", "crawl_run_id", "job_id", "company_id"]


def filtered_logs(logs: DataFrame, limit: int = 50, **filters) -> DataFrame:
    """The newest log rows that equal all given values of status, severity, step_name, source_id, crawl_run_id, job_id and company_id; an empty value or 0 asks for nothing."""
    unknown = set(filters) - set(LOG_FILTERS)
    if unknown:
        raise ValueError(f"not a filter of logs: {sorted(unknown)}")
    for name, value in filters.items():
        if value:
            logs = logs.where(F.col(name) == value)
    return recent(logs, "created_at", limit)


#: Rows of one source or company are dealt to so many tasks.
DEALS = 64


def with_names(rows: DataFrame, named: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the name of what their key says, null without one; named: (key, name), each key once.

    Many rows may have one key, or none: they are dealt by their id too, and names are looked up once for each key and deal.
    """
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("id"), F.lit(DEALS)))
    asked = dealt.where(F.col(key).isNotNull()).select(key, "_deal").distinct().join(named.select(key, name), key)
    return dealt.join(asked, [key, "_deal"], "left").drop("_deal")


def log_rows(logs: DataFrame, sources: DataFrame, companies: DataFrame) -> DataFrame:
    """All fields of log rows: their own, the names of their source and company (empty without one), moments in UTC as ISO text and for display, durations, metrics and the reason of an error.

    A row without a moment shows a dash; one without a duration has no label either.
    """
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    at, fraction = F.col("created_at"), F.date_format("created_at", "SSSSSS")
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))
    duration = F.when(F.col("duration_ms").isNull(), "").otherwise(duration_display(F.col("duration_ms")))
    metadata, status = F.col("metadata"), F.col("status")
    blank = F.lit("")
    return with_names(with_names(logs, s, "source_id", "source_name"), c, "company_id", "company_name").select(
        "id", iso.alias("created_at"), F.coalesce(iso, blank).alias("created_at_datetime"), F.coalesce(F.date_format(at, "MMM d, h:mm a"), F.lit("-")).alias("created_at_display"),
        F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss 'UTC'"), blank).alias("created_at_title"), "service_name", "step_name", "status", "severity", "crawl_run_id", "source_id",
        F.coalesce("source_name", blank).alias("source_name"), "job_id", "company_id", F.coalesce("company_name", blank).alias("company_name"), "message", "metadata", "error_text",
        error_reason(metadata, F.col("error_text")).alias("error_reason"), "duration_ms", duration.alias("duration_display"), F.col("duration_ms").alias("flow_duration_ms"),
        duration.alias("flow_duration_display"), F.when(duration == "", "").otherwise("Duration").alias("flow_duration_label"), metric_list(metadata, status).alias("metric_summary"),
        metric_text(metadata, status).alias("metric_summary_text"),
    )


def on_cooldown(sources: DataFrame, as_of: str) -> DataFrame:
    """Sources (id, rate_limited_until) and whether they still wait."""
    return sources.select("id", F.coalesce(F.col("rate_limited_until") > F.expr(f"TIMESTAMP_NTZ'{as_of}'"), F.lit(False)).alias("cooling"))


def application_display(applications: DataFrame, jobs: DataFrame, companies: DataFrame, own: DataFrame, asked: DataFrame, names: DataFrame) -> DataFrame:
    """Applications with their job's title, company, type, place and the names of both lists of skills."""
    def listed(links: DataFrame, key: str, name: str) -> DataFrame:
        return links.join(names, "skill_set_id").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias(name))

    j = jobs.select(F.col("id").alias("job_post_id"), "title", "employment_type", "location", "company_id")
    both = applications.select(F.col("id").alias("application_id"), "job_post_id").join(j, "job_post_id").join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("company")), "company_id")
    both = both.join(listed(own, "application_id", "skills"), "application_id", "left").join(listed(asked, "job_post_id", "job_skills"), "job_post_id", "left")
    return both.select("application_id", "title", "company", F.coalesce(F.nullif("employment_type", F.lit("")), F.lit("Unspecified")).alias("job_type"), "location", F.coalesce("skills", F.lit("")).alias("skills"), F.coalesce("job_skills", F.lit("")).alias("job_skills"))


def job_keywords(links: DataFrame, keywords: DataFrame) -> DataFrame:
    """(job_post_id, keywords): the keywords of each job's skills, each text once, in order of skill and text."""
    rows = links.select("job_post_id", "skill_set_id").join(keywords, "skill_set_id")
    first = rows.groupBy("job_post_id", F.lower("raw_text").alias("key")).agg(F.min(F.struct("skill_set_id", "raw_text")).alias("x"))
    return first.groupBy("job_post_id").agg(F.array_sort(F.collect_list("x")).alias("l")).select("job_post_id", F.array_join(F.transform("l", lambda x: x["raw_text"]), ", ").alias("keywords"))
