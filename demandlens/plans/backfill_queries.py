"""Backfills of stored tables, pages of listings, and full rows of logs."""

from pyspark.sql import functions as F

from demandlens.operators import backfills as B
from demandlens.operators import monitoring as M
from demandlens.plans.catalog import query
from demandlens.plans.report_queries import META, TRACE
from demandlens.plans.resolution_queries import SKILL, C, _of, skills
from demandlens.plans.rule_queries import OF_HOST, URLS


@query("reset_status", "SELECT id, 'ACTIVE' AS status, CASE status WHEN 'ACTIVE' THEN 'keep' ELSE 'update' END AS action FROM d_job_post")
def reset_status(d):
    return B.reset_status(d.d_job_post)


@query("mark_applied", """SELECT id, CASE WHEN change THEN 'APPLIED' ELSE status END AS status, CASE WHEN change THEN 'update' ELSE 'keep' END AS action FROM (SELECT id, status, status NOT IN ('ARCHIVED', 'APPLIED') AND (status = 'CLOSED' AND id % 3 = 0 OR id IN (SELECT job_post_id FROM d_application)) AS change FROM d_job_post)""")
def mark_applied(d):
    """Applications of their own table, and of some closed and archived jobs, twice."""
    more = d.d_job_post.where("status IN ('CLOSED', 'ARCHIVED') AND id % 3 = 0").selectExpr("id AS job_post_id")
    return B.mark_applied(d.d_job_post, d.d_application.select("job_post_id").union(more).union(more))


@query("migrate_links", """SELECT job_post_id, skill_set_id, score, CASE WHEN id % 3 = 0 THEN 'MANUAL' ELSE 'PIPELINE' END AS source_type, extraction_metadata AS metadata, 'keep' AS action FROM d_link WHERE id % 2 = 0
    UNION ALL SELECT a.application_id, a.skill_set_id, 0, 'MANUAL', '{"migrated_from":"older_bridge"}', 'insert' FROM d_application_skill a WHERE NOT EXISTS (SELECT 1 FROM d_link l WHERE l.id % 2 = 0 AND l.job_post_id = a.application_id AND l.skill_set_id = a.skill_set_id)""")
def migrate_links(d):
    links = d.d_link.where("id % 2 = 0").selectExpr("job_post_id", "skill_set_id", "score", "CASE WHEN id % 3 = 0 THEN 'MANUAL' ELSE 'PIPELINE' END AS source_type", "extraction_metadata AS metadata")
    older = d.d_application_skill.selectExpr("application_id AS job_post_id", "skill_set_id")
    return B.migrate_links(links, older.union(older), "job_post_id", "older_bridge")


@query("keyword_backfill", f"""SELECT skill_set_id, normalized, raw_text, CASE pos WHEN 0 THEN 'CANONICAL' ELSE 'ALIAS' END AS source, pos = 0 AS is_primary FROM (SELECT id AS skill_set_id, pos, {C('t')} AS raw_text, lower({C('t')}) AS normalized FROM
    (SELECT id, unnest(range(0, len(l))) AS pos, unnest(l) AS t FROM (SELECT id, list_concat([name], string_split(alias_text, '|')) AS l FROM {SKILL}))) WHERE normalized <> '' AND (skill_set_id % 4 <> 0 OR pos > 0) QUALIFY row_number() OVER (PARTITION BY skill_set_id, normalized ORDER BY pos) = 1""")
def keyword_backfill(d):
    """Every fourth skill's name is a keyword already."""
    have = _of(d, SKILL).where("id % 4 = 0").selectExpr("id AS skill_set_id", "lower(name) AS normalized")
    return B.keyword_backfill(skills(d), have)


PAGES = f"(SELECT id, x, y, CASE WHEN id % 4 = 0 THEN '' ELSE x END AS base_url, CASE WHEN id % 8 = 0 THEN NULL ELSE x END AS url, CASE WHEN id % 5 > 0 THEN concat('Source ', CAST(id AS STRING)) END AS name FROM ({URLS}) u)"


@query("listing_pages", f"SELECT id, x AS url, coalesce({OF_HOST}, CASE WHEN y = 'RSS' THEN y END, 'CAREER_SITE') AS parser_type, coalesce(name, '') AS source_name FROM {PAGES} WHERE id % 8 <> 0 AND x <> ''")
def listing_pages(d):
    d.pages.createOrReplaceTempView("pages")
    return B.listing_pages(d._spark.sql(f"SELECT id, base_url, url, y AS resource, name FROM {PAGES}"))


#: Log rows with what the domain's view lacks.
LOGS = f"""(SELECT id, created_at, concat('service ', CAST(id % 3 AS STRING)) AS service_name, step_name, status, CASE WHEN status = 'FAILED' THEN 'ERROR' ELSE 'INFO' END AS severity, crawl_run_id, CASE WHEN id % 4 > 0 THEN id % 40 END AS source_id,
    CASE WHEN id % 2 = 0 THEN id % 100 END AS job_id, CASE WHEN id % 3 > 0 THEN id % 9 END AS company_id, concat('step of ', CAST(id AS STRING)) AS message, {META} AS metadata, {TRACE} AS error_text, duration_ms FROM d_pipeline_log)"""
SHOWN = """SELECT l.id, iso AS created_at, coalesce(iso, '') AS created_at_datetime, coalesce(strftime(created_at, '%b %-d, %-I:%M %p'), '-') AS created_at_display, coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S UTC'), '') AS created_at_title, service_name, step_name, status, severity, crawl_run_id, source_id,
    coalesce(s.name, '') AS source_name, job_id, company_id, coalesce(c.name, '') AS company_name, message, metadata, error_text, CASE l.id % 7 WHEN 0 THEN 'boom' WHEN 1 THEN 'second' WHEN 2 THEN 'of source' ELSE CASE WHEN l.id % 3 = 0 THEN 'ValueError: no' ELSE '' END END AS error_reason,
    duration_ms, took AS duration_display, duration_ms AS flow_duration_ms, took AS flow_duration_display, CASE WHEN took = '' THEN '' ELSE 'Duration' END AS flow_duration_label,
    CASE WHEN l.id % 7 = 3 THEN 'jobs_created Created 4; jobs_updated Updated 0; jobs_closed Closed 0; errors Errors ' || f || '; jobs_deduped Deduped 2' WHEN l.id % 7 = 4 THEN 'jobs_created Created 0; jobs_updated Updated 0; jobs_closed Closed 0; errors Errors 3; skills_attached Skills attached 9'
      WHEN f = '1' THEN 'jobs_created Created 0; jobs_updated Updated 0; jobs_closed Closed 0; errors Errors 1' ELSE '' END AS metric_summary,
    CASE WHEN l.id % 7 = 3 THEN 'Created: 4, Updated: 0, Closed: 0, Errors: ' || f || ', Deduped: 2' WHEN l.id % 7 = 4 THEN 'Created: 0, Updated: 0, Closed: 0, Errors: 3, Skills attached: 9' WHEN f = '1' THEN 'Created: 0, Updated: 0, Closed: 0, Errors: 1' ELSE '' END AS metric_summary_text
    FROM (SELECT *, CASE WHEN status = 'FAILED' THEN '1' ELSE '0' END AS f, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(created_at, '%f') = '000000' THEN '' ELSE strftime(created_at, '.%f') END || '+00:00' AS iso,
      CASE WHEN duration_ms IS NULL THEN '' ELSE (sec // 60) || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') END AS took FROM (SELECT *, CAST(round_even(duration_ms / 1000.0, 0) AS BIGINT) AS sec FROM {logs})) l
    LEFT JOIN d_job_source s ON s.id = l.source_id LEFT JOIN d_company c ON c.id = l.company_id"""


def _logs(d):
    d.d_pipeline_log.createOrReplaceTempView("d_pipeline_log")
    return d._spark.sql(f"SELECT * FROM {LOGS}")


def _shown(d, logs):
    rows = M.log_rows(logs, d.d_job_source, d.d_company)
    return rows.withColumn("metric_summary", F.array_join(F.transform("metric_summary", lambda x: F.concat_ws(" ", x["key"], x["label"], x["value"])), "; "))


@query("log_rows", SHOWN.format(logs=LOGS))
def log_rows(d):
    return _shown(d, _logs(d))


@query("filtered_logs", SHOWN.format(logs=f"(SELECT * FROM {LOGS} WHERE severity = 'ERROR' AND status = 'FAILED' AND step_name = 'error' AND job_id = 6 AND source_id = 6 ORDER BY created_at DESC, id DESC LIMIT 50)"))
def filtered_logs(d):
    found = M.filtered_logs(_logs(d), 50, status="FAILED", severity="ERROR", step_name="error", source_id=6, job_id=6, company_id=0, crawl_run_id=None)
    return _shown(d, found)
