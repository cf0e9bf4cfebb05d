"""Dashboards and monitoring."""

from pyspark.sql import functions as F

from demandlens.operators import monitoring as M
from demandlens.operators import skills as S
from demandlens.plans.catalog import query
from demandlens.plans.skill_queries import MEAN, star

PCT = "CAST(floor(({0} * 2000 + {1}) / (2 * {1})) AS DOUBLE) / 10"
#: Log rows with steps and statuses of every stage and of none.
STEP_OF = "CASE crawl_run_id % 4 WHEN 0 THEN 'celery_task' WHEN 1 THEN 'job_extraction' WHEN 2 THEN 'ollama_verify' ELSE 'nothing known' END"
STATUS_OF = "CASE WHEN crawl_run_id % 20 = 6 AND status = 'SUCCESS' THEN 'INFO' ELSE status END"
PROGRESS = f"""(SELECT crawl_run_id, max(coalesce(n, 0)) AS progress FROM (SELECT crawl_run_id, {STEP_OF} AS step, {STATUS_OF} AS state FROM d_pipeline_log) x
    LEFT JOIN (VALUES ('celery_task', 'STARTED', 5), ('job_extraction', 'SUCCESS', 55), ('ollama_verify', 'STARTED', 87), ('ollama_verify', 'SUCCESS', 90)) v(s, t, n) ON v.s = step AND v.t = state GROUP BY 1)"""


@query("kpis", """SELECT (SELECT count(*) FROM d_job_post) AS jobs, (SELECT count(*) FROM d_application) AS applications, (SELECT count(*) FROM d_application WHERE CAST(applied_at AS DATE) = '1998-10-03') AS applied_today,
    (SELECT count(DISTINCT company_id) FROM d_job_post) AS companies_with_jobs, (SELECT count(*) FROM d_job_source WHERE enabled) AS enabled_sources""")
def kpis(d):
    return M.kpis(d.d_job_post, d.d_application, d.d_company, d.d_job_source, "1998-10-03")


@query("applied_today", "SELECT id FROM d_application WHERE CAST(applied_at AS DATE) = '1998-10-03'")
def applied_today(d):
    return d.d_application.where(F.to_date("applied_at") == F.lit("1998-10-03").cast("date")).select("id")


@query("application_status_counts", """SELECT status, count(*) AS n, CASE status WHEN 'SAVED' THEN 'Saved' WHEN 'APPLIED' THEN 'Applied' WHEN 'REJECTED' THEN 'Rejected' WHEN 'TECH' THEN 'Technical' WHEN 'OFFER' THEN 'Offer' END AS label
    FROM d_application GROUP BY 1""")
def application_status_counts(d):
    return M.labelled_counts(d.d_application, "status", M.STATUS_LABELS)


@query("source_counts", "SELECT count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled FROM d_job_source")
def source_counts(d):
    return d.d_job_source.agg(F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))


@query("skill_snapshot", f"""SELECT skill_set_id, skill_name, job_count, {PCT.format('job_count', 'm')} AS share FROM (SELECT *, max(job_count) OVER () AS m FROM
    (SELECT skill_set_id, skill_name, count(DISTINCT job_post_id) AS job_count FROM d_star GROUP BY ALL ORDER BY job_count DESC, skill_name, skill_set_id LIMIT 6))""")
def skill_snapshot(d):
    return M.snapshot(S.by_skill(star(d)))


@query("status_mix", f"""SELECT jobs, active, applied, archived, {PCT.format('active', 'jobs')} AS active_share, {PCT.format('applied', 'jobs')} AS applied_share, {PCT.format('archived', 'jobs')} AS archived_share, links, avg_score FROM
    (SELECT count(*) AS jobs, count(*) FILTER (status = 'ACTIVE') AS active, count(*) FILTER (status = 'APPLIED') AS applied, count(*) FILTER (status = 'ARCHIVED') AS archived FROM d_job_post),
    (SELECT count(*) AS links, {MEAN.format('score')} AS avg_score FROM d_link)""")
def status_mix(d):
    return M.status_mix(d.d_job_post, d.d_link)


def _breakdown(name: str, field: str):
    @query(name, f"SELECT label, n, {PCT.format('n', 't')} AS share FROM (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS t FROM (SELECT {field} AS label, count(*) AS n FROM d_job_post WHERE {field} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))")
    def run(d):
        return M.breakdown(d.d_job_post, field)


_breakdown("job_type_breakdown", "employment_type")
_breakdown("location_breakdown", "location")


@query("step_summary", f"SELECT step_name, status, count(*) AS n, max(created_at) AS last_at, coalesce({MEAN.format('duration_ms')}, 0) AS avg_ms FROM d_pipeline_log GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 20".replace("/ (2 * count(duration_ms))", "/ nullif(2 * count(duration_ms), 0)"))
def step_summary(d):
    return M.step_summary(d.d_pipeline_log)


@query("errors_by_step", "SELECT step_name, count(*) AS errors FROM d_pipeline_log WHERE status = 'FAILED' GROUP BY 1")
def errors_by_step(d):
    return M.errors_by(d.d_pipeline_log, "step_name")


@query("errors_by_source", "SELECT crawl_run_id, count(*) AS errors FROM d_pipeline_log WHERE status = 'FAILED' AND crawl_run_id IS NOT NULL GROUP BY 1")
def errors_by_source(d):
    return M.errors_by(d.d_pipeline_log, "crawl_run_id")


@query("top_error_sources", "SELECT crawl_run_id, count(*) AS errors FROM d_pipeline_log WHERE status = 'FAILED' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_error_sources(d):
    return M.errors_by(d.d_pipeline_log, "crawl_run_id", 10)


@query("recent_logs", "SELECT id, created_at, step_name, status FROM d_pipeline_log WHERE status = 'SUCCESS' AND step_name = 'click' ORDER BY created_at DESC, id DESC LIMIT 50")
def recent_logs(d):
    return M.recent(d.d_pipeline_log.where("status = 'SUCCESS' AND step_name = 'click'"), "created_at", 50).select("id", "created_at", "step_name", "status")


@query("flow_durations", """SELECT id, crawl_run_id, step_name, coalesce(duration_ms, CASE WHEN lag(crawl_run_id) OVER w = crawl_run_id THEN date_sub('millisecond', lag(created_at) OVER w, created_at) ELSE 0 END) AS flow_ms
    FROM (SELECT * FROM d_pipeline_log ORDER BY created_at DESC, id DESC LIMIT 50) WINDOW w AS (ORDER BY created_at, id)""")
def flow_durations(d):
    return M.flow_durations(d.d_pipeline_log)


@query("latest_step_log", "SELECT crawl_run_id, step_name, id, created_at, status FROM d_pipeline_log QUALIFY row_number() OVER (PARTITION BY crawl_run_id, step_name ORDER BY created_at DESC, id DESC) = 1")
def latest_step_log(d):
    return M.latest_per(d.d_pipeline_log, ["crawl_run_id", "step_name"]).select("crawl_run_id", "step_name", "id", "created_at", "status")


def staged(d):
    return M.stage_progress(d.d_pipeline_log.selectExpr("crawl_run_id", f"{STEP_OF} AS step_name", f"{STATUS_OF} AS status"))


@query("stage_progress", f"SELECT crawl_run_id, CAST(progress AS BIGINT) AS progress FROM {PROGRESS}")
def stage_progress(d):
    return staged(d)


@query("crawl_progress", "SELECT id, CAST(floor((processed_sources * 20000 + total_sources) / (2 * total_sources)) AS DOUBLE) / 100 AS progress FROM d_crawl_run")
def crawl_progress(d):
    return d.d_crawl_run.select("id", M.progress(F.col("processed_sources"), F.col("total_sources"), F.col("finished_at").isNotNull()).alias("progress"))


@query("duration_display", "SELECT id, CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS display FROM (SELECT id, CAST(round_even(coalesce(duration_ms, 0) / 1000.0, 0) AS BIGINT) AS s FROM d_pipeline_log)")
def duration_display(d):
    return d.d_pipeline_log.select("id", M.duration_display(F.col("duration_ms")).alias("display"))


@query("latest_crawl_run", "SELECT id, started_at, total_sources FROM d_crawl_run ORDER BY started_at DESC, id DESC LIMIT 1")
def latest_crawl_run(d):
    return M.recent(d.d_crawl_run, "started_at", 1).select("id", "started_at", "total_sources")


@query("crawl_history", "SELECT id, finished_at AS at, total_sources, CAST(errors AS BIGINT) AS errors FROM d_crawl_run ORDER BY started_at DESC, id DESC LIMIT 5")
def crawl_history(d):
    rows = M.recent(d.d_crawl_run, "started_at", 5)
    return rows.select("id", F.coalesce("finished_at", "started_at").alias("at"), F.coalesce(F.nullif("total_sources", F.lit(0)), F.lit(0)).alias("total_sources"), "errors")


@query("recent_applications", "SELECT id, status, applied_at FROM d_application ORDER BY applied_at DESC NULLS LAST, id DESC LIMIT 5")
def recent_applications(d):
    return M.recent(d.d_application, "applied_at", 5).select("id", "status", "applied_at")


@query("crawl_totals", "SELECT CAST(sum(total_sources) AS BIGINT) AS total, CAST(sum(processed_sources) AS BIGINT) AS processed, CAST(sum(errors) AS BIGINT) AS errors FROM d_crawl_run")
def crawl_totals(d):
    return d.d_crawl_run.agg(F.sum("total_sources").alias("total"), F.sum("processed_sources").alias("processed"), F.sum("errors").alias("errors"))


@query("kb_counts", "SELECT (SELECT count(*) FROM d_skill_set) AS skills, (SELECT count(*) FROM d_link) AS links, (SELECT count(*) FROM d_category) AS categories, (SELECT count(*) FROM d_skill_embedding) AS embeddings")
def kb_counts(d):
    out = None
    for name, df in (("skills", d.d_skill_set), ("links", d.d_link), ("categories", d.d_category), ("embeddings", d.d_skill_embedding)):
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


@query("join_log_dims", "SELECT l.id, l.step_name, r.started_at, r.total_sources FROM d_pipeline_log l LEFT JOIN (SELECT * FROM d_crawl_run WHERE errors > 0) r ON r.id = l.crawl_run_id")
def join_log_dims(d):
    runs = d.d_crawl_run.where("errors > 0").selectExpr("id AS crawl_run_id", "started_at", "total_sources")
    return d.d_pipeline_log.join(runs, "crawl_run_id", "left").select("id", "step_name", "started_at", "total_sources")


@query("current_step", "SELECT crawl_run_id, arg_max(step_name, (created_at, id)) AS step FROM d_pipeline_log GROUP BY 1")
def current_step(d):
    return d.d_pipeline_log.groupBy("crawl_run_id").agg(F.max(F.struct("created_at", "id", "step_name"))["step_name"].alias("step"))


@query("display_progress", f"""SELECT r.id, CASE WHEN r.id % 5 IN (0, 1, 2) THEN 100.0 ELSE round(least(99, r.id % 100 + coalesce(p.progress, 0) / CASE WHEN r.id % 7 = 0 THEN 1 ELSE r.total_sources END), 2) END::DOUBLE AS display
    FROM d_crawl_run r LEFT JOIN {PROGRESS} p ON p.crawl_run_id = r.id""")
def display_progress(d):
    status = "element_at(array('SUCCESS', 'FAILED', 'ABORTED', 'RUNNING', 'PENDING'), CAST(id % 5 + 1 AS INT)) AS status"
    runs = d.d_crawl_run.selectExpr("id", status, "CASE WHEN id % 7 = 0 THEN 0 ELSE total_sources END AS total_sources", "CAST(id % 100 AS DOUBLE) AS progress_percentage")
    return M.display_progress(runs, staged(d))


META = """CASE id % 7 WHEN 0 THEN '{"error":"boom","failures":[{"error":"x"}]}' WHEN 1 THEN '{"failures":[{"error":""},{"error":"second"}]}' WHEN 2 THEN '{"sources":[{"name":"a"},{"error":"of source"}]}'
    WHEN 3 THEN '{"jobs_created":4,"jobs_deduped":2}' WHEN 4 THEN '{"errors":3,"skills_attached":9}' WHEN 5 THEN '{"other":1}' ELSE NULL END"""
TRACE = "CASE WHEN id % 3 = 0 THEN concat('Traceback', chr(10), '  line 3', chr(10), ' ValueError: no ', chr(10), ' ') ELSE '' END"


@query("error_reason", f"""SELECT id, CASE id % 7 WHEN 0 THEN 'boom' WHEN 1 THEN 'second' WHEN 2 THEN 'of source' ELSE CASE WHEN id % 3 = 0 THEN 'ValueError: no' ELSE '' END END AS reason FROM d_pipeline_log""")
def error_reason(d):
    rows = d.d_pipeline_log.selectExpr("id", f"{META} AS m", f"{TRACE} AS t")
    return rows.select("id", M.error_reason(F.col("m"), F.col("t")).alias("reason"))


@query("metric_summary", """SELECT id, CASE WHEN id % 7 = 3 THEN 'Created: 4, Updated: 0, Closed: 0, Errors: ' || f || ', Deduped: 2' WHEN id % 7 = 4 THEN 'Created: 0, Updated: 0, Closed: 0, Errors: 3, Skills attached: 9'
    WHEN f = '1' THEN 'Created: 0, Updated: 0, Closed: 0, Errors: 1' ELSE '' END AS summary FROM (SELECT id, CASE WHEN status = 'FAILED' THEN '1' ELSE '0' END AS f FROM d_pipeline_log)""")
def metric_summary(d):
    rows = d.d_pipeline_log.selectExpr("id", "status", f"{META} AS m")
    return rows.select("id", M.metric_text(F.col("m"), F.col("status")).alias("summary"))
