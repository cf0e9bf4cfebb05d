"""Next states of tables, lists for review, projections for display, and a stream worked off."""

from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.operators import merges as G
from demandlens.operators import monitoring as M
from demandlens.plans.catalog import query
from demandlens.plans.report_queries import META, TRACE
from demandlens.plans.skill_queries import KEYWORDS, _keywords
from demandlens.streaming import steps


@query("ensure_keywords", """SELECT coalesce(a.s, b.s) AS skill_set_id, coalesce(a.t, b.t) AS normalized, CASE WHEN b.s IS NOT NULL THEN 'ACTIVE' ELSE a.st END AS status, CASE WHEN a.s IS NULL THEN 'insert' WHEN b.s IS NULL OR a.st = 'ACTIVE' THEN 'keep' ELSE 'update' END AS action FROM
    (SELECT id AS s, lower(name) AS t, CASE WHEN id % 4 = 0 THEN 'IGNORED' ELSE 'ACTIVE' END AS st FROM d_skill_set) a FULL JOIN (SELECT id AS s, CASE WHEN id % 3 = 0 THEN lower(name) ELSE 'new' END AS t FROM d_skill_set WHERE is_active) b ON a.s = b.s AND a.t = b.t""")
def ensure_keywords(d):
    have = d.d_skill_set.selectExpr("id AS skill_set_id", "lower(name) AS normalized", "CASE WHEN id % 4 = 0 THEN 'IGNORED' ELSE 'ACTIVE' END AS status")
    want = d.d_skill_set.where("is_active").selectExpr("id AS skill_set_id", "CASE WHEN id % 3 = 0 THEN lower(name) ELSE 'new' END AS normalized", "'ACTIVE' AS status")
    return G.ensure_keywords(have, want)


@query("manual_link_sync", """SELECT coalesce(l.job_post_id, w.job_post_id) AS job_post_id, coalesce(l.skill_set_id, w.skill_set_id) AS skill_set_id, coalesce(l.source, 'MANUAL') AS source, coalesce(l.score, 0) AS score,
    CASE WHEN l.source IS NULL THEN 'insert' WHEN l.source = 'MANUAL' AND l.job_post_id % 3 = 0 AND w.job_post_id IS NULL THEN 'delete' ELSE 'keep' END AS action FROM (SELECT job_post_id, skill_set_id, score, CASE WHEN id % 2 = 0 THEN 'MANUAL' ELSE 'PIPELINE' END AS source FROM d_link) l
    FULL JOIN (SELECT DISTINCT job_post_id, skill_set_id + skill_set_id % 2 AS skill_set_id FROM d_link WHERE job_post_id % 3 = 0 AND job_post_id % 5 <> 0) w ON w.job_post_id = l.job_post_id AND w.skill_set_id = l.skill_set_id""")
def manual_link_sync(d):
    links = d.d_link.selectExpr("job_post_id", "skill_set_id", "score", "CASE WHEN id % 2 = 0 THEN 'MANUAL' ELSE 'PIPELINE' END AS source")
    desired = d.d_link.where("job_post_id % 3 = 0").selectExpr("job_post_id", "CASE WHEN job_post_id % 5 <> 0 THEN skill_set_id + skill_set_id % 2 END AS skill_set_id")
    return G.manual_link_sync(links, desired)


@query("status_history", "SELECT id, status AS from_status, 'APPLIED' AS to_status, TIMESTAMP '2001-11-05' AS changed_at FROM d_application WHERE status = 'SAVED'")
def status_history(d):
    return G.status_history(d.d_application, G.apply_transition(d.d_application, "2001-11-05 00:00:00"), "2001-11-05 00:00:00")


@query("approve_mapping", "SELECT id, CASE WHEN id % 50 = 0 THEN 'MANUAL' ELSE 'SEED' END AS source, is_approved OR id % 50 = 0 AS is_approved FROM d_skill_set")
def approve_mapping(d):
    chosen = d.d_skill_set.where("id % 50 = 0").select("id")
    return G.approve(d.d_skill_set.selectExpr("id", "'SEED' AS source", "is_approved"), chosen.union(chosen))


@query("embedding_backfill_plan", "SELECT id, (SELECT greatest(count(*) - 100, 0) FROM d_skill_set WHERE id NOT IN (SELECT id FROM d_skill_embedding)) AS remaining FROM d_skill_set WHERE id NOT IN (SELECT id FROM d_skill_embedding) ORDER BY id LIMIT 100")
def embedding_backfill_plan(d):
    return G.embedding_backfill(d.d_skill_set.select("id").join(d.d_skill_embedding, "id", "left"), 100)


@query("coalesce_backfill", "SELECT id, CASE WHEN id % 4 = 0 THEN 'Given' ELSE employment_type END AS job_type FROM d_job_post")
def coalesce_backfill(d):
    return G.backfill_job_type(d.d_job_post.selectExpr("id", "CASE id % 4 WHEN 0 THEN 'Given' WHEN 1 THEN '' END AS job_type", "employment_type"))


@query("detail_gate", """SELECT c_custkey AS row_id, f AND row_number() OVER (PARTITION BY f ORDER BY c_custkey) <= 40 AS \"fetch\" FROM (SELECT c_custkey, (j.id IS NULL OR j.id % 3 = 0) AS f FROM customer
    LEFT JOIN (SELECT o_orderkey AS id FROM orders) j ON j.id = c_custkey)""", views=False)
def detail_gate(d):
    stored = d.orders.selectExpr("o_orderkey AS id", "concat('x', o_orderkey) AS external_id", "'' AS source_url", "CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'text' END AS description", "o_orderdate AS created_at")
    return G.detail_gate(d.customer.selectExpr("c_custkey AS row_id", "concat('x', c_custkey) AS external_id", "'' AS source_url"), stored, budget=40)


@query("search_keywords", f"SELECT skill_set_id, raw_text FROM {KEYWORDS} WHERE contains(lower(raw_text), 'kw1') AND skill_set_id % 8 = 0")
def search_keywords(d):
    return M.facet_search(_keywords(d).withColumn("even", F.col("skill_set_id") % 8), {"even": "0"}, " KW1 ", ["raw_text"]).select("skill_set_id", "raw_text")


@query("admin_search", "SELECT id, title FROM d_job_post WHERE status = 'CLOSED' AND remote_type = 'Remote' AND (contains(lower(title), 'engineer') OR contains(lower(location), 'engineer')) AND (contains(lower(title), '_1') OR contains(lower(location), '_1'))")
def admin_search(d):
    return M.facet_search(d.d_job_post, {"status": "CLOSED", "remote_type": "Remote"}, "Engineer _1", ["title", "location"]).select("id", "title")


@query("flagged_candidates", "SELECT name, n FROM (SELECT lower(p_name) AS name, count(*) AS n, count(*) >= 2 AS flagged, max(p_size) > 45 AS reviewed FROM part GROUP BY 1) WHERE flagged AND NOT reviewed ORDER BY n DESC, name LIMIT 50", views=False)
def flagged_candidates(d):
    found = d.part.groupBy(F.lower("p_name").alias("name")).agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("flagged"), (F.max("p_size") > 45).alias("reviewed"))
    return M.flagged_candidates(found).select("name", "n")


@query("archive_list", "SELECT id, CASE WHEN id % 3 = 0 THEN 'RESTORED' ELSE 'DONE' END AS status, id % 3 <> 0 AND processed_sources > 0 AS can_restore FROM d_crawl_run ORDER BY started_at DESC, id DESC LIMIT 20")
def archive_list(d):
    return M.archive_list(d.d_crawl_run.selectExpr("id", "started_at AS created_at", "CASE WHEN id % 3 = 0 THEN 'RESTORED' ELSE 'DONE' END AS status", "processed_sources AS archived_count"))


@query("application_display", """SELECT a.id AS application_id, j.title, c.name AS company, CASE WHEN j.employment_type = '' THEN 'Unspecified' ELSE j.employment_type END AS job_type, j.location, coalesce(x.s, '') AS skills, coalesce(y.s, '') AS job_skills FROM d_application a JOIN d_job_post j ON j.id = a.job_post_id
    JOIN d_company c ON c.id = j.company_id LEFT JOIN (SELECT application_id, string_agg(name, ', ' ORDER BY name) AS s FROM d_application_skill m JOIN d_skill_set s ON s.id = m.skill_set_id GROUP BY 1) x ON x.application_id = a.id
    LEFT JOIN (SELECT job_post_id, string_agg(name, ', ' ORDER BY name) AS s FROM d_link l JOIN d_skill_set s ON s.id = l.skill_set_id GROUP BY 1) y ON y.job_post_id = j.id""")
def application_display(d):
    names = d.d_skill_set.selectExpr("id AS skill_set_id", "name")
    return M.application_display(d.d_application, d.d_job_post, d.d_company, d.d_application_skill.select("application_id", "skill_set_id"), d.d_link.select("job_post_id", "skill_set_id"), names)


@query("job_skill_keywords", f"""SELECT job_post_id, string_agg(raw_text, ', ' ORDER BY s, raw_text) AS keywords FROM (SELECT job_post_id, lower(raw_text) AS k, min(l.skill_set_id) AS s, arg_min(raw_text, l.skill_set_id) AS raw_text FROM d_link l JOIN {KEYWORDS} k ON k.skill_set_id = l.skill_set_id GROUP BY 1, 2) GROUP BY 1""")
def job_skill_keywords(d):
    return M.job_keywords(d.d_link, _keywords(d))


@query("log_projection", f"""SELECT l.id, l.crawl_run_id, l.step_name, l.status, s.name AS source_name, c.name AS company_name, strftime(l.created_at, '%b %-d, %-I:%M %p') AS shown_at, strftime(l.created_at, '%Y-%m-%d %H:%M:%S') AS title_at, strftime(l.created_at, '%Y-%m-%dT%H:%M:%S') AS iso_at,
    CASE WHEN duration_ms IS NULL THEN '' ELSE (sec // 60) || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') END AS duration, CASE WHEN l.id % 7 = 3 THEN 'Created: 4, Updated: 0, Closed: 0, Errors: ' || f || ', Deduped: 2' WHEN l.id % 7 = 4 THEN 'Created: 0, Updated: 0, Closed: 0, Errors: 3, Skills attached: 9'
    WHEN f = '1' THEN 'Created: 0, Updated: 0, Closed: 0, Errors: 1' ELSE '' END AS metrics, CASE l.id % 7 WHEN 0 THEN 'boom' WHEN 1 THEN 'second' WHEN 2 THEN 'of source' ELSE CASE WHEN l.id % 3 = 0 THEN 'ValueError: no' ELSE '' END END AS reason
    FROM (SELECT *, CASE WHEN status = 'FAILED' THEN '1' ELSE '0' END AS f, CAST(round_even(duration_ms / 1000.0, 0) AS BIGINT) AS sec FROM d_pipeline_log) l LEFT JOIN d_job_source s ON s.id = l.id % 40 LEFT JOIN d_company c ON c.id = l.id % 9""")
def log_projection(d):
    logs = d.d_pipeline_log.selectExpr("id", "crawl_run_id", "step_name", "status", "created_at", "duration_ms", f"{META} AS metadata", f"{TRACE} AS error_text", "id % 40 AS source_id", "id % 9 AS company_id")
    return M.log_projection(logs, d.d_job_source, d.d_company)


@query("keyword_analysis", f"SELECT j.id, w AS keyword, min(k.skill_set_id) AS skill_set_id FROM (SELECT id, unnest(['kw' || id % 60 || ' 1 steel', 'none']) AS w FROM d_job_post WHERE id % 7 > 0) j LEFT JOIN {KEYWORDS} k ON lower(k.raw_text) = w GROUP BY 1, 2")
def keyword_analysis(d):
    """Entered keywords, cut at commas and lines, with the skill of a known one."""
    typed = d.d_job_post.selectExpr("id", "CASE WHEN id % 7 > 0 THEN concat(' KW', id % 60, '  1 Steel,,none', chr(10), 'NONE') ELSE ' , ' END AS typed")
    parts = F.filter(F.transform(F.split("typed", r"[,\n]"), T.clean_keyword), lambda x: x != "")
    rows = typed.select("id", F.explode(F.array_distinct(F.transform(parts, T.normalize_name))).alias("keyword"))
    known = _keywords(d).groupBy(T.normalize_name(F.col("raw_text")).alias("keyword")).agg(F.min("skill_set_id").alias("skill_set_id"))
    return rows.join(known, "keyword", "left").select("id", "keyword", "skill_set_id")


@query("stream_step_windows", "SELECT date_trunc('day', ts) AS window_start, event_type AS step_name, count(*) AS n, CAST(sum(floor(value * 1000)) AS BIGINT) AS total_ms FROM events GROUP BY 1, 2", views=False)
def stream_step_windows(d):
    stream = steps.source(d._spark, f"{d._dir}/events.parquet*", d.events.schema)
    return steps.run_available(steps.windowed(stream), "complete")


@query("stream_first_seen", "SELECT event_id, event_type FROM events", views=False)
def stream_first_seen(d):
    stream = steps.source(d._spark, f"{d._dir}/events.parquet*", d.events.schema)
    twice = stream.select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("again"))
    return steps.run_available(steps.first_seen(twice).select("event_id", "event_type"), "append")
