"""Merge plans and deduplication."""

from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.operators import merges as G
from demandlens.plans.catalog import query

EXISTING = "(SELECT id AS row_id, title, location, status FROM d_job_post WHERE id % 3 <> 0)"
INCOMING = "(SELECT id AS row_id, CASE WHEN id % 5 = 0 THEN '' ELSE title || ' II' END AS title, CASE WHEN id % 7 = 0 THEN '' ELSE location END AS location, 'CLOSED' AS status FROM d_job_post WHERE id % 2 = 0)"
PLAN = f"""(SELECT coalesce(o.row_id, n.row_id) AS row_id, coalesce(nullif(n.title, ''), o.title) AS title, coalesce(nullif(n.location, ''), o.location) AS location,
    CASE WHEN o.row_id IS NULL THEN n.status ELSE o.status END AS status, CASE WHEN o.row_id IS NULL THEN 'insert' WHEN n.row_id IS NULL THEN 'keep'
    WHEN coalesce(nullif(n.title, ''), o.title) IS NOT DISTINCT FROM o.title AND coalesce(nullif(n.location, ''), o.location) IS NOT DISTINCT FROM o.location THEN 'keep' ELSE 'update' END AS action
    FROM {EXISTING} o FULL JOIN {INCOMING} n ON o.row_id = n.row_id)"""


def plan(d):
    old = d.d_job_post.where("id % 3 <> 0").selectExpr("id AS row_id", "title", "location", "status")
    new = d.d_job_post.where("id % 2 = 0").selectExpr(
        "id AS row_id", "CASE WHEN id % 5 = 0 THEN '' ELSE concat(title, ' II') END AS title", "CASE WHEN id % 7 = 0 THEN '' ELSE location END AS location", "'CLOSED' AS status"
    )
    return G.merge_preserve(old, new, "row_id", ["title", "location"])


@query("merge_preserve", f"SELECT * FROM {PLAN}")
def merge_preserve(d):
    return plan(d)


@query("upsert_jobs_plan", f"SELECT row_id, title, action FROM {PLAN} WHERE action <> 'keep'")
def upsert_jobs_plan(d):
    return plan(d).where("action <> 'keep'").select("row_id", "title", "action")


@query("sync_metrics", f"SELECT status, count(*) FILTER (action = 'insert') AS n_insert, count(*) FILTER (action = 'update') AS n_update, count(*) FILTER (action = 'keep') AS n_keep FROM {PLAN} GROUP BY 1")
def sync_metrics(d):
    return G.sync_metrics(plan(d), ["status"])


@query("match_existing_job", """SELECT i.row_id, CASE WHEN e.x IS NULL OR u.x > e.x THEN u.x.id ELSE e.x.id END AS existing_id
    FROM (SELECT c_custkey AS row_id, 'x' || c_custkey % 70 AS e, 'u' || c_custkey % 900 AS u FROM customer) i
    LEFT JOIN (SELECT 'x' || id % 50 AS e, max({'c': created_at, 'id': id}) AS x FROM d_job_post GROUP BY 1) e ON e.e = i.e LEFT JOIN (SELECT 'u' || id % 400 AS u, max({'c': created_at, 'id': id}) AS x FROM d_job_post GROUP BY 1) u ON u.u = i.u""")
def match_existing_job(d):
    stored = d.d_job_post.selectExpr("id", "concat('x', id % 50) AS external_id", "concat('u', id % 400) AS source_url", "created_at")
    incoming = d.customer.selectExpr("c_custkey AS row_id", "concat('x', c_custkey % 70) AS external_id", "concat('u', c_custkey % 900) AS source_url")
    return G.match_existing(incoming, stored)


@query("attach_merge", """SELECT coalesce(o.job_post_id, n.job_post_id) AS job_post_id, coalesce(o.skill_set_id, n.skill_set_id) AS skill_set_id, coalesce(n.score, o.score) AS score,
    CASE WHEN o.score IS NULL THEN 'insert' WHEN n.score IS NULL OR n.score = o.score THEN 'keep' ELSE 'update' END AS action FROM (SELECT job_post_id, skill_set_id + id % 3 * 1000000 AS skill_set_id, score FROM d_link) o
    FULL JOIN (SELECT job_post_id, skill_set_id + id % 2 * 1000000 AS skill_set_id, CAST(greatest(0, least(100, score + 10)) AS INT) AS score FROM d_link) n ON o.job_post_id = n.job_post_id AND o.skill_set_id = n.skill_set_id""")
def attach_merge(d):
    scored = d.d_link.selectExpr("job_post_id", "skill_set_id + id % 2 * 1000000 AS skill_set_id", "score + 10 AS score", "0 AS ord")
    return G.attach_merge(d.d_link.withColumn("skill_set_id", F.expr("skill_set_id + id % 3 * 1000000")), scored.unionByName(scored.withColumns({"score": F.lit(-5), "ord": F.lit(1)})))


@query("archive_old_jobs", "SELECT id, CASE WHEN a THEN 'ARCHIVED' ELSE status END AS status, a AS archived FROM (SELECT *, created_at < '1996-07-01' AND status NOT IN ('ARCHIVED', 'APPLIED') AS a FROM d_job_post)")
def archive_old_jobs(d):
    return G.archive(d.d_job_post, "1996-07-01 00:00:00")


@query("archive_payload", """SELECT j.id, '{"id":' || j.id || ',"title":"' || title || '","status":"' || status || '","skill_sets":[' || coalesce(x.s, '') || ']}' AS payload FROM d_job_post j
    LEFT JOIN (SELECT job_post_id, string_agg('{"id":' || skill_set_id || ',"score":' || score || '}', ',' ORDER BY skill_set_id, score) AS s FROM d_link GROUP BY 1) x ON x.job_post_id = j.id WHERE status = 'ARCHIVED'""")
def archive_payload(d):
    return G.archive_payload(d.d_job_post.where("status = 'ARCHIVED'"), d.d_link)


@query("archive_restore", "SELECT c_custkey AS id, CASE WHEN j.status = 'ARCHIVED' THEN 'restored' ELSE 'skipped' END AS outcome FROM customer LEFT JOIN d_job_post j ON j.id = c_custkey")
def archive_restore(d):
    return G.restore(d.d_job_post, d.customer.selectExpr("c_custkey AS id"))


@query("job_status_sync", "SELECT id, CASE WHEN status = 'ARCHIVED' THEN status WHEN id IN (SELECT job_post_id FROM d_application WHERE status <> 'SAVED') THEN 'APPLIED' WHEN status = 'APPLIED' THEN 'ACTIVE' ELSE status END AS status FROM d_job_post")
def job_status_sync(d):
    return G.job_status_sync(d.d_job_post, d.d_application.where("status <> 'SAVED'"))


@query("copy_missing_links", "SELECT a.id AS application_id, l.skill_set_id, l.score FROM d_application a JOIN d_link l USING (job_post_id) WHERE NOT EXISTS (SELECT 1 FROM d_application_skill s WHERE s.application_id = a.id AND s.skill_set_id = l.skill_set_id)")
def copy_missing_links(d):
    return G.copy_missing_links(d.d_application, d.d_link, d.d_application_skill)


@query("apply_transition", "SELECT id, CASE status WHEN 'SAVED' THEN 'APPLIED' ELSE status END AS status, coalesce(applied_at, CASE WHEN status = 'SAVED' THEN TIMESTAMP '2001-11-05' END) AS applied_at, status = 'SAVED' AS changed FROM d_application")
def apply_transition(d):
    return G.apply_transition(d.d_application, "2001-11-05 00:00:00")


@query("candidate_merge", """SELECT coalesce(a.w, b.w) AS normalized, CAST(coalesce(a.n, 0) + coalesce(b.k, 0) AS BIGINT) AS n, coalesce(a.n, 0) + coalesce(b.k, 0) >= 5 AS flagged FROM
    (SELECT p_name || ' ' || p_size % 3 AS w, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT p_name || ' ' || p_size % 7 AS w, count(*) AS k FROM part WHERE p_name || ' ' || p_size % 7 NOT IN (SELECT p_name || ' 4' FROM part) GROUP BY 1) b ON a.w = b.w""")
def candidate_merge(d):
    known = d.part.groupBy(F.expr("concat(p_name, ' ', p_size % 3)").alias("normalized")).agg(F.count("*").alias("n"))
    names = d.part.select(F.trim(T.normalize_name(F.expr("concat('  ', upper(p_name), ' ', p_size % 7, ', ')"))).alias("normalized"))
    return G.candidate_merge(known, names, d.part.selectExpr("concat(p_name, ' 4') AS normalized"))


@query("dedupe_first", "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def dedupe_first(d):
    return G.dedupe_first(d.part.select("p_name", "p_partkey", "p_brand"), ["p_name"], ["p_partkey"])


@query("greedy_dedupe", """SELECT source, ord, exact, finger FROM (WITH RECURSIVE r AS (
    SELECT p_type AS source, p_partkey::BIGINT AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'external_id ' || lower(p_name) WHEN p_partkey % 4 = 0 THEN 'source_url ' || lower(p_brand) END AS exact,
      CASE WHEN p_partkey % 5 > 0 THEN concat_ws(chr(10), lower(p_name), lower(p_brand), '', (p_size % 2)::VARCHAR) END AS finger, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i FROM part),
    scan(source, i, ord, exact, finger, keep, keys) AS (
      SELECT DISTINCT p_type, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, false, []::VARCHAR[] FROM part
      UNION ALL SELECT r.source, r.i, r.ord, r.exact, r.finger, NOT coalesce(list_contains(keys, r.exact), false) AND NOT coalesce(list_contains(keys, r.finger), false),
        CASE WHEN NOT coalesce(list_contains(keys, r.exact), false) AND NOT coalesce(list_contains(keys, r.finger), false) THEN list_concat(keys, list_filter([r.exact, r.finger], lambda x: x IS NOT NULL)) ELSE keys END
      FROM scan JOIN r ON r.source = scan.source AND r.i = scan.i + 1)
    SELECT * FROM scan WHERE keep)""", views=False)
def greedy_dedupe(d):
    rows = d.part.selectExpr(
        "p_type AS source", "p_partkey AS ord", "CASE WHEN p_partkey % 3 = 0 THEN p_name END AS external_id", "CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS source_url", "p_name AS title",
        "CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS company_name", "'' AS location", "CAST(p_size % 2 AS STRING) AS job_type",
    )
    return G.greedy_dedupe(G.job_keys(rows)).select("source", "ord", "exact", "finger")


@query("keyword_sync", """SELECT coalesce(w.skill_set_id, e.skill_set_id) AS skill_set_id, coalesce(w.t, e.t) AS normalized, CASE WHEN w.t IS NULL THEN 'delete' WHEN e.t IS NULL THEN 'insert' ELSE 'keep' END AS action FROM
    (SELECT id AS skill_set_id, lower(name) AS t FROM d_skill_set UNION SELECT id, lower(category) FROM d_skill_set) w FULL JOIN
    (SELECT id AS skill_set_id, lower(name) AS t FROM d_skill_set WHERE id % 2 = 0 UNION SELECT id, lower(business_category) FROM d_skill_set WHERE id % 3 = 0) e ON w.skill_set_id = e.skill_set_id AND w.t = e.t""")
def keyword_sync(d):
    skills = d.d_skill_set
    wanted = skills.selectExpr("id AS skill_set_id", "name AS raw", "0 AS ord").unionByName(skills.selectExpr("id AS skill_set_id", "category AS raw", "1 AS ord")).withColumn("normalized", T.normalize_name(F.col("raw")))
    there = skills.where("id % 2 = 0").selectExpr("id AS skill_set_id", "lower(name) AS normalized").unionByName(skills.where("id % 3 = 0").selectExpr("id AS skill_set_id", "lower(business_category) AS normalized"))
    return G.keyword_sync(wanted, there)
