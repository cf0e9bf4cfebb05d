"""Category bridges, the market profile, dates in searches, values of any shape, and categories whose parents come later."""

from pyspark.sql import functions as F

from demandlens.functions import json_safe as J
from demandlens.operators import dates as S
from demandlens.operators import profile as P
from demandlens.operators import taxonomy as X
from demandlens.plans.catalog import query
from demandlens.plans.demand_queries import DEMAND
from demandlens.sources.binding import AS_OF

CATEGORY = """(SELECT 'business' AS kind, CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS name, n_nationkey % 6 <> 5 AS is_active FROM nation UNION ALL SELECT 'esco' AS kind, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_nationkey % 9 <> 1 AS is_active FROM nation
    UNION ALL SELECT 'market' AS kind, CAST(r_regionkey AS BIGINT) AS id, r_name AS name, r_regionkey <> 3 AS is_active FROM region)"""
#: Each skill lies in up to three categories of a kind.
BRIDGE = """(SELECT 'business' AS kind, id AS skill_set_id, CAST((id * 7 + k * 5) % 25 AS BIGINT) AS category_id, (id + k) % 4 <> 0 AS is_approved FROM d_skill_set CROSS JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 3) x
    UNION ALL SELECT 'esco' AS kind, id AS skill_set_id, CAST((id + k * 11) % 25 AS BIGINT) AS category_id, false AS is_approved FROM d_skill_set CROSS JOIN (SELECT r_regionkey AS k FROM region WHERE r_regionkey < 2) x WHERE id % 5 <> 0
    UNION ALL SELECT 'market' AS kind, id AS skill_set_id, CAST(id % 5 AS BIGINT) AS category_id, is_approved FROM d_skill_set)"""
USED = f"(SELECT b.kind, c.name AS category, skill_set_id FROM {BRIDGE} b JOIN {CATEGORY} c ON c.kind = b.kind AND c.id = b.category_id WHERE c.is_active AND (b.kind = 'esco' OR b.is_approved))"
COUNTS = f"(SELECT kind, category, count(DISTINCT job_post_id) AS job_count FROM {USED} JOIN d_link USING (skill_set_id) GROUP BY 1, 2)"


def _of(d, sql):
    for name in ("nation", "region", "d_skill_set"):
        getattr(d, name).createOrReplaceTempView(name)
    return d._spark.sql(f"SELECT * FROM {sql}")


@query("bridge_category_counts", f"SELECT * FROM {COUNTS}")
def bridge_category_counts(d):
    return P.category_jobs(d.d_link, _of(d, BRIDGE), _of(d, CATEGORY))


def _list(name: str, value: str, where: str, order: str) -> str:
    return f"SELECT * FROM (SELECT '{name}' AS list, row_number() OVER (ORDER BY {order}, s.name, s.id) AS rank, s.name, {value}::DOUBLE AS value, NULL::DOUBLE AS share FROM {DEMAND} x JOIN d_skill_set s ON s.id = x.skill_set_id WHERE {where}) WHERE rank <= 10"


def _category(name: str, kind: str, top: bool) -> str:
    share = "CAST(floor((job_count * 2000 + t) / (2 * t)) AS DOUBLE) / 10" if top else "NULL::DOUBLE"
    return f"SELECT * FROM (SELECT '{name}' AS list, row_number() OVER (ORDER BY job_count DESC, lower(category), category) AS rank, category AS name, job_count::DOUBLE AS value, {share} AS share FROM (SELECT *, CAST(sum(job_count) OVER () AS BIGINT) AS t FROM {COUNTS} WHERE kind = '{kind}')) WHERE rank <= {10 if top else 1000000}"


@query("market_profile", " UNION ALL ".join([
    _list("top_skills", "demand_score", "true", "demand_score DESC"), _list("fastest_growing", "growth_ratio", "true", "growth_ratio DESC"), _list("emerging", "growth_ratio", "trend_type = 'rising'", "growth_ratio DESC, demand_score DESC"),
    _category("top_business", "business", True), _category("top_market", "market", True), *[_category(f"{k}_categories", k, False) for k in ("business", "market", "esco")],
]))
def market_profile(d):
    return P.market_profile(d.d_link, d.d_skill_set, _of(d, BRIDGE), _of(d, CATEGORY), AS_OF)


#: Searches for dates with what each must mean.
DATED = {
    "1996": "year(created_at) = 1996", "march": "month(created_at) = 3", "Sept 1997": "month(created_at) = 9 AND year(created_at) = 1997", "1995-06-17": "created_at::DATE = DATE '1995-06-17'",
    "jun, 1995-06-17": "created_at::DATE = DATE '1995-06-17'", "1996 1997": "false", "00:00:00": "true", "1995-06-1 june": "created_at::VARCHAR LIKE '%1995-06-1%'",
}


@query("search_dates", " UNION ALL ".join(f"SELECT '{q}' AS query, count(*) AS n, min(id) AS low, max(id) AS high FROM d_job_post WHERE {w} HAVING count(*) > 0" for q, w in DATED.items()))
def search_dates(d):
    found = S.search_any(d.d_job_post.select("id", "created_at"), list(DATED), [], "created_at")
    return found.groupBy("query").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))


@query("search_dates_or_texts", "SELECT id FROM d_job_post WHERE (contains(lower(title), 'machinery') OR contains(lower(location), 'machinery')) AND (year(created_at) = 1995 OR contains(title, '1995') OR contains(location, '1995')) AND (month(created_at) = 5 OR contains(lower(title), 'may') OR contains(lower(location), 'may'))")
def search_dates_or_texts(d):
    return S.search(d.d_job_post, "Machinery (1995) may", ["title", "location"], "created_at").select("id")


SHAPES = """(SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('{"a": [', props, ', [], {"b": null}], "user": ', CAST(user_id AS STRING), ', "t": "', event_type, '"}')
    WHEN 2 THEN concat('[', props, ', true, ', props, ']') ELSE concat(event_type, ' {') END AS props FROM events)"""


@query("props_leaves", f"""WITH RECURSIVE s AS (SELECT event_id, props FROM {SHAPES} WHERE json_valid(props)), t(event_id, path, v) AS (SELECT event_id, '$', props::JSON FROM s
    UNION ALL SELECT t.event_id, t.path || CASE json_type(t.v) WHEN 'ARRAY' THEN '[' || e.key || ']' ELSE '.' || e.key END, e.value FROM t, json_each(t.v) e WHERE json_type(t.v) IN ('ARRAY', 'OBJECT'))
    SELECT event_id, path, CASE json_type(v) WHEN 'ARRAY' THEN '[]' WHEN 'NULL' THEN NULL ELSE v ->> '$' END AS value FROM t WHERE json_type(v) NOT IN ('ARRAY', 'OBJECT') OR v::VARCHAR IN ('[]', '{{}}')""", views=False)
def props_leaves(d):
    d.events.createOrReplaceTempView("events")
    found = J.leaves(d._spark.sql(f"SELECT * FROM {SHAPES}"), "event_id", "props")
    return found.select("event_id", "path", "value")


@query("metadata_json_safe", """SELECT event_id, '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END || '","day":"' || strftime(ts, '%Y-%m-%d') || '","cost":' || CASE WHEN user_id % 3 = 0 THEN 'null' ELSE user_id || '.5' END
    || ',"runs":[' || CASE WHEN user_id % 2 = 0 THEN '{"n":' || user_id || ',"of":["' || strftime(ts, '%Y-%m-%d') || '",null]}' ELSE '' END || '],"by":{"' || event_type || '":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '1.5' END || '}}' AS payload FROM events""", views=False)
def metadata_json_safe(d):
    rows = d.events.selectExpr("event_id", """named_struct('at', ts, 'day', CAST(ts AS DATE), 'cost', CASE WHEN user_id % 3 <> 0 THEN CAST(user_id + 0.5 AS DECIMAL(12, 1)) END,
        'runs', CASE WHEN user_id % 2 = 0 THEN array(named_struct('n', user_id, 'of', array(CAST(ts AS DATE), CAST(NULL AS DATE)))) ELSE array() END, 'by', map(event_type, CASE event_id % 5 WHEN 0 THEN double('NaN') ELSE 1.5D END)) AS metadata""")
    return rows.select("event_id", J.json_text(rows, "metadata").alias("payload"))


#: Terms in chains of 40 by numbers, some of whose parents are missing, and rings of ten.
TERMS = """(SELECT concat('t', CAST(p_partkey AS STRING)) AS uri, CASE WHEN p_partkey % 40 = 0 THEN '' WHEN p_partkey % 97 = 5 THEN 'nowhere' WHEN p_partkey % 1000 BETWEEN 500 AND 509 THEN concat('t', CAST(p_partkey - p_partkey % 10 + (p_partkey + 1) % 10 AS STRING))
    ELSE concat('t', CAST(p_partkey - 1 AS STRING)) END AS broader FROM part WHERE p_partkey % 3 <> 1)"""
STORED = "(SELECT concat('t', CAST(p_partkey AS STRING)) AS uri, CASE WHEN p_partkey % 2 = 0 AND p_partkey > 0 THEN concat('t', CAST(p_partkey - 1 AS STRING)) END AS parent FROM part WHERE p_partkey % 3 = 1 OR p_partkey % 10 = 0)"


@query("hierarchy_links", f"""WITH RECURSIVE every AS (SELECT uri FROM {TERMS} UNION SELECT uri FROM {STORED}), p AS (SELECT e.uri, max(CASE WHEN t.broader <> t.uri THEN b.uri END) AS new_parent, max(s.parent) AS old_parent, max(CASE WHEN t.broader <> '' AND t.broader <> t.uri THEN 1 ELSE 0 END) AS asked
      FROM every e LEFT JOIN {TERMS} t ON t.uri = e.uri LEFT JOIN every b ON b.uri = t.broader LEFT JOIN {STORED} s ON s.uri = e.uri GROUP BY 1),
    q AS (SELECT *, coalesce(new_parent, old_parent) AS parent FROM p), down(uri, root, depth) AS (SELECT uri, uri, 0::BIGINT FROM q WHERE parent IS NULL OR parent NOT IN (SELECT uri FROM every) UNION ALL SELECT q.uri, root, depth + 1 FROM down JOIN q ON q.parent = down.uri)
    SELECT q.uri, q.parent, root, depth, CASE WHEN root IS NULL THEN 'cycle' WHEN new_parent IS NOT NULL AND new_parent IS DISTINCT FROM old_parent THEN 'linked' WHEN asked = 1 AND new_parent IS NULL THEN 'missing' WHEN q.parent IS NULL THEN 'root' ELSE 'kept' END AS outcome FROM q LEFT JOIN down USING (uri)""", views=False)
def hierarchy_links(d):
    d.part.createOrReplaceTempView("part")
    return X.hierarchy(d._spark.sql(f"SELECT * FROM {TERMS}"), d._spark.sql(f"SELECT * FROM {STORED}"))
