"""Tables that batches are written to, some twice, and read back."""

import uuid

from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.operators import demand as D
from demandlens.plans.catalog import query
from demandlens.plans.demand_queries import DEMAND
from demandlens.session import shared_root
from demandlens.sinks import sync as S
from demandlens.sinks.versioned import VersionedTable
from demandlens.sources.binding import AS_OF
from demandlens.streaming import incremental as I
from demandlens.streaming import steps

#: What a source lists of the stored jobs, first and then later: new and changed jobs, blanks, and jobs known by one of id and URL alone.
FIRST = """(SELECT id AS ord, concat('x', CAST(id AS STRING)) AS external_id, concat('https://jobs.example/', CAST(id AS STRING)) AS source_url, CAST(company_id AS STRING) AS company, title, location,
    employment_type AS job_type, '' AS description, false AS closed FROM d_job_post WHERE id % 3 <> 0)"""
LATER = """(SELECT id AS ord, CASE WHEN id % 4 = 0 THEN '' WHEN id % 8 = 2 THEN concat('new-', CAST(id AS STRING)) ELSE concat('x', CAST(id AS STRING)) END AS external_id, CASE WHEN id % 6 = 0 THEN '' ELSE concat('https://jobs.example/', CAST(id AS STRING)) END AS source_url,
    CAST(company_id AS STRING) AS company, CASE WHEN id % 10 = 0 THEN ' ' WHEN id % 16 = 2 THEN title ELSE concat(title, ' II') END AS title, CASE WHEN id % 14 = 0 THEN '' ELSE location END AS location,
    CASE WHEN id % 16 = 2 THEN '' ELSE 'Contract' END AS job_type, '' AS description, id % 18 = 4 AS closed FROM d_job_post WHERE id % 2 = 0 AND company_id % 5 <> 0)"""


def _table(d, key, name):
    return VersionedTable(d._spark, f"{shared_root(d._spark)}/{name}-{uuid.uuid4().hex}", key, 16)


def _of(d, sql):
    d.d_job_post.createOrReplaceTempView("d_job_post")
    return d._spark.sql(f"SELECT * FROM {sql}")


def synced(d, signals=False):
    """Two batches, the second sent twice."""
    table = _table(d, ["job_key"], "jobs")
    S.sync_jobs(table, "crawl", 0, _of(d, FIRST), "2001-11-04 00:00:00")
    for _ in range(2):
        S.sync_jobs(table, "crawl", 1, _of(d, LATER), AS_OF, signals)
    return table


N = f"(SELECT * FROM {LATER} WHERE trim(title) <> '' AND (external_id <> '' OR source_url <> ''))"
SYNCED = f"""(SELECT coalesce('external_id ' || f.external_id || ' 2001-11-04 00:00:00', CASE WHEN n.external_id <> '' THEN 'external_id ' || n.external_id ELSE 'source_url ' || n.source_url END || ' {AS_OF}') AS job_key,
    coalesce(nullif(n.external_id, ''), f.external_id, '') AS external_id, coalesce(nullif(n.source_url, ''), f.source_url, '') AS source_url, coalesce(n.company, f.company) AS company, coalesce(n.title, f.title) AS title,
    coalesce(nullif(n.location, ''), f.location, '') AS location, coalesce(nullif(n.job_type, ''), f.job_type, '') AS job_type, n.closed AS closed, n.ord IS NOT NULL AS seen, f.ord IS NULL AS fresh,
    f.ord IS NOT NULL AND n.ord IS NOT NULL AND (coalesce(nullif(n.external_id, ''), f.external_id) <> f.external_id OR n.title <> f.title OR coalesce(nullif(n.location, ''), f.location) <> f.location OR coalesce(nullif(n.job_type, ''), f.job_type) <> f.job_type) AS changed,
    f.ord IS NOT NULL AND n.ord IS NULL AND f.company IN (SELECT company FROM {N}) AS missing FROM {FIRST} f FULL JOIN {N} n ON n.ord = f.ord)"""


@query("sync_jobs_written", f"SELECT job_key, external_id, source_url, company, title, location, job_type, 'ACTIVE' AS status, CASE WHEN seen THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2001-11-04' END AS last_synced_at FROM {SYNCED}")
def sync_jobs_written(d):
    return synced(d).read().drop("description", "created_at")


@query("sync_counters", f"""SELECT unnest(['jobs_insert', 'jobs_update', 'jobs_keep', 'jobs_closed', 'jobs_missing']) AS counter, unnest([(SELECT count(*) FROM {FIRST}) + count(*) FILTER (fresh), count(*) FILTER (changed AND NOT closed), count(*) FILTER (seen AND NOT fresh AND NOT changed AND NOT closed),
    count(*) FILTER (seen AND NOT fresh AND closed), count(*) FILTER (missing)]) AS n FROM {SYNCED}""")
def sync_counters(d):
    rows = sorted(synced(d, signals=True).state().counters.items())
    return d._spark.createDataFrame(rows, "counter string, n long")


@query("demand_written", f"SELECT skill_set_id, unique_jobs, rolling_30, trend_type, demand_score FROM {DEMAND} WHERE skill_set_id % 7 <> 0")
def demand_written(d):
    """Demand of all skills, then of those whose links are left: changed rows are put, vanished skills deleted."""
    table = _table(d, ["skill_set_id"], "demand")
    columns = ["skill_set_id", "unique_jobs", "rolling_30", "trend_type", "demand_score"]
    S.write_demand(table, "refresh", 0, D.demand(d.d_link.where("skill_set_id % 3 > 0 OR skill_set_id % 7 = 0"), AS_OF).select(columns))
    for _ in range(2):
        S.write_demand(table, "refresh", 1, D.demand(d.d_link.where("skill_set_id % 7 <> 0"), AS_OF).select(columns))
    return table.read()


@query("candidates_stream", "SELECT lower(p_name || ' ' || p_size % 7) AS normalized, count(*) AS n, count(*) >= 5 AS flagged FROM part WHERE p_size % 7 <> 4 GROUP BY 1", views=False)
def candidates_stream(d):
    """Unknown names counted by a stream of four batches, each of which adds to what the table holds."""
    names = d.part.select(T.normalize_name(F.expr("concat('  ', upper(p_name), ' ', p_size % 7, ', ')")).alias("normalized"))
    base = f"{shared_root(d._spark)}/names-{uuid.uuid4().hex}"
    names.repartition(4).write.parquet(f"{base}/rows")
    table = _table(d, ["normalized"], "candidates")
    stream = d._spark.readStream.schema(names.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/rows")
    I.apply_stream(stream, I.record_candidates(table, "names", d.part.selectExpr("concat(p_name, ' 4') AS normalized")), f"{base}/state")
    return table.read()


@query("window_sync", """SELECT 'external_id x' || id || ' 2001-11-05 00:00:00' AS job_key, title || ' ' || CASE WHEN id % 7 IN (0, 1, 6) THEN 2 WHEN id % 7 < 3 THEN 0 ELSE 1 END AS title FROM d_job_post""")
def window_sync(d):
    """Seven sources, three to a run: the third run begins again with the first source, and each run is sent twice."""
    table = _table(d, ["job_key"], "window")
    for run in range(3):
        for _ in range(2):
            listings = lambda taken, run=run: d.d_job_post.where(F.concat(F.lit("s"), F.expr("id % 7")).isin(taken)).selectExpr(
                "id AS ord", "concat('x', id) AS external_id", "'' AS source_url", "CAST(company_id AS STRING) AS company", f"concat(title, ' {run}') AS title", "location", "employment_type AS job_type", "'' AS description", "false AS closed"
            )
            I.sync_window(table, "crawl", [f"s{k}" for k in range(7)], 3, listings, AS_OF, run)
    return table.read().select("job_key", "title")
