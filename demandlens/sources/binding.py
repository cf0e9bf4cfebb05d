"""The job-market domain over the tables of the test data.

The SQL below is plain enough for Spark and DuckDB; Spark registers it as temporary views, the checks put it before
their own SQL as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandlens.session import TABLES, dealt, honest_sizes, parts_for, table, whole_unions

#: The moments that stand for now.
AS_OF = "2001-11-05 00:00:00"
LOG_AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "d_company": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS industry, n_name AS location
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "d_job_post": """SELECT o_orderkey AS id, o_custkey AS company_id,
        concat(c_mktsegment, ' engineer ', CAST(o_orderkey % 97 AS STRING)) AS title,
        CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'APPLIED'
          ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'ARCHIVED' ELSE 'CLOSED' END END AS status,
        CASE o_orderkey % 4 WHEN 0 THEN 'MANUAL' WHEN 1 THEN 'URL' WHEN 2 THEN 'EMAIL' ELSE 'CSV' END AS source_type,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Full-time' WHEN '2-HIGH' THEN 'Contract'
          WHEN '3-MEDIUM' THEN 'Part-time' WHEN '5-LOW' THEN 'Internship' ELSE '' END AS employment_type,
        CASE o_orderkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' ELSE 'On-site' END AS remote_type,
        CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE n_name END AS location,
        o_orderdate AS created_at,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL '30' DAY END AS last_synced_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "d_skill_set": """SELECT p_partkey AS id, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name, p_size <= 45 AS is_active,
        p_type AS category, p_brand AS business_category, p_size % 10 AS market_category, p_size % 5 <> 0 AS is_approved FROM part""",
    "d_link": """SELECT l_orderkey * 1000000 + l_partkey AS id, l_orderkey AS job_post_id, l_partkey AS skill_set_id,
        CAST(max(floor(l_quantity)) * 2 AS INT) AS score, max(l_shipdate) AS created_at,
        concat('{"source":"', CASE max(l_returnflag) WHEN 'A' THEN 'greenhouse' WHEN 'N' THEN 'linkedin'
          ELSE 'Handshake' END, '"}') AS extraction_metadata
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "d_pipeline_log": """SELECT event_id AS id, ts AS created_at, user_id AS crawl_run_id, event_type AS step_name,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'STARTED' ELSE 'SUCCESS' END AS status,
        CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(value * 1000) AS BIGINT) END AS duration_ms,
        props AS metadata FROM events""",
    "d_application": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey AS job_post_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'OFFER' WHEN '2-HIGH' THEN 'TECH' WHEN '3-MEDIUM' THEN 'APPLIED'
          WHEN '5-LOW' THEN 'REJECTED' ELSE 'SAVED' END AS status,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderdate END AS applied_at
        FROM orders WHERE o_orderstatus = 'P'""",
    "d_application_skill": """SELECT job_post_id AS application_id, skill_set_id, max(score) AS score FROM (
        SELECT l.job_post_id, l.skill_set_id, l.score FROM d_link l JOIN d_application a ON a.id = l.job_post_id
        WHERE l.skill_set_id % 2 = 0
        UNION ALL
        SELECT l.job_post_id, l.skill_set_id + 1 AS skill_set_id, 0 AS score FROM d_link l
        JOIN d_application a ON a.id = l.job_post_id JOIN d_skill_set s ON s.id = l.skill_set_id + 1
        WHERE l.skill_set_id % 5 = 0) u GROUP BY job_post_id, skill_set_id""",
    "d_job_source": """SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 2 WHEN 0 THEN 'LINKEDIN' ELSE 'GREENHOUSE' END AS resource,
        s_acctbal > 0 AS enabled, n_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "d_crawl_run": """SELECT user_id AS id, min(ts) AS started_at, max(ts) AS finished_at, count(*) AS total_sources,
        sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) AS processed_sources,
        sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors FROM events GROUP BY user_id""",
    "d_category": """SELECT n_nationkey + 100 AS id, n_name AS name, n_regionkey AS parent_id FROM nation
        UNION ALL SELECT r_regionkey AS id, r_name AS name, NULL AS parent_id FROM region""",
    "d_skill_embedding": "SELECT vec_id AS id, embedding FROM embeddings JOIN part ON p_partkey = vec_id",
}

#: Views that join or group a whole table, whose rows are dealt by the keys first.
GROUPED = {"d_link": ("lineitem", ["l_orderkey", "l_partkey"]), "d_application_skill": ("d_link", ["job_post_id"])}

#: The view over links and all their dimensions that filters apply to.
STAR = """SELECT l.id, l.job_post_id, l.skill_set_id, l.score, l.created_at, l.extraction_metadata, s.name AS skill_name, s.category AS skill_category,
    s.business_category, s.market_category, s.is_active, s.is_approved, j.title, j.company_id, j.status, j.source_type, j.employment_type,
    j.remote_type, j.location, j.created_at AS job_created_at, j.last_synced_at, c.name AS company_name, c.industry
    FROM d_link l JOIN d_skill_set s ON l.skill_set_id = s.id JOIN d_job_post j ON l.job_post_id = j.id JOIN d_company c ON j.company_id = c.id"""


class Domain:
    """The domain's DataFrames over one data folder: ``domain.d_link`` and so on, raw tables by their names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        whole_unions(spark)
        honest_sizes(spark)
        self._spark, self._dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = table(self._spark, self._dir, name)
            else:
                text = VIEWS[name]
                for other in (*TABLES, *VIEWS):
                    if other != name and other in text.replace("(", " ").split():
                        getattr(self, other).createOrReplaceTempView(other)
                if name in GROUPED:
                    raw, keys = GROUPED[name]
                    rows = getattr(self, raw)
                    dealt(rows, parts_for(rows), *keys).createOrReplaceTempView(raw)
                self._made[name] = self._spark.sql(text)
        return self._made[name]


def with_views(sql: str) -> str:
    """SQL for DuckDB: the views as common table expressions before the statement."""
    views = ",\n".join(f"{name} AS ({text})" for name, text in [*VIEWS.items(), ("d_star", STAR)])
    return f"WITH {views}\n{sql}"
