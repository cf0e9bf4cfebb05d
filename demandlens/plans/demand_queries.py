"""Demand, trends and categories."""

from pyspark.sql import functions as F

from demandlens.operators import demand as D
from demandlens.plans.catalog import query
from demandlens.plans.skill_queries import star
from demandlens.sources.binding import AS_OF

DEMAND = f"""(SELECT *, round(ratio, 4) AS growth_ratio, round(unique_jobs + 2 * rolling_30 + 10 * ratio, 2) AS demand_score,
    CASE WHEN (rolling_30 > 0 AND rolling_90 <= rolling_30) OR ratio >= 1.25 THEN 'rising' WHEN ratio <= 0.75 THEN 'declining' ELSE 'stable' END AS trend_type FROM (
    SELECT *, CASE WHEN rolling_90 <= 0 THEN CASE WHEN rolling_30 <= 0 THEN 1.0::DOUBLE ELSE 2.0 END
      WHEN rolling_90 > rolling_30 THEN (rolling_30 / 30.0::DOUBLE) / ((rolling_90 - rolling_30) / 60.0::DOUBLE) ELSE (rolling_30 / 30.0::DOUBLE) / (rolling_90 / 90.0::DOUBLE) END AS ratio FROM (
    SELECT skill_set_id, count(*) AS total_occurrences, count(DISTINCT job_post_id) AS unique_jobs, min(created_at) AS first_seen, max(created_at) AS last_seen,
      count(DISTINCT job_post_id) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS rolling_30, count(DISTINCT job_post_id) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY) AS rolling_90
    FROM d_link GROUP BY skill_set_id)))"""


def demands(d):
    return D.demand(d.d_link, AS_OF)


@query("skill_demand", f"SELECT skill_set_id, total_occurrences, unique_jobs, first_seen, last_seen, rolling_30, rolling_90, trend_type, growth_ratio, demand_score FROM {DEMAND}")
def skill_demand(d):
    return demands(d)


@query("skill_trend_type", f"SELECT trend_type, count(*) AS n, min(growth_ratio) AS low, max(growth_ratio) AS high FROM {DEMAND} GROUP BY trend_type")
def skill_trend_type(d):
    return demands(d).groupBy("trend_type").agg(F.count("*").alias("n"), F.min("growth_ratio").alias("low"), F.max("growth_ratio").alias("high"))


def _ranked(name: str, where: str, order: str, f):
    @query(name, f"SELECT x.skill_set_id, s.name AS skill_name, x.demand_score, x.growth_ratio, x.trend_type FROM {DEMAND} x JOIN d_skill_set s ON s.id = x.skill_set_id WHERE {where} ORDER BY {order}, s.name, s.id LIMIT 10")
    def run(d, f=f):
        return f(d).select("skill_set_id", "skill_name", "demand_score", "growth_ratio", "trend_type")


_ranked("demand_top", "true", "demand_score DESC", lambda d: D.ranked(demands(d), d.d_skill_set, ["demand_score"], 10))
_ranked("emerging_skills", "trend_type = 'rising'", "growth_ratio DESC, demand_score DESC", lambda d: D.emerging(demands(d), d.d_skill_set))
_ranked("fastest_growing", "true", "growth_ratio DESC", lambda d: D.ranked(demands(d), d.d_skill_set, ["growth_ratio"], 10))
_ranked("trending_skills", "trend_type <> 'declining'", "growth_ratio DESC, unique_jobs DESC", lambda d: D.ranked(demands(d).where("trend_type <> 'declining'"), d.d_skill_set, ["growth_ratio", "unique_jobs"], 10))
_ranked("category_top_skills", "s.category = 'ECONOMY'", "demand_score DESC", lambda d: D.category_top_skills(demands(d), d.d_skill_set, "economy"))


@query("trend_with_demand", f"SELECT t.skill_set_id, t.trend_type, t.growth_ratio, x.demand_score, x.unique_jobs FROM {DEMAND} t LEFT JOIN (SELECT * FROM {DEMAND} WHERE unique_jobs > 30) x USING (skill_set_id)")
def trend_with_demand(d):
    return D.trends_with_demand(demands(d), demands(d).where("unique_jobs > 30"))


def _counts(name: str, column: str, approved: bool):
    where = "WHERE is_approved" if approved else ""

    @query(name, f"SELECT CAST({column} AS VARCHAR) AS category, count(DISTINCT job_post_id) AS job_count FROM d_star {where} GROUP BY 1")
    def run(d):
        return D.category_counts(star(d), column, approved)


_counts("esco_category_counts", "skill_category", False)
_counts("business_category_counts", "business_category", True)
_counts("market_category_counts", "market_category", True)


@query("category_share", """SELECT category, job_count, CAST(floor((job_count * 2000 + t) / (2 * t)) AS DOUBLE) / 10 AS share FROM (SELECT *, CAST(sum(job_count) OVER () AS BIGINT) AS t FROM
    (SELECT business_category AS category, count(DISTINCT job_post_id) AS job_count FROM d_star GROUP BY 1)) ORDER BY job_count DESC, lower(category), category LIMIT 5""")
def category_share(d):
    return D.category_share(D.category_counts(star(d), "business_category"))


@query("top_categories", "SELECT skill_category AS category, count(DISTINCT job_post_id) AS job_count FROM d_star GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_categories(d):
    return D.category_counts(star(d), "skill_category").orderBy(F.desc("job_count"), "category").limit(3)


@query("active_demand", "SELECT skill_set_id, count(*) AS demand FROM d_star WHERE status = 'ACTIVE' GROUP BY 1")
def active_demand(d):
    return D.active_demand(d.d_link, d.d_job_post)


@query("top_skill_demand", """SELECT x.skill_set_id, coalesce(s.name, 'Skill #' || x.skill_set_id) AS skill_name, demand FROM (SELECT skill_set_id, count(*) AS demand FROM d_star WHERE status = 'ACTIVE' GROUP BY 1) x
    LEFT JOIN (SELECT * FROM d_skill_set WHERE is_active) s ON s.id = x.skill_set_id ORDER BY demand DESC, lower(coalesce(s.name, 'Skill #' || x.skill_set_id)), 1 LIMIT 10""")
def top_skill_demand(d):
    named = D.active_demand(d.d_link, d.d_job_post).join(d.d_skill_set.where("is_active").selectExpr("id AS skill_set_id", "name"), "skill_set_id", "left")
    name = F.coalesce("name", F.concat(F.lit("Skill #"), F.col("skill_set_id").cast("string")))
    return named.select("skill_set_id", name.alias("skill_name"), "demand").orderBy(F.desc("demand"), F.lower("skill_name"), "skill_set_id").limit(10)


@query("demand_stale", f"SELECT skill_set_id, demand_score FROM {DEMAND} WHERE skill_set_id NOT IN (SELECT CASE WHEN skill_set_id % 9 = 0 THEN 0 ELSE skill_set_id END FROM d_link)")
def demand_stale(d):
    left = d.d_link.withColumn("skill_set_id", F.expr("CASE WHEN skill_set_id % 9 = 0 THEN 0 ELSE skill_set_id END"))
    return D.stale(demands(d), left).select("skill_set_id", "demand_score")
