"""Set comparisons, resume matching and vectors. The resume is a fixed set of skills, so that results can be checked."""

from pyspark.sql import functions as F

from demandlens.functions.vectors import valid
from demandlens.operators import demand as D
from demandlens.operators import matching as M
from demandlens.plans.catalog import query
from demandlens.plans.demand_queries import DEMAND, demands
from demandlens.plans.skill_queries import star

RESUME = "(SELECT id AS skill_set_id FROM d_skill_set WHERE is_active AND id % 50 = 0)"
COMPARED = """(SELECT coalesce(m.application_id, a.application_id) AS application_id, coalesce(m.skill_set_id, a.skill_set_id) AS skill_set_id,
    CASE WHEN m.skill_set_id IS NULL THEN 'missing' WHEN a.skill_set_id IS NULL THEN 'extra' ELSE 'matched' END AS kind FROM d_application_skill m
    FULL JOIN (SELECT p.id AS application_id, l.skill_set_id FROM d_application p JOIN d_link l USING (job_post_id)) a ON a.application_id = m.application_id AND a.skill_set_id = m.skill_set_id)"""
CLAMPED = "greatest(0.0, least(1.0, coalesce(list_cosine_similarity(m.embedding::DOUBLE[], r.embedding::DOUBLE[]), 0.0)))"


def resume(d):
    return d.d_skill_set.where("is_active AND id % 50 = 0").selectExpr("id AS skill_set_id")


def compared(d):
    return M.application_comparison(d.d_application, d.d_application_skill, d.d_link)


def resume_vectors(d):
    return d.d_skill_embedding.where("id % 50 = 0").selectExpr("id AS query_id", "embedding AS query")


@query("application_comparison", f"SELECT application_id, skill_set_id, kind FROM {COMPARED}")
def application_comparison(d):
    return compared(d)


@query("comparison_lists", f"""SELECT application_id, coalesce(string_agg(CAST(skill_set_id AS VARCHAR), ',' ORDER BY skill_set_id) FILTER (kind = 'matched'), '') AS matched,
    coalesce(string_agg(CAST(skill_set_id AS VARCHAR), ',' ORDER BY skill_set_id) FILTER (kind = 'missing'), '') AS missing, coalesce(string_agg(CAST(skill_set_id AS VARCHAR), ',' ORDER BY skill_set_id) FILTER (kind = 'extra'), '') AS extra FROM {COMPARED} GROUP BY 1""")
def comparison_lists(d):
    return M.comparison_lists(compared(d))


@query("application_only_skills", f"SELECT application_id, skill_set_id FROM {COMPARED} WHERE kind = 'extra'")
def application_only_skills(d):
    return compared(d).where("kind = 'extra'").select("application_id", "skill_set_id")


@query("job_matches", f"""SELECT job_post_id, matched, required, CAST(floor((matched * 2000 + required) / (2 * required)) AS DOUBLE) / 10 AS match_percent, title, company_id FROM
    (SELECT job_post_id, count(*) FILTER (skill_set_id IN {RESUME}) AS matched, count(*) AS required FROM d_link GROUP BY 1) x JOIN d_job_post j ON j.id = x.job_post_id
    WHERE matched > 0 ORDER BY match_percent DESC, matched DESC, company_id, lower(title), job_post_id LIMIT 20""")
def job_matches(d):
    return M.job_matches(d.d_link, resume(d), d.d_job_post).select("job_post_id", "matched", "required", "match_percent", "title", "company_id")


@query("job_match_lists", f"""SELECT job_post_id, array_to_string(m, ', ') AS matched, coalesce(array_to_string(x[1:6], ', '), '') AS missing, CAST(floor((len(m) * 2000 + n) / (2 * n)) AS DOUBLE) / 10 AS match_percent FROM (SELECT job_post_id, list(s.name ORDER BY s.id) FILTER (s.id IN {RESUME}) AS m,
    list(s.name ORDER BY s.id) FILTER (s.id NOT IN {RESUME}) AS x, count(*) AS n FROM d_link l JOIN d_skill_set s ON s.id = l.skill_set_id GROUP BY 1) WHERE m IS NOT NULL""")
def job_match_lists(d):
    found = M.job_match_lists(d.d_link, resume(d), d.d_skill_set)
    return found.select("job_post_id", F.array_join("matched", ", ").alias("matched"), F.array_join("missing", ", ").alias("missing"), "match_percent")


@query("missing_categories", f"SELECT skill_category, count(DISTINCT job_post_id) AS job_count FROM d_star WHERE skill_category NOT IN (SELECT category FROM d_skill_set WHERE id IN {RESUME} AND id IN (SELECT skill_set_id FROM d_link)) GROUP BY 1")
def missing_categories(d):
    return M.missing_categories(star(d), resume(d))


@query("missing_high_demand", f"SELECT skill_set_id, demand_score FROM (SELECT * FROM {DEMAND} ORDER BY demand_score DESC, skill_set_id LIMIT 20) WHERE skill_set_id NOT IN (SELECT skill_set_id FROM {RESUME}) ORDER BY demand_score DESC, skill_set_id LIMIT 10")
def missing_high_demand(d):
    return M.missing_high_demand(demands(d), resume(d)).select("skill_set_id", "demand_score")


@query("recommended_skills", f"""SELECT x.skill_set_id, s.name AS skill_name, round(demand_score + CASE WHEN trend_type = 'rising' THEN 25 ELSE 0 END, 2) AS priority FROM {DEMAND} x JOIN d_skill_set s ON s.id = x.skill_set_id
    ORDER BY priority DESC, skill_name, 1 LIMIT 10""")
def recommended_skills(d):
    return M.recommended(D.named(demands(d), d.d_skill_set)).select("skill_set_id", "skill_name", "priority")


@query("resume_category_counts", f"SELECT category, count(*) AS skills FROM d_skill_set WHERE id IN {RESUME} AND is_approved GROUP BY 1")
def resume_category_counts(d):
    mine = d.d_skill_set.where("is_approved").join(resume(d).withColumnRenamed("skill_set_id", "id"), "id", "left_semi")
    return mine.groupBy("category").agg(F.count("*").alias("skills"))


@query("resume_profile_pct", f"""SELECT category, n, CAST(share + CASE WHEN first THEN 100 - sum(share) OVER () ELSE 0 END AS BIGINT) AS percent FROM (SELECT *, row_number() OVER (ORDER BY n DESC, category) = 1 AS first FROM
    (SELECT category, n, CAST(round_even(n * 100.0 / sum(n) OVER (), 0) AS BIGINT) AS share FROM (SELECT category, count(*) AS n FROM d_skill_set WHERE id IN {RESUME} GROUP BY 1)))""")
def resume_profile_pct(d):
    mine = d.d_skill_set.join(resume(d).withColumnRenamed("skill_set_id", "id"), "id", "left_semi").groupBy("category").agg(F.count("*").alias("n"))
    return M.whole_percentages(mine, "n", ["category"])


COSINE = "list_cosine_similarity(m.embedding::DOUBLE[], r.embedding::DOUBLE[])"


def named_vectors(d):
    return d.d_skill_embedding.join(d.d_skill_set.select("id", "name"), "id")


@query("knn_top_k", f"""SELECT m.id, round(greatest(0, {COSINE}), 5) AS similarity FROM d_skill_embedding m JOIN d_skill_set s ON s.id = m.id, (SELECT embedding FROM d_skill_embedding WHERE id = 3) r ORDER BY {COSINE} DESC, s.name, m.id LIMIT 11""")
def knn_top_k(d):
    query = d.d_skill_embedding.where("id = 3").selectExpr("-1L AS query_id", "embedding AS query")
    return M.top_k(named_vectors(d), query, 11).select("id", "similarity").withColumn("similarity", F.round("similarity", 5))


@query("knn_batch", f"""SELECT query_id, id, similarity, rank FROM (SELECT r.id AS query_id, m.id, round(greatest(0, {COSINE}), 5) AS similarity,
    row_number() OVER (PARTITION BY r.id ORDER BY {COSINE} DESC, s.name, m.id) AS rank FROM d_skill_embedding m JOIN d_skill_set s ON s.id = m.id JOIN d_skill_embedding r ON m.id <> r.id AND r.id % 50 = 0) WHERE rank <= 5""")
def knn_batch(d):
    return M.top_k(named_vectors(d), resume_vectors(d), 5).select("query_id", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


#: Demand in which every second skill of the resume is missing, so that both rules are met.
MARKET = "(SELECT skill_set_id, count(*) AS demand FROM d_star WHERE status = 'ACTIVE' AND skill_set_id % 100 <> 0 GROUP BY 1)"
FIT = f"""(SELECT q.id AS query_id, CASE WHEN w.skill_set_id IS NOT NULL THEN q.id ELSE b.id END AS id, CASE WHEN w.skill_set_id IS NOT NULL THEN 1.0 ELSE coalesce(b.similarity, 0) END AS similarity, coalesce(w.demand, b.demand, 0) AS demand
    FROM d_skill_set q LEFT JOIN {MARKET} w ON w.skill_set_id = q.id LEFT JOIN (SELECT r.id AS query_id, m.id, {CLAMPED} AS similarity, y.demand FROM d_skill_embedding r, d_skill_embedding m JOIN {MARKET} y ON y.skill_set_id = m.id
    JOIN d_skill_set s ON s.id = m.id WHERE r.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY {CLAMPED} DESC, s.name, m.id) = 1) b ON b.query_id = q.id WHERE q.is_active AND q.id % 50 = 0)"""


def market(d):
    return D.active_demand(d.d_link, d.d_job_post).where("skill_set_id % 100 <> 0")


def fitted(d):
    return M.market_matches(resume(d), d.d_skill_embedding, d.d_skill_set, market(d))


@query("best_market_match", f"SELECT query_id, id, round(similarity, 5) AS similarity FROM {FIT}")
def best_market_match(d):
    return fitted(d).select("query_id", "id", F.round("similarity", 5).alias("similarity"))


@query("missing_market_skills", f"""SELECT x.id, x.similarity, y.demand FROM (SELECT m.id, round(max({CLAMPED}), 5) AS similarity FROM d_skill_embedding m, d_skill_embedding r WHERE r.id % 50 = 0 GROUP BY 1) x
    JOIN (SELECT skill_set_id, count(*) AS demand FROM d_star WHERE status = 'ACTIVE' GROUP BY 1) y ON y.skill_set_id = x.id WHERE similarity < 0.7 AND x.id % 50 <> 0 ORDER BY demand DESC, x.id LIMIT 20""")
def missing_market_skills(d):
    similar = M.most_similar_per_market(resume_vectors(d), d.d_skill_embedding).withColumn("similarity", F.round("similarity", 5)).where("similarity < 0.7 AND id % 50 <> 0")
    both = similar.join(D.active_demand(d.d_link, d.d_job_post).withColumnRenamed("skill_set_id", "id"), "id")
    return both.orderBy(F.desc("demand"), "id").limit(20)


@query("market_fit", f"""SELECT round(100 * coalesce(sum(demand * similarity) FILTER (demand > 0) / sum(demand) FILTER (demand > 0), 0), 1) AS fit_percent,
    count(*) FILTER (similarity >= 0.7) AS matched, count(*) AS skills FROM {FIT}""")
def market_fit(d):
    return M.market_fit(fitted(d))


@query("embedding_valid", "SELECT id, len(embedding) = 64 AS valid FROM d_skill_embedding")
def embedding_valid(d):
    return d.d_skill_embedding.select("id", valid(F.col("embedding"), 64).alias("valid"))
