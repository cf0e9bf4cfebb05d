"""Skill analytics, filters, scans and joins."""

from pyspark.sql import functions as F

from demandlens.operators import search as Q
from demandlens.operators import skills as S
from demandlens.plans.catalog import query
from demandlens.sources.binding import AS_OF

MEAN = "CAST(floor((sum({0}) * 200 + count({0})) / (2 * count({0}))) AS DOUBLE) / 100"


def star(d):
    return S.star(d.d_link, d.d_skill_set, d.d_job_post, d.d_company)


@query("top_skills", f"""SELECT skill_set_id, skill_name, count(DISTINCT job_post_id) AS job_count, {MEAN.format('score')} AS avg_score, CAST(max(score) AS BIGINT) AS max_score
    FROM d_star GROUP BY ALL ORDER BY job_count DESC, avg(score) DESC, skill_name, skill_set_id LIMIT 10""")
def top_skills(d):
    return S.top_skills(star(d))


@query("skill_trends", """SELECT strftime(created_at, '%Y-%m') AS period, skill_set_id, skill_name, count(DISTINCT job_post_id) AS job_count, count(*) AS link_count FROM d_star
    WHERE skill_set_id IN (SELECT skill_set_id FROM d_star GROUP BY skill_set_id, skill_name ORDER BY count(DISTINCT job_post_id) DESC, avg(score) DESC, skill_name LIMIT 5) GROUP BY ALL""")
def skill_trends(d):
    return S.skill_trends(star(d))


@query("skill_coverage", f"""SELECT t.n AS total_jobs, l.j AS jobs_with_skills, CAST(floor((l.j * 20000 + t.n) / (2 * t.n)) AS DOUBLE) / 100 AS coverage, l.links, l.avg_score, l.strong AS strong_links
    FROM (SELECT count(*) AS n FROM d_job_post) t, (SELECT count(DISTINCT job_post_id) AS j, count(*) AS links, {MEAN.format('score')} AS avg_score, count(*) FILTER (score >= 80) AS strong FROM d_star) l""")
def skill_coverage(d):
    return S.skill_coverage(star(d), d.d_job_post)


@query("skill_gap", """SELECT b.skill_set_id, b.skill_name, coalesce(t.n, 0) AS target_jobs, b.n AS benchmark_jobs, b.n - coalesce(t.n, 0) AS gap
    FROM (SELECT skill_set_id, skill_name, count(DISTINCT job_post_id) AS n FROM d_star WHERE company_id <> 1 GROUP BY ALL) b
    LEFT JOIN (SELECT skill_set_id, count(DISTINCT job_post_id) AS n FROM d_star WHERE company_id = 1 GROUP BY ALL) t USING (skill_set_id)
    WHERE b.n > coalesce(t.n, 0) ORDER BY gap DESC, benchmark_jobs DESC, skill_name, skill_set_id LIMIT 50""")
def skill_gap(d):
    return S.skill_gap(star(d), 1)


@query("company_breakdown", f"""SELECT company_id, company_name, skill_set_id, skill_name, count(DISTINCT job_post_id) AS job_count, count(*) AS links, {MEAN.format('score')} AS avg_score,
    row_number() OVER (PARTITION BY company_id ORDER BY count(DISTINCT job_post_id) DESC, sum(score) * 1.0 / count(*) DESC, skill_name, skill_set_id) AS rank FROM d_star GROUP BY ALL QUALIFY rank <= 3""".replace("GROUP BY ALL", "GROUP BY company_id, company_name, skill_set_id, skill_name"))
def company_breakdown(d):
    return S.company_breakdown(d.d_link, d.d_skill_set, d.d_job_post, d.d_company)


@query("job_category_skills", f"""SELECT CASE WHEN employment_type = '' THEN 'Unspecified' ELSE employment_type END AS category, skill_set_id, skill_name, count(DISTINCT job_post_id) AS job_count, count(*) AS links,
    {MEAN.format('score')} AS avg_score, row_number() OVER (PARTITION BY employment_type ORDER BY count(DISTINCT job_post_id) DESC, avg(score) DESC, skill_name, skill_set_id) AS rank
    FROM d_star GROUP BY employment_type, skill_set_id, skill_name QUALIFY rank <= 3""")
def job_category_skills(d):
    return S.job_category_skills(star(d))


@query("trend_periods", "SELECT strftime(created_at, '%Y-%m') AS period FROM d_link GROUP BY 1")
def trend_periods(d):
    return d.d_link.select(F.date_format("created_at", "yyyy-MM").alias("period")).distinct().orderBy("period")


@query("rows_with_share", """SELECT skill_set_id, skill_name, job_count, CAST(floor((job_count * 2000 + m) / (2 * m)) AS DOUBLE) / 10 AS share FROM
    (SELECT *, max(job_count) OVER () AS m FROM (SELECT skill_set_id, skill_name, count(DISTINCT job_post_id) AS job_count FROM d_star GROUP BY ALL))""")
def rows_with_share(d):
    return S.rows_with_share(S.by_skill(star(d)).select("skill_set_id", "skill_name", "job_count"))


@query("group_rows", """SELECT industry, CAST(sum(n) AS BIGINT) AS total, count(*) AS n_items, string_agg(location || '=' || n, ';' ORDER BY n DESC, location) AS items
    FROM (SELECT industry, location, count(*) AS n FROM d_company GROUP BY ALL) GROUP BY industry""")
def group_rows(d):
    return S.group_rows(d.d_company.groupBy("industry", "location").agg(F.count("*").alias("n")), "industry", "location", "n")


@query("scan_company", "SELECT id, name, industry, location FROM d_company")
def scan_company(d):
    return d.d_company.orderBy("name", "id")


@query("scan_links_joined", "SELECT id, skill_name, title, company_name, score FROM d_star")
def scan_links_joined(d):
    return star(d).select("id", "skill_name", "title", "company_name", "score")


@query("join_star", "SELECT industry, skill_category, count(*) AS links, CAST(sum(score) AS BIGINT) AS score FROM d_star GROUP BY ALL")
def join_star(d):
    return star(d).groupBy("industry", "skill_category").agg(F.count("*").alias("links"), F.sum("score").alias("score"))


@query("job_with_skill_array", "SELECT job_post_id, count(*) AS n_skills, string_agg(skill_name, ', ' ORDER BY score DESC, skill_name, skill_set_id) AS skills FROM d_star GROUP BY job_post_id")
def job_with_skill_array(d):
    return S.job_skill_array(star(d))


@query("job_skill_display", "SELECT job_post_id, string_agg(skill_name, ', ' ORDER BY skill_name) AS display FROM d_star GROUP BY job_post_id")
def job_skill_display(d):
    return S.job_skill_display(star(d))


def _filtered(name: str, condition: str, **given):
    @query(name, f"SELECT id, job_post_id, skill_set_id, score FROM d_star WHERE {condition}")
    def run(d, given=given):
        request = given.get("request")
        filters = S.LinkFilters.from_request(request, AS_OF[:10]) if request else S.LinkFilters(**given)
        rows = filters.apply(star(d))
        if more := given.get("and_also"):
            rows = S.LinkFilters(**more).apply(rows)
        return rows.select("id", "job_post_id", "skill_set_id", "score")


_filtered("links_filtered", """contains(lower(company_name), 'customer#00000001') AND contains(lower(location), 'nation_1') AND lower(remote_type) = 'remote'
    AND (lower(json_extract_string(extraction_metadata, '$.source')) = 'linkedin' OR lower(source_type) = 'linkedin') AND score BETWEEN 10 AND 90 AND created_at >= '1996-01-01' AND CAST(created_at AS DATE) <= '2000-12-31'""",
          company_name="CUSTOMER#00000001", location="nation_1", remote_type="REMOTE", canonical_source="LinkedIn", score_min=10, score_max=90, start="1996-01-01", end="2000-12-31")
_filtered("links_date_range", "CAST(created_at AS DATE) BETWEEN '1998-03-01' AND '1998-03-31'", start="1998-03-01", end="1998-03-31")
_filtered("links_date_basis", "CAST(last_synced_at AS DATE) BETWEEN '1998-03-01' AND '1998-03-31'", start="1998-03-01", end="1998-03-31", date_basis=" Synced ")
_filtered("links_date_basis_spellings", "CAST(last_synced_at AS DATE) BETWEEN '1998-03-01' AND '1998-03-31' AND CAST(job_created_at AS DATE) >= '1998-02-15'",
          request={"date_from": "1998-03-01", "to": "1998-03-31", "date_basis": "Last-Synced"}, and_also={"start": "1998-02-15", "date_basis": "job-created"})
_filtered("filters_of_request", "lower(employment_type) = 'full-time' AND score >= 60 AND company_id = 5 AND CAST(created_at AS DATE) >= '1995-06-01'",
          request={"job_type": "FULL_TIME", "min_score": "60", "max_score": "many", "company_id": "5", "date_basis": "skill-attachment", "from": "1995-06-01"})
_filtered("links_days_window", f"CAST(created_at AS DATE) >= CAST('{AS_OF}' AS DATE) - 30", request={"window_days": "30", "from": "no date"})
_filtered("flt_icontains", "lower(company_name) LIKE '%r#00000001%'", company_name="R#00000001")
_filtered("flt_iexact", "lower(employment_type) = 'full-time'", employment_type="FULL-TIME")
_filtered("flt_json_path", "json_extract_string(extraction_metadata, '$.source') ILIKE 'handshake' OR source_type ILIKE 'handshake'", canonical_source="HANDSHAKE")
_filtered("flt_score_range", "score >= 40 AND score <= 60", score_min=40, score_max=60)
_filtered("flt_exact", "company_id = 7 AND source_type = 'CSV'", company_id=7, source_type="CSV")


@query("jobs_filtered", """SELECT j.id, j.title, j.status FROM d_job_post j WHERE lower(j.remote_type) = 'hybrid' AND (lower(j.source_type) = 'greenhouse'
    OR EXISTS (SELECT 1 FROM d_link l WHERE l.job_post_id = j.id AND lower(json_extract_string(l.extraction_metadata, '$.source')) = 'greenhouse')) AND j.created_at >= '1997-01-01'""")
def jobs_filtered(d):
    given = S.LinkFilters(remote_type="hybrid", canonical_source="greenhouse", start="1997-01-01", date_basis="job", score_min=99)
    return S.filtered_jobs(d.d_job_post, d.d_company, d.d_link, given).select("id", "title", "status")


@query("flt_in", "SELECT id, title FROM d_job_post WHERE status IN ('ARCHIVED', 'CLOSED') AND id IN (SELECT job_post_id FROM d_link WHERE score > 98)")
def flt_in(d):
    strong = d.d_link.where("score > 98").selectExpr("job_post_id AS id")
    return d.d_job_post.where(F.col("status").isin("ARCHIVED", "CLOSED")).join(strong, "id", "left_semi").select("id", "title")


@query("flt_null", "SELECT count(*) FILTER (last_synced_at IS NULL) AS unsynced, count(last_synced_at) AS synced FROM d_job_post")
def flt_null(d):
    return d.d_job_post.agg(F.count_if(F.col("last_synced_at").isNull()).alias("unsynced"), F.count_if(F.col("last_synced_at").isNotNull()).alias("synced"))


@query("flt_exclude", "SELECT id FROM d_job_post WHERE last_synced_at IS NULL OR last_synced_at < '2000-01-01'")
def flt_exclude(d):
    return d.d_job_post.where(~F.coalesce(F.col("last_synced_at") >= F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'"), F.lit(False))).select("id")


@query("flt_date_parts", "SELECT id FROM d_job_post WHERE month(created_at) = 2 AND year(created_at) = 1997")
def flt_date_parts(d):
    return d.d_job_post.where((F.month("created_at") == 2) & (F.year("created_at") == 1997)).select("id")


@query("flt_ts_text", "SELECT id FROM d_job_post WHERE CAST(created_at AS VARCHAR) LIKE '%1998-1%'")
def flt_ts_text(d):
    return d.d_job_post.where(F.col("created_at").cast("string").contains("1998-1")).select("id")


@query("flt_json_text", """SELECT id FROM d_pipeline_log WHERE metadata LIKE '%"k": 6%'""")
def flt_json_text(d):
    return d.d_pipeline_log.where(F.col("metadata").contains('"k": 6')).select("id")


@query("case_enabled", "SELECT id, if(enabled, 'Enabled', 'Disabled') AS state FROM d_job_source")
def case_enabled(d):
    return d.d_job_source.select("id", F.when(F.col("enabled"), "Enabled").otherwise("Disabled").alias("state"))


@query("project_subset", "SELECT skill_set_id, score FROM d_link WHERE score >= 96")
def project_subset(d):
    return d.d_link.where("score >= 96").select("skill_set_id", "score")


@query("semi_companies", "SELECT id, name FROM d_company WHERE id IN (SELECT company_id FROM d_job_post)")
def semi_companies(d):
    return d.d_company.join(d.d_job_post.selectExpr("company_id AS id"), "id", "left_semi").select("id", "name")


@query("orphan_skills", "SELECT id, name FROM d_skill_set s WHERE NOT EXISTS (SELECT 1 FROM d_link l WHERE l.skill_set_id = s.id AND l.score > 98)")
def orphan_skills(d):
    return d.d_skill_set.join(d.d_link.where("score > 98").selectExpr("skill_set_id AS id"), "id", "left_anti").select("id", "name")


@query("jobs_missing_skills", "SELECT id, title, status FROM d_job_post j WHERE status <> 'ARCHIVED' AND NOT EXISTS (SELECT 1 FROM d_link l WHERE l.job_post_id = j.id)")
def jobs_missing_skills(d):
    return d.d_job_post.where("status <> 'ARCHIVED'").join(d.d_link.selectExpr("job_post_id AS id"), "id", "left_anti").select("id", "title", "status")


SCOPED = "SELECT id, status, company_id, CASE id % 4 WHEN 0 THEN concat('https://boards.example.org/', CAST(id AS STRING)) WHEN 1 THEN concat('jobs.example.com/', CAST(id AS STRING)) WHEN 2 THEN 'https://notexample.com/' ELSE '' END AS source_url FROM d_job_post"


@query("jobs_missing_skills_scoped", rf"SELECT id FROM ({SCOPED}) j WHERE status <> 'ARCHIVED' AND (regexp_matches(source_url, '^(https://)?([a-z]+\.)*example\.(org|com)/') OR company_id IN (1, 7, 10)) AND NOT EXISTS (SELECT 1 FROM d_link l WHERE l.job_post_id = j.id AND l.skill_set_id % 4 = 0)")
def jobs_missing_skills_scoped(d):
    d.d_job_post.createOrReplaceTempView("d_job_post")
    return S.without_skills(d._spark.sql(SCOPED), d.d_link.where("skill_set_id % 4 = 0"), ["example.org", "example.com"], [1, 7, 10]).select("id")


@query("category_parent", "SELECT c.id, c.name, p.name AS parent FROM d_category c LEFT JOIN d_category p ON c.parent_id = p.id")
def category_parent(d):
    c, p = d.d_category.alias("c"), d.d_category.alias("p")
    return c.join(p, F.col("c.parent_id") == F.col("p.id"), "left").selectExpr("c.id", "c.name", "p.name AS parent")


@query("missing_parents", "SELECT id, name FROM d_category WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM d_category WHERE id <> 2)")
def missing_parents(d):
    known = d.d_category.where("id <> 2").selectExpr("id AS parent_id")
    return d.d_category.where("parent_id IS NOT NULL").join(known, "parent_id", "left_anti").select("id", "name")


@query("recent_jobs", "SELECT id, title, created_at FROM d_job_post ORDER BY created_at DESC, id DESC LIMIT 5")
def recent_jobs(d):
    return d.d_job_post.orderBy(F.desc("created_at"), F.desc("id")).limit(5).select("id", "title", "created_at")


@query("jobs_by_company_title", "SELECT j.id, c.name AS company, j.title FROM d_job_post j JOIN d_company c ON c.id = j.company_id ORDER BY company, title, j.id")
def jobs_by_company_title(d):
    named = d.d_job_post.join(d.d_company.selectExpr("id AS company_id", "name AS company"), "company_id")
    return named.orderBy("company", "title", "id").select("id", "company", "title")


@query("page_slice", "SELECT id, title FROM d_job_post ORDER BY id LIMIT 25 OFFSET 50")
def page_slice(d):
    return d.d_job_post.orderBy("id").offset(50).limit(25).select("id", "title")


@query("casefold_sort", "SELECT id, name FROM d_skill_set ORDER BY lower(name), name, id")
def casefold_sort(d):
    return d.d_skill_set.orderBy(F.lower("name"), "name", "id").select("id", "name")


#: Tokens of a search, and the active keywords of skills that it reads.
SEARCH = ["full_time", "steel"]
KEYWORDS = "(SELECT id AS skill_set_id, concat('kw', CAST(id % 50 AS VARCHAR), ' ', market_category, ' steel') AS raw_text FROM d_skill_set WHERE id % 4 = 0)"
ROW = "(contains(lower(concat_ws('|', j.title, c.name, j.location, j.remote_type, j.employment_type, {status})), '{t}'){more})"


def _row(status: str, others: str) -> str:
    """Both tokens on one row of a job, its company and the skills joined to it."""
    parts = [ROW.format(status=status, t=t, more=f" OR {extra}" if extra else "") for t, extra in (("full_time", "contains(lower(j.employment_type), 'full-time')"), ("steel", ""))]
    return " AND ".join(f"({p} OR {others.replace('@', t)})" for p, t in zip(parts, SEARCH, strict=True))


def _jobs(d):
    return d.d_job_post.join(d.d_company.selectExpr("id AS company_id", "name AS company_name"), "company_id")


def _keywords(d):
    return d.d_skill_set.where("id % 4 = 0").selectExpr("id AS skill_set_id", "concat('kw', id % 50, ' ', market_category, ' steel') AS raw_text")


@query("search_jobs", f"""SELECT DISTINCT j.id FROM d_job_post j JOIN d_company c ON c.id = j.company_id LEFT JOIN d_link l ON l.job_post_id = j.id LEFT JOIN d_skill_set s ON s.id = l.skill_set_id
    LEFT JOIN {KEYWORDS} k ON k.skill_set_id = s.id WHERE {_row("j.status", "coalesce(contains(lower(s.name), '@'), false) OR coalesce(contains(lower(k.raw_text), '@'), false)")}""")
def search_jobs(d):
    return Q.search_jobs(_jobs(d), d.d_link, d.d_skill_set, _keywords(d), SEARCH)


@query("search_applications", f"""SELECT DISTINCT a.id FROM d_application a JOIN d_job_post j ON j.id = a.job_post_id JOIN d_company c ON c.id = j.company_id
    LEFT JOIN d_application_skill m ON m.application_id = a.id LEFT JOIN d_skill_set s ON s.id = m.skill_set_id LEFT JOIN {KEYWORDS} k ON k.skill_set_id = s.id
    LEFT JOIN d_link l ON l.job_post_id = j.id LEFT JOIN d_skill_set s2 ON s2.id = l.skill_set_id LEFT JOIN {KEYWORDS} k2 ON k2.skill_set_id = s2.id
    WHERE {_row("a.status", " OR ".join(f"coalesce(contains(lower({x}), '@'), false)" for x in ("s.name", "k.raw_text", "s2.name", "k2.raw_text")))}""")
def search_applications(d):
    rows = d.d_application.selectExpr("id", "job_post_id", "status AS application_status").join(_jobs(d).withColumnRenamed("id", "job_post_id").drop("status"), "job_post_id")
    return Q.search_applications(rows, d.d_application_skill, d.d_link, d.d_skill_set, _keywords(d), SEARCH)


@query("keyword_lookup", f"SELECT k.skill_set_id, k.raw_text, s.name FROM {KEYWORDS} k JOIN d_skill_set s ON s.id = k.skill_set_id")
def keyword_lookup(d):
    """All keywords with their skill, in order of text and skill."""
    named = _keywords(d).join(d.d_skill_set.selectExpr("id AS skill_set_id", "name"), "skill_set_id")
    return named.select("skill_set_id", "raw_text", "name").orderBy(F.lower("raw_text"), "name", "skill_set_id")
