"""Analyses of all applications as resumes: names, skills, jobs, the market, gaps and profiles."""

from pyspark.sql import functions as F

from demandlens.operators import demand as D
from demandlens.operators import resolution as R
from demandlens.operators import resumes as Z
from demandlens.plans.catalog import query
from demandlens.plans.demand_queries import DEMAND, demands
from demandlens.plans.match_queries import CLAMPED, MARKET, market
from demandlens.plans.resolution_queries import ALIAS, INDEX, KEYWORD, QUERIES, SCORED, SKILL, N, _of, skills
from demandlens.plans.skill_queries import star

#: What resumes say: names as they are, in capitals, inside longer ones or unknown; every fifth is rejected.
TYPED = """(SELECT a.application_id AS owner, a.skill_set_id AS ord, CASE a.skill_set_id % 7 WHEN 0 THEN concat('ML for ', s.name) WHEN 1 THEN upper(s.name) WHEN 2 THEN concat('no such thing ', CAST(s.id % 3 AS STRING)) ELSE s.name END AS name,
    a.skill_set_id % 5 = 4 AS bad FROM d_application_skill a JOIN d_skill_set s ON s.id = a.skill_set_id)"""
#: The model's picks for the longer ones: right, unsure, outside the candidates, broken.
PICKS = """(SELECT lower(concat('ML for ', name)) AS id, CASE id % 4 WHEN 0 THEN concat('{"canonical": " ', upper(name), '.", "confidence": 0.9}') WHEN 1 THEN concat('{"canonical": "', name, '", "confidence": "0.5"}')
    WHEN 2 THEN '{"canonical": "Nothing", "confidence": 0.95}' ELSE 'broken' END AS payload FROM d_skill_set WHERE id % 7 = 0)"""
ACTIVE_INDEX = INDEX.replace(SKILL, f"(SELECT * FROM {SKILL} WHERE is_active)")


def mapping(where: str = "true") -> str:
    """SQL tables: m0 (names against the index), res (what candidates give), aug (both)."""
    return f""", m0 AS MATERIALIZED (SELECT owner, n AS normalized, bad, CASE WHEN NOT bad THEN i.skill_id END AS found FROM (SELECT owner, {N('name')} AS n, bad, ord FROM {TYPED} WHERE {where} QUALIFY row_number() OVER (PARTITION BY owner, n ORDER BY bad, ord) = 1) LEFT JOIN {ACTIVE_INDEX} i ON i.normalized = n),
    unknown AS MATERIALIZED (SELECT x.normalized, s.id AS exact, p.id AS meant FROM (SELECT DISTINCT normalized FROM m0 WHERE NOT bad AND found IS NULL) x LEFT JOIN d_skill_set s ON lower(s.name) = x.normalized LEFT JOIN d_skill_set p ON p.id % 7 = 0 AND 'ml for ' || lower(p.name) = x.normalized),
    offers AS MATERIALIZED {SCORED.replace(QUERIES, "(SELECT normalized AS query_id, normalized AS query FROM unknown WHERE exact IS NULL)")},
    judged AS (SELECT *, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN normalized NOT IN (SELECT query_id FROM offers) THEN 'unresolved' WHEN meant IS NULL OR meant % 4 = 3 THEN 'ollama_error' WHEN meant % 4 = 1 THEN 'low_confidence'
      WHEN meant % 4 = 0 AND (normalized, meant) IN (SELECT (query_id, skill_id) FROM offers) THEN 'rag' ELSE 'invalid_canonical' END AS source FROM unknown),
    res AS MATERIALIZED (SELECT normalized, source, CASE source WHEN 'exact' THEN exact WHEN 'rag' THEN meant END AS skill_id, CASE source WHEN 'exact' THEN 1.0 WHEN 'low_confidence' THEN 0.5 WHEN 'rag' THEN 0.9 WHEN 'invalid_canonical' THEN CASE meant % 4 WHEN 2 THEN 0.95 ELSE 0.9 END ELSE 0.0 END::DOUBLE AS confidence FROM judged),
    aug AS MATERIALIZED (SELECT m.owner, m.normalized, coalesce(m.found, CASE WHEN k = 1 AND o.owner IS NULL THEN r.skill_id END) AS skill_id, CASE WHEN bad THEN 'rejected during verification' WHEN found IS NOT NULL THEN 'matched' WHEN r.skill_id IS NULL THEN 'no matching SkillSet'
      WHEN k = 1 AND o.owner IS NULL THEN 'matched' ELSE 'already matched' END AS outcome, CASE WHEN found IS NOT NULL THEN 'index' WHEN r.skill_id IS NOT NULL THEN source END AS source
      FROM (SELECT m0.*, row_number() OVER (PARTITION BY m0.owner, y.skill_id ORDER BY m0.normalized) AS k FROM m0 LEFT JOIN res y ON y.normalized = m0.normalized AND NOT bad AND found IS NULL) m
      LEFT JOIN res r ON r.normalized = m.normalized AND NOT bad AND found IS NULL LEFT JOIN (SELECT DISTINCT owner, found AS id FROM m0 WHERE found IS NOT NULL) o ON o.owner = m.owner AND o.id = r.skill_id)"""


def typed(d):
    d.d_application_skill.createOrReplaceTempView("d_application_skill")
    return _of(d, TYPED)


def mapped(d):
    rows = typed(d)
    index = R.skill_index(skills(d).where("is_active"), _of(d, KEYWORD), _of(d, ALIAS))
    return R.map_skills(rows.where("NOT bad").drop("bad"), rows.where("bad").drop("bad"), index)


def resolved(d, first):
    return Z.resolved_names(first.where(F.col("outcome") == Z.NO_SKILL), skills(d), _of(d, KEYWORD), _of(d, ALIAS), _of(d, PICKS))


@query("resume_names", f"{mapping()} SELECT normalized, skill_id, confidence, source FROM res")
def resume_names(d):
    """Names that no index knows, by a name, or a model's pick among candidates."""
    return resolved(d, mapped(d)).select("normalized", "skill_id", "confidence", "source").distinct()


@query("resume_mapping", f"{mapping()} SELECT owner, normalized, skill_id, outcome, source FROM aug")
def resume_mapping(d):
    first = mapped(d)
    return Z.augmented(first, resolved(d, first)).select("owner", "normalized", "skill_id", "outcome", "source")


MADE = f"(SELECT m0.owner, m0.normalized, coalesce(found, CASE WHEN NOT bad THEN s.id END) AS skill_id, CASE WHEN bad THEN 'rejected during verification' WHEN found IS NULL AND s.id IS NULL THEN 'created' ELSE 'matched' END AS outcome FROM m0 LEFT JOIN (SELECT {N('name')} AS k, min(id) AS id FROM d_skill_set GROUP BY 1) s ON s.k = m0.normalized)"


@query("mapping_auto_create", f"{mapping()} SELECT * FROM {MADE}")
def mapping_auto_create(d):
    return Z.auto_created(mapped(d), skills(d))[0].select("owner", "normalized", "skill_id", "outcome")


@query("created_skills", f"{mapping()} SELECT normalized, CASE WHEN normalized LIKE 'ml for %' THEN 'ML for ' || substr(normalized, 8) ELSE normalized END AS name FROM (SELECT DISTINCT normalized FROM {MADE} WHERE outcome = 'created')")
def created_skills(d):
    new = Z.auto_created(mapped(d), skills(d))[1]
    return new.select("normalized", F.when(F.col("name").startswith("ML for "), F.concat(F.lit("ML for "), F.lower(F.substring("name", 8, 1000)))).otherwise(F.lower("name")).alias("name"))


PERCENT = "CAST(floor((matched * 2000 + required) / (2 * required)) AS DOUBLE) / 10"


def matches(owned: str) -> str:
    return f"""(SELECT owner, job_post_id, matched, required, {PERCENT} AS match_percent, row_number() OVER (PARTITION BY owner ORDER BY {PERCENT} DESC, matched DESC, lower(c.name), lower(j.title), job_post_id) AS rank FROM
    (SELECT owner, job_post_id, count(*) AS matched FROM {owned} JOIN d_link USING (skill_set_id) GROUP BY 1, 2) m JOIN (SELECT job_post_id, count(*) AS required FROM d_link GROUP BY 1) r USING (job_post_id)
    JOIN d_job_post j ON j.id = job_post_id JOIN d_company c ON c.id = j.company_id QUALIFY rank <= 20)"""


def fits(owned: str) -> str:
    """SQL of (owner, fit_percent, matched, skills) by MARKET."""
    best = f"""(SELECT q.id AS skill_set_id, CASE WHEN w.skill_set_id IS NOT NULL THEN 1.0 ELSE coalesce(b.similarity, 0) END AS similarity, coalesce(w.demand, b.demand, 0) AS demand FROM d_skill_set q LEFT JOIN {MARKET} w ON w.skill_set_id = q.id LEFT JOIN
    (SELECT r.id AS query_id, {CLAMPED} AS similarity, y.demand FROM (SELECT * FROM d_skill_embedding WHERE id IN (SELECT skill_set_id FROM {owned}) AND id NOT IN (SELECT skill_set_id FROM {MARKET})) r, d_skill_embedding m JOIN {MARKET} y ON y.skill_set_id = m.id JOIN d_skill_set s ON s.id = m.id
     QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY {CLAMPED} DESC, s.name, m.id) = 1) b ON b.query_id = q.id WHERE q.is_active)"""
    return f"(SELECT owner, round(100 * coalesce(sum(demand * similarity) FILTER (demand > 0) / sum(demand) FILTER (demand > 0), 0), 1) AS fit_percent, count(*) FILTER (similarity >= 0.7) AS matched, count(*) AS skills FROM {owned} JOIN {best} USING (skill_set_id) GROUP BY 1)"


OWNED = "(SELECT application_id AS owner, skill_set_id FROM d_application_skill)"


def owned(d):
    return d.d_application_skill.selectExpr("application_id AS owner", "skill_set_id")


@query("resume_job_matches", f"SELECT * FROM {matches(OWNED)}")
def resume_job_matches(d):
    return Z.job_matches(owned(d), d.d_link, d.d_job_post, d.d_company)


@query("resume_market_fits", f"SELECT * FROM {fits(OWNED)}")
def resume_market_fits(d):
    return Z.market_fits(owned(d), d.d_skill_embedding, d.d_skill_set, market(d))


TOP = f"(SELECT x.skill_set_id, s.name, demand_score, round(demand_score + CASE WHEN trend_type = 'rising' THEN 25 ELSE 0 END, 2) AS priority FROM {DEMAND} x JOIN d_skill_set s ON s.id = x.skill_set_id ORDER BY demand_score DESC, s.name, s.id LIMIT 30)"


@query("resume_gap_skills", f"""SELECT owner, skill_set_id, demand_score, priority, missing_rank, row_number() OVER (PARTITION BY owner ORDER BY priority DESC, lower(name), missing_rank) AS rank FROM (SELECT owner, t.*, row_number() OVER (PARTITION BY owner ORDER BY demand_score DESC, name, skill_set_id) AS missing_rank
    FROM (SELECT DISTINCT owner FROM {OWNED}), {TOP} t WHERE (owner, skill_set_id) NOT IN (SELECT (owner, skill_set_id) FROM {OWNED}) QUALIFY missing_rank <= 15)""")
def resume_gap_skills(d):
    """The skills in most demand that each resume lacks, in order of demand and of priority."""
    return Z.gap_skills(owned(d), demands(d), d.d_skill_set)


@query("resume_gap_categories", f"""SELECT owner, category, job_count, row_number() OVER (PARTITION BY owner ORDER BY job_count DESC, lower(category), category) AS rank FROM (SELECT DISTINCT owner FROM {OWNED}),
    (SELECT business_category AS category, count(DISTINCT job_post_id) AS job_count FROM d_star WHERE is_approved GROUP BY 1 ORDER BY 2 DESC, lower(category), category LIMIT 15)
    WHERE (owner, category) NOT IN (SELECT (owner, s.business_category) FROM {OWNED} JOIN d_skill_set s ON s.id = skill_set_id WHERE s.is_approved)""")
def resume_gap_categories(d):
    return Z.gap_categories(owned(d), _members(d), D.category_counts(star(d), "business_category", True))


def _members(d):
    return d.d_skill_set.where("is_approved").selectExpr("id AS skill_set_id", "business_category AS category")


@query("resume_profiles", f"""SELECT owner, category, n, CAST(share + CASE WHEN first THEN 100 - sum(share) OVER (PARTITION BY owner) ELSE 0 END AS BIGINT) AS percent FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, category) = 1 AS first FROM (SELECT owner, category, n, CAST(round_even(n * 100.0 / sum(n) OVER (PARTITION BY owner), 0) AS BIGINT) AS share FROM
    (SELECT owner, s.business_category AS category, count(*) AS n FROM {OWNED} JOIN d_skill_set s ON s.id = skill_set_id WHERE s.is_approved GROUP BY 1, 2)))""")
def resume_profiles(d):
    return Z.profiles(owned(d), _members(d))


#: Resumes in tens: one without text, one with a broken first answer, one of which nothing is verified.
PER = f"(SELECT owner, sum(length(name) + 1) - 1 AS chars, count(DISTINCT lower(name)) AS candidates, count(DISTINCT lower(name)) FILTER (NOT bad) AS verified FROM {TYPED} GROUP BY 1)"
GOES_ON = f"owner % 10 > 2 AND owner IN (SELECT owner FROM {PER} WHERE verified > 0)"
MINE = "(SELECT DISTINCT owner, skill_id AS skill_set_id FROM aug WHERE skill_id IS NOT NULL)"


@query("resume_steps", f"""{mapping(GOES_ON)}, per AS (SELECT p.*, CASE WHEN p.owner % 10 = 0 THEN 1 WHEN p.owner % 10 = 1 THEN 2 WHEN p.owner % 10 = 2 OR verified = 0 THEN 3 ELSE 7 END AS fails, coalesce(a.n, 0) AS n_mapped, coalesce(j.n, 0) AS n_jobs, coalesce(f.matched, 0) AS n_fit FROM {PER} p
    LEFT JOIN (SELECT owner, count(*) AS n FROM aug WHERE outcome = 'matched' GROUP BY 1) a ON a.owner = p.owner LEFT JOIN (SELECT owner, count(*) AS n FROM {matches(MINE)} GROUP BY 1) j ON j.owner = p.owner LEFT JOIN {fits(MINE)} f ON f.owner = p.owner)
    SELECT owner, step, CASE WHEN k = fails THEN 'failed' ELSE 'success' END AS status, CASE WHEN k < fails THEN n END AS n FROM (SELECT owner, fails, unnest(range(1, 7)) AS k, unnest(['text_extraction', 'ollama_extract', 'ollama_verify', 'skillset_mapping', 'job_match', 'market_fit']) AS step,
      unnest([chars, candidates, verified, n_mapped, n_jobs, n_fit]::BIGINT[]) AS n FROM per) WHERE k <= fails""")
def resume_steps(d):
    """The whole analysis: from a resume's text and a model's answers to jobs and market fit."""
    rows = typed(d)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("ord", "name")))), lambda x: x["name"])
    per = rows.groupBy(F.col("owner").alias("id")).agg(listed(F.lit(True)).alias("every"), listed(~F.col("bad")).alias("good"), listed(F.col("bad")).alias("ill"))
    quoted = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    kind = F.col("id") % 10
    resumes = per.select("id", F.when(kind == 0, F.lit(" \n\t\r\n")).otherwise(F.concat(F.lit("\n "), F.array_join("every", " \r\n\n "))).alias("text"))
    extracted = per.select("id", F.when(kind == 1, "broken").otherwise(F.format_string('{"candidate_skills": [%s]}', quoted("every"))).alias("payload"))
    verified = per.select("id", F.format_string('{"verified_skills": [%s], "rejected_skills": [%s]}', F.when(kind == 2, "").otherwise(quoted("good")), quoted("ill")).alias("payload"))
    done = Z.analyze(resumes, extracted, verified, _of(d, PICKS), skills(d), _of(d, KEYWORD), _of(d, ALIAS), d.d_link, d.d_job_post, d.d_company, d.d_skill_embedding, market(d))
    return done["steps"]
