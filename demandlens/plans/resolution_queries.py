"""Resolution of names, evidence scores, taxonomy imports and checks, over skills with aliases and keywords derived from the domain."""

from pyspark.sql import functions as F

from demandlens.operators import matching as M
from demandlens.operators import resolution as R
from demandlens.operators import taxonomy as X
from demandlens.plans.catalog import query

#: Inputs, in words that Spark and DuckDB share. Lists are texts with bars.
SKILL = """(SELECT id, name, is_active, CASE WHEN id % 3 = 0 THEN concat('Alias ', CAST(id % 40 AS STRING), '|', upper(name), ' XX| ') ELSE '' END AS alias_text,
    CASE WHEN id % 2 = 0 THEN concat('uri:', CAST(id AS STRING)) END AS esco_uri, CASE WHEN id % 7 = 0 THEN 'about it' ELSE '' END AS description FROM d_skill_set)"""
KEYWORD = "(SELECT id AS skill_set_id, concat('kw', CAST(id % 50 AS STRING), ' steel ') AS raw_text FROM d_skill_set WHERE id % 4 = 0)"
ALIAS = """(SELECT concat('Nick ', CAST(id % 60 AS STRING)) AS alias, id AS skill_id FROM d_skill_set WHERE id % 5 = 0
    UNION ALL SELECT concat(CASE WHEN id % 2 = 0 THEN upper(name) ELSE name END, '.') AS alias, id - 1 AS skill_id FROM d_skill_set WHERE id % 11 = 0 AND id > 1 UNION ALL SELECT ' . ' AS alias, 1 AS skill_id)"""
NAMES = """(SELECT id AS row_id, CASE id % 6 WHEN 0 THEN concat('  ', upper(name), ' ,') WHEN 1 THEN concat('nick ', CAST(id % 60 AS STRING)) WHEN 2 THEN replace(replace(name, 'a', 'o'), 'ee', 'e') WHEN 3 THEN ' ,; '
    WHEN 4 THEN concat('no such thing ', CAST(id AS STRING)) END AS name FROM d_skill_set)"""
QUERIES = "(SELECT id AS query_id, CASE WHEN id % 100 = 0 THEN concat('ML for ', name) WHEN id % 150 = 0 THEN 'steel' ELSE concat(substr(name, 1, 9), ' and etl tools') END AS query FROM d_skill_set WHERE id % 50 = 0)"


def N(x: str) -> str:
    return rf"lower(trim(trim(regexp_replace({x}, '\s+', ' ', 'g')), '.,;:|/\'))"


def C(x: str) -> str:
    return rf"trim(trim(regexp_replace({x}, '\s+', ' ', 'g')), ' .,;:|/\')"


def words(x: str) -> str:
    return f"""list_distinct(list_filter(string_split_regex({x}, '[^a-z0-9+#.]+'), lambda t: length(t) > 1 AND NOT regexp_full_match(t, 'a|an|and|for|in|of|or|the|to|with|skills?|tools?|technology|technologies|engineering|engineer|implementations?|solutions?')))"""


ALIASES = f"(SELECT id, name, unnest(string_split(alias_text, '|')) AS a FROM {SKILL})"
TERMS = f"""(SELECT * FROM (SELECT {N('name')} AS t, id AS skill_id, 'normalized_name' AS kind, 1 AS rank FROM {SKILL} UNION ALL SELECT {N('raw_text')}, skill_set_id, 'keyword', 2 FROM {KEYWORD}
    UNION ALL SELECT {N('a')}, id, 'alias', 3 FROM {ALIASES} UNION ALL SELECT {N('alias')}, skill_id, 'skill_alias', 4 FROM {ALIAS}) WHERE t <> '')"""
INDEX = f"(SELECT t AS normalized, skill_id, kind FROM {TERMS} QUALIFY row_number() OVER (PARTITION BY t ORDER BY rank, skill_id) = 1)"
STAGED = f"""(SELECT row_id, {N(C('n.name'))} AS normalized, CASE WHEN coalesce({C('n.name')}, '') = '' THEN 'empty' WHEN a.skill_id IS NOT NULL THEN 'alias' WHEN s.id IS NOT NULL THEN 'exact' END AS source,
    CASE WHEN coalesce({C('n.name')}, '') <> '' THEN coalesce(a.skill_id, s.id) END AS skill_id FROM {NAMES} n LEFT JOIN (SELECT lower(alias) AS k, min(skill_id) AS skill_id FROM {ALIAS} GROUP BY 1) a ON a.k = lower({C('n.name')})
    LEFT JOIN (SELECT {N('name')} AS k, min(id) AS id FROM {SKILL} GROUP BY 1) s ON s.k = {N(C('n.name'))})"""
RATIO = "round((1 - levenshtein(f.normalized, s.k) / greatest(length(f.normalized), length(s.k))) * 100, 4)"
FUZZY = f"""(SELECT f.normalized, s.id AS skill_id, {RATIO} AS score FROM (SELECT DISTINCT normalized FROM {STAGED} WHERE source IS NULL AND normalized <> '') f
    JOIN (SELECT {N('name')} AS k, min(id) AS id FROM {SKILL} GROUP BY 1) s ON {RATIO} >= 90 QUALIFY row_number() OVER (PARTITION BY f.normalized ORDER BY {RATIO} DESC, s.k) = 1)"""


def _of(d, sql: str):
    for name in ("d_skill_set", "d_link"):
        getattr(d, name).createOrReplaceTempView(name)
    return d._spark.sql(f"SELECT * FROM {sql}")


def skills(d):
    return _of(d, SKILL).withColumn("aliases", F.filter(F.split("alias_text", r"\|"), lambda x: F.trim(x) != "")).drop("alias_text")


@query("skill_index", f"SELECT * FROM {INDEX}")
def skill_index(d):
    return R.skill_index(skills(d), _of(d, KEYWORD), _of(d, ALIAS))


@query("alias_resolve", f"SELECT row_id, skill_id, source FROM {STAGED}")
def alias_resolve(d):
    return R.alias_resolve(_of(d, NAMES), skills(d), _of(d, ALIAS)).select("row_id", "skill_id", "source")


@query("fuzzy_levenshtein", f"SELECT normalized, skill_id, score FROM {FUZZY}")
def fuzzy_levenshtein(d):
    return R.fuzzy_matches(R.alias_resolve(_of(d, NAMES), skills(d), _of(d, ALIAS)).where("source IS NULL"), skills(d))


#: Names in other orders, with words more, fewer or twice, misspelt, or inside longer texts.
VARIANTS = """(SELECT id AS row_id, CASE id % 9 WHEN 0 THEN concat(split_part(name, ' ', 3), ' ', split_part(name, ' ', 1), ' ', split_part(name, ' ', 2)) WHEN 1 THEN concat(name, ' ', split_part(name, ' ', 1))
    WHEN 2 THEN concat(substr(name, 1, 3), 'x', substr(name, 4)) WHEN 3 THEN concat('Senior ', name, ' specialist in teams') WHEN 4 THEN concat(name, ' pro') WHEN 5 THEN concat(split_part(name, ' ', 1), ' ', split_part(name, ' ', 2))
    WHEN 6 THEN concat(split_part(name, ' ', 2), 's ', split_part(name, ' ', 1), ' ', split_part(name, ' ', 3)) WHEN 7 THEN concat('completely different ', CAST(id AS STRING)) ELSE replace(name, 'a', 'o') END AS name FROM d_skill_set)"""


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of texts of up to 120 characters, a bit of a HUGEINT for each character of ``a``."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END))::HUGEINT)"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def indel_share(a: str, b: str, lengths: str, least: float) -> str:
    """100 less the share of insertions and deletions, 0 where more substitutions would be needed than the least share leaves."""
    return f"CASE WHEN levenshtein({a}, {b}) <= {1 - least / 100} * ({lengths}) + 1e-9 THEN 100 - 100.0::DOUBLE * (length({a}) + length({b}) - 2 * {lcs(a, b)}) / ({lengths}) ELSE 0 END"


def weighted(names: str, least: float = 90) -> str:
    """SQL of the best skill of each name (normalized) by the weighted ratio, all pairs compared."""
    listed = lambda c: f"list_sort(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
    token = least / 0.95
    return f"""(WITH a AS (SELECT DISTINCT normalized AS x, {listed('normalized')} AS xw, list_distinct(xw) AS xs, array_to_string(xw, ' ') AS xo FROM {names} WHERE normalized <> ''),
    b AS (SELECT k AS y, id, {listed('k')} AS yw, list_distinct(yw) AS ys, array_to_string(yw, ' ') AS yo FROM (SELECT {N('name')} AS k, min(id) AS id FROM {SKILL} GROUP BY 1)),
    p AS (SELECT *, greatest(length(x), length(y)) < 1.5 * least(length(x), length(y)) AS alike, list_has_any(xs, ys) AS meets FROM a, b WHERE levenshtein(x, y) <= {1 - least / 100} * (length(x) + length(y)) OR contains(x, y) OR contains(y, x)
        OR (alike AND (meets OR levenshtein(xo, yo) <= {1 - token / 100} * (length(x) + length(y))))),
    q AS (SELECT *, array_to_string(list_sort(list_filter(xs, lambda w: NOT list_contains(ys, w))), ' ') AS xd, array_to_string(list_sort(list_filter(ys, lambda w: NOT list_contains(xs, w))), ' ') AS yd,
        length(array_to_string(list_intersect(xs, ys), ' ')) AS n, CASE WHEN n > 0 THEN 1 ELSE 0 END AS g FROM p),
    r AS (SELECT x AS normalized, y, id, {indel_share('x', 'y', 'length(x) + length(y)', least)} AS plain,
        CASE WHEN NOT alike THEN 0 WHEN n > 0 AND (xd = '' OR yd = '') THEN 95 ELSE 0.95::DOUBLE * greatest({indel_share('xo', 'yo', 'length(xo) + length(yo)', token)}, {indel_share('xd', 'yd', '2 * (n + g) + length(xd) + length(yd)', token)},
          CASE WHEN n > 0 THEN greatest(100 - 100.0::DOUBLE * (1 + length(xd)) / (2 * n + 1 + length(xd)), 100 - 100.0::DOUBLE * (1 + length(yd)) / (2 * n + 1 + length(yd))) ELSE 0 END) END AS words,
        CASE WHEN NOT alike AND greatest(length(x), length(y)) <= 8 * least(length(x), length(y)) AND (contains(x, y) OR contains(y, x)) THEN 90 ELSE 0 END AS window_score FROM q)
    SELECT normalized, id AS skill_id, round(greatest(plain, words, window_score), 4) AS score FROM r WHERE greatest(plain, words, window_score) >= {least} - 1e-9
    QUALIFY row_number() OVER (PARTITION BY normalized ORDER BY round(greatest(plain, words, window_score), 6) DESC, y) = 1)"""


@query("fuzzy_weighted", f"SELECT * FROM {weighted(f'(SELECT {N(C("name"))} AS normalized FROM {VARIANTS})')}")
def fuzzy_weighted(d):
    return R.weighted_matches(_of(d, VARIANTS).select(R.T.normalize_name(R.T.clean_keyword(F.col("name"))).alias("normalized")), skills(d))


UNKNOWN = f"(SELECT normalized FROM {STAGED} WHERE source IS NULL)"
LADDER = f"""(SELECT row_id, coalesce(x.skill_id, f.skill_id) AS skill_id, CASE WHEN source IN ('alias', 'exact') THEN 1.0 WHEN f.score IS NOT NULL THEN round(f.score / 100, 4) ELSE 0.0 END::DOUBLE AS confidence,
    coalesce(source, CASE WHEN f.score IS NOT NULL THEN 'fuzzy' END, 'unmapped') AS source FROM {STAGED} x LEFT JOIN {weighted(UNKNOWN)} f ON f.normalized = x.normalized AND x.source IS NULL)"""


@query("resolve_ladder", f"SELECT * FROM {LADDER}")
def resolve_ladder(d):
    return R.resolve(_of(d, NAMES), skills(d), _of(d, ALIAS)).select("row_id", "skill_id", "confidence", "source")


@query("ladder_histogram", f"SELECT source, count(*) AS n FROM {LADDER} GROUP BY 1")
def ladder_histogram(d):
    return R.resolve(_of(d, NAMES), skills(d), _of(d, ALIAS)).groupBy("source").agg(F.count("*").alias("n"))


ACTIVE_TERMS = f"(SELECT t.* FROM {TERMS} t JOIN {SKILL} s ON s.id = t.skill_id WHERE is_active AND rank < 4)"
ASKED = f"""(SELECT query_id, {N('query')} AS q, list_distinct(flatten(list_transform({words(N('query'))}, lambda t: CASE t WHEN 'ml' THEN ['ml', 'machine', 'learning'] WHEN 'etl' THEN ['etl', 'extract', 'transform', 'load', 'data'] ELSE [t] END))) AS tokens FROM {QUERIES})"""
POINTS = f"""(SELECT query_id, skill_id, sum(CASE WHEN contains(q, t) OR contains(t, q) THEN CASE WHEN rank = 1 THEN 8 ELSE 6 END ELSE 0 END + len(list_intersect(tokens, w)) * CASE WHEN rank = 1 THEN 4 ELSE 3 END
    + CASE WHEN rank = 1 AND len(w) > 0 AND len(list_intersect(tokens, w)) = len(w) THEN 2 ELSE 0 END) AS score FROM {ASKED}, (SELECT DISTINCT skill_id, t, rank = 1 AS own, min(rank) AS rank, {words('t')} AS w FROM {ACTIVE_TERMS} GROUP BY 1, 2, 3, 5) GROUP BY 1, 2 HAVING score > 0)"""
SCORED = f"""(SELECT query_id, skill_id, score, least(0.79, round(score / 20, 4)) AS confidence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(name), skill_id) AS rank FROM {POINTS} JOIN {SKILL} s ON s.id = skill_id QUALIFY rank <= 10)"""


def candidates(d):
    return R.catalog_candidates(_of(d, QUERIES), skills(d), _of(d, KEYWORD))


@query("catalog_score", f"SELECT query_id, skill_id, CAST(score AS BIGINT) AS score, CAST(confidence AS DOUBLE) AS confidence, rank FROM {SCORED}")
def catalog_score(d):
    return candidates(d).select("query_id", "skill_id", F.col("score").cast("long").alias("score"), F.col("confidence").cast("double").alias("confidence"), "rank")


@query("rag_candidates", f"""SELECT query_id, skill_id, normalized, source, row_number() OVER (PARTITION BY query_id ORDER BY k, rank, skill_id) AS rank FROM (SELECT *, CASE k WHEN 0 THEN 'vector' ELSE 'catalog' END AS source FROM
    (SELECT query_id, m.id AS skill_id, {N('s.name')} AS normalized, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(m.embedding::DOUBLE[], r.embedding::DOUBLE[]) DESC, s.name, m.id) AS rank, 0 AS k FROM {QUERIES} JOIN d_skill_embedding r ON r.id = query_id JOIN d_skill_embedding m ON m.id <> r.id JOIN {SKILL} s ON s.id = m.id QUALIFY rank <= 3
      UNION ALL SELECT query_id, skill_id, {N('name')}, rank, 1 FROM {SCORED} JOIN {SKILL} s ON s.id = skill_id) QUALIFY row_number() OVER (PARTITION BY query_id, normalized ORDER BY k, rank, skill_id) = 1)""")
def rag_candidates(d):
    """The three skills nearest to each query's vector, then those of like words."""
    named = skills(d).select("id", "name")
    names = named.select(F.col("id").alias("skill_id"), R.T.normalize_name(F.col("name")).alias("normalized"))
    asked = _of(d, QUERIES).select("query_id").join(d.d_skill_embedding.selectExpr("id AS query_id", "embedding AS query"), "query_id")
    vector = M.top_k(d.d_skill_embedding.join(named, "id"), asked, 3).select("query_id", F.col("id").alias("skill_id"), F.col("rank").cast("long").alias("rank")).join(names, "skill_id")
    return R.merged_candidates(vector, candidates(d).join(names, "skill_id"))


@query("map_skills", f"""SELECT owner, normalized, name, CASE WHEN NOT bad THEN i.skill_id END AS skill_id, CASE WHEN bad THEN 'rejected during verification' WHEN i.skill_id IS NULL THEN 'no matching SkillSet' ELSE 'matched' END AS outcome FROM
    (SELECT row_id // 20 AS owner, {N('name')} AS n, name, row_id % 4 = 1 AS bad, row_id FROM {NAMES} WHERE name IS NOT NULL AND (row_id % 4 = 1 OR {N('name')} <> '') QUALIFY row_number() OVER (PARTITION BY owner, n ORDER BY bad, row_id) = 1) x(owner, normalized, name, bad, row_id)
    LEFT JOIN {INDEX} i USING (normalized)""")
def map_skills(d):
    rows = _of(d, NAMES).where("name IS NOT NULL").selectExpr("row_id DIV 20 AS owner", "row_id AS ord", "name")
    return R.map_skills(rows.where("ord % 4 <> 1"), rows.where("ord % 4 = 1"), skill_index(d))


JOBS = """(SELECT id, CASE WHEN id % 2 = 0 THEN concat('Senior Go  Developer ', title) ELSE title END AS title, CASE WHEN id % 3 = 0 THEN 'We use GO and go.' ELSE '' END AS description, CASE WHEN id % 5 = 0 THEN 'golang, rust' END AS normalized_text,
    CASE id % 4 WHEN 0 THEN 'Minimum  Qualifications' WHEN 1 THEN 'About' WHEN 2 THEN 'PREFERRED' END AS label, CASE WHEN id % 7 < 4 THEN 'needs Golang daily' ELSE 'needs care' END AS fragment, id % 6 = 0 AS verified, CASE WHEN id % 12 = 0 THEN ' strong   evidence ' ELSE '' END AS verified_reason, id % 10 = 0 AS created FROM d_job_post)"""
HIT = "(contains({0}, 'go') OR contains({0}, 'golang'))"
LOW = r"lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')))"
ALL = "concat_ws(' ', title, description, coalesce(normalized_text, ''), fragment)"


@query("skill_score", f"""SELECT id, CAST(least(100, CASE WHEN a THEN 30 ELSE 0 END + CASE WHEN b THEN 25 ELSE 0 END + CASE WHEN c THEN 20 ELSE 0 END + CASE WHEN e THEN 15 ELSE 0 END + CASE WHEN verified THEN 20 ELSE 0 END + CASE WHEN created THEN 5 ELSE 10 END
    + CASE WHEN n > 1 THEN least(10, 2 * (n - 1)) ELSE 0 END) AS INT) AS score, concat_ws('; ', CASE WHEN a THEN 'title match' END, CASE WHEN b THEN 'requirements match' END, CASE WHEN c THEN 'description match' END, CASE WHEN e THEN 'normalized text match' END,
    CASE WHEN verified THEN CASE WHEN trim(verified_reason) <> '' THEN 'verification support: strong evidence' ELSE 'verification support' END END, CASE WHEN created THEN 'auto-created SkillSet' ELSE 'canonical SkillSet match' END, CASE WHEN n > 1 THEN 'repeated evidence' END) AS reasons
    FROM (SELECT *, {HIT.format(LOW.format('title'))} AS a, {HIT.format(LOW.format('fragment'))} AND (label IS NULL OR label <> 'About') AS b, {HIT.format(LOW.format('description'))} AS c, {HIT.format(LOW.format('normalized_text'))} AS e,
    len(regexp_extract_all({LOW.format(ALL)}, 'go')) + len(regexp_extract_all({LOW.format(ALL)}, 'golang')) AS n FROM {JOBS})""")
def skill_score(d):
    d.d_job_post.createOrReplaceTempView("d_job_post")
    rows = d._spark.sql(f"SELECT * FROM {JOBS}").withColumns({"terms": F.array(*map(F.lit, (" Go,", "golang", "GO", ""))), "fragments": F.array(F.struct("label", F.col("fragment").alias("text")))})
    return R.evidence_score(rows).select("id", "score", F.array_join("reasons", "; ").alias("reasons"))


#: A row of each link: some texts name the skill, one of its keywords or aliases, once or twice.
EVIDENCE = """(SELECT l.id, job_post_id, skill_set_id, concat(' ', s.name, ',') AS name, CASE WHEN l.score % 3 = 0 THEN concat('Lead ', upper(s.name)) ELSE j.title END AS title, CASE WHEN l.score % 4 = 0 THEN concat('Work with ', s.name, ' and KW', CAST(s.id % 50 AS STRING), '  steel') ELSE '' END AS description,
    CASE WHEN l.score % 5 = 0 THEN concat('alias ', CAST(s.id % 40 AS STRING)) END AS normalized_text, CASE l.job_post_id % 3 WHEN 0 THEN 'Minimum' WHEN 1 THEN 'About' END AS label, CASE WHEN l.score % 7 = 0 THEN s.name ELSE 'care' END AS fragment, l.score % 2 = 0 AS verified, '' AS verified_reason, s.id % 9 = 0 AS created
    FROM d_link l JOIN d_skill_set s ON s.id = l.skill_set_id JOIN d_job_post j ON j.id = l.job_post_id)"""
TERMS_OF = f"""(SELECT id AS sid, name AS skill_name, list_distinct(list_filter(list_concat([{N('name')}], CASE WHEN id % 4 = 0 THEN ['kw' || id % 50 || ' steel'] ELSE []::VARCHAR[] END, list_transform(string_split(alias_text, '|'), lambda a: {N('a')})), lambda t: t <> '')) AS terms FROM {SKILL})"""
MET = lambda c: f"len(list_filter(terms, lambda t: contains({LOW.format(c)}, t))) > 0"


@query("link_scores", f"""SELECT id, CAST(score AS INT) AS score, row_number() OVER (PARTITION BY job_post_id ORDER BY score DESC, lower(skill_name), skill_set_id) AS rank FROM (SELECT *, least(100, CASE WHEN a THEN 30 ELSE 0 END + CASE WHEN b THEN 25 ELSE 0 END + CASE WHEN c THEN 20 ELSE 0 END + CASE WHEN e THEN 15 ELSE 0 END
    + CASE WHEN verified THEN 20 ELSE 0 END + CASE WHEN created THEN 5 ELSE 10 END + CASE WHEN n > 1 THEN least(10, 2 * (n - 1)) ELSE 0 END) AS score FROM (SELECT *, {MET('title')} AS a, {MET('fragment')} AND (label IS NULL OR label <> 'About') AS b, {MET('description')} AS c, {MET('normalized_text')} AS e,
    list_sum(list_transform(terms, lambda t: (length({LOW.format(ALL)}) - length(replace({LOW.format(ALL)}, t, ''))) // length(t))) AS n FROM {EVIDENCE} JOIN {TERMS_OF} ON sid = skill_set_id))""")
def link_scores(d):
    keywords = _of(d, KEYWORD)
    d.d_job_post.createOrReplaceTempView("d_job_post")
    rows = d._spark.sql(f"SELECT * FROM {EVIDENCE}").withColumn("fragments", F.array(F.struct("label", F.col("fragment").alias("text"))))
    return R.score_links(rows, skills(d), keywords).select("id", "score", "rank")


@query("embedding_text", f"""SELECT id, concat_ws('. ', name, CASE WHEN description <> '' THEN description END, CASE WHEN alias_text <> '' THEN array_to_string(list_filter(string_split(alias_text, '|'), lambda x: trim(x) <> ''), '. ') END,
    CASE WHEN id % 4 = 0 THEN 'kw' || id % 50 || ' steel ' END) AS text FROM {SKILL}""")
def embedding_text(d):
    return R.embedding_text(skills(d), _of(d, KEYWORD))


#: A taxonomy's rows: known by uri, by name only, new ones, groups and blanks; the order is the id.
ROWS = """(SELECT id AS ord, CASE id % 4 WHEN 0 THEN concat('uri:', CAST(id AS STRING)) WHEN 1 THEN concat('new:', CAST(id AS STRING)) ELSE '' END AS concept_uri, CASE WHEN id % 9 = 0 THEN '  ' WHEN id % 5 = 3 THEN concat('Fresh   skill ', CAST(id % 30 AS STRING)) ELSE concat(upper(name), ' ') END AS preferred_label,
    CASE WHEN id % 10 = 7 THEN 'Skill Group' ELSE 'KnowledgeSkill' END AS concept_type, CASE WHEN id % 3 = 0 THEN concat('text ', CAST(id AS STRING)) ELSE ' ' END AS description, CASE WHEN id % 2 = 0 THEN concat('Nick ', CAST(id % 90 AS STRING), '|', lower(name), '; N', CAST(id % 13 AS STRING)) ELSE '' END AS alt_labels FROM d_skill_set)"""
LABELLED = r"(SELECT *, rtrim(substr(trim(regexp_replace(preferred_label, '\s+', ' ', 'g')), 1, 120)) AS label FROM " + ROWS + " WHERE trim(preferred_label) <> '')"
MEANT = f"(SELECT r.*, coalesce(u.id, n.id) AS skill, {N('r.label')} AS norm FROM {LABELLED} r LEFT JOIN {SKILL} u ON u.esco_uri = r.concept_uri LEFT JOIN (SELECT {N('name')} AS k, min(id) AS id FROM {SKILL} GROUP BY 1) n ON n.k = {N('r.label')})"


@query("esco_skill_merge", f"""SELECT s.id, coalesce(s.name, label) AS name, coalesce(uri, esco_uri) AS esco_uri, coalesce(about, description, '') AS description,
    CASE WHEN s.id IS NULL THEN 'insert' WHEN k IS NULL OR (coalesce(uri, esco_uri) IS NOT DISTINCT FROM esco_uri AND coalesce(about, description) = description) THEN 'keep' ELSE 'update' END AS action FROM {SKILL} s FULL JOIN
    (SELECT coalesce(CAST(skill AS VARCHAR), norm) AS k, max(skill) AS skill, arg_min(label, ord) AS label, arg_max(nullif(concept_uri, ''), ord) AS uri, arg_max(nullif(trim(description), ''), ord) AS about FROM {MEANT} WHERE concept_type NOT LIKE '%Group%' GROUP BY 1) x ON x.skill = s.id""")
def esco_skill_merge(d):
    return X.skill_import(skills(d), _of(d, ROWS))


@query("esco_alias_merge", f"""SELECT coalesce(e.alias, x.label) AS alias, coalesce(x.skill, e.skill_id) AS skill_id, CASE WHEN e.alias IS NULL THEN 'insert' WHEN x.skill IS NULL OR x.skill = e.skill_id THEN 'keep' ELSE 'update' END AS action FROM
    (SELECT DISTINCT ON (lower(alias)) alias, skill_id FROM {ALIAS} ORDER BY lower(alias), skill_id) e FULL JOIN (SELECT lower(l) AS k, arg_max(skill, (ord, pos)) AS skill, arg_min(l, (ord, pos)) AS label FROM
    (SELECT ord, skill, own, trim(unnest(labels)) AS l, unnest(range(1, len(labels) + 1)) AS pos FROM (SELECT m.ord, m.skill, {N('s.name')} AS own, string_split_regex(m.alt_labels, '[|;]') AS labels FROM {MEANT} m JOIN {SKILL} s ON s.id = m.skill) y) z
    WHERE l <> '' AND {N('l')} <> own GROUP BY 1) x ON x.k = lower(e.alias)""")
def esco_alias_merge(d):
    first = _of(d, ALIAS).groupBy(F.lower("alias").alias("k")).agg(F.min(F.struct("skill_id", "alias")).alias("x")).select("x.alias", "x.skill_id")
    return X.alias_import(skills(d), first, _of(d, ROWS))


#: Concepts are skills or categories; edges of both kinds, some to nothing.
CATEGORY = "(SELECT id AS id, concat('cat:', CAST(id AS STRING)) AS esco_uri FROM d_category)"
EDGES = """(SELECT id AS ord, CASE WHEN id % 3 = 0 THEN concat('uri:', CAST(id AS STRING)) ELSE concat('cat:', CAST(100 + id % 25 AS STRING)) END AS concept_uri, concat('cat:', CAST(id % 7 AS STRING)) AS broader_uri FROM d_skill_set)"""
PAIRS = """(SELECT concat('uri:', CAST(id AS STRING)) AS source_uri, concat('uri:', CAST(id * 3 % 100 AS STRING)) AS target_uri, CASE id % 5 WHEN 0 THEN 'Broader than' WHEN 1 THEN 'narrower' WHEN 2 THEN NULL ELSE 'see' END AS relation_type FROM d_skill_set)"""


def _categories(d):
    d.d_category.createOrReplaceTempView("d_category")
    return d._spark.sql(f"SELECT * FROM {CATEGORY}")


@query("esco_taxonomy", f"""SELECT 'link' AS kind, s.id AS narrower, c.id AS broader FROM {EDGES} e JOIN {SKILL} s ON s.esco_uri = e.concept_uri JOIN {CATEGORY} c ON c.esco_uri = e.broader_uri
    UNION SELECT 'parent', n.id, arg_max(c.id, ord) FROM {EDGES} e JOIN {CATEGORY} n ON n.esco_uri = e.concept_uri JOIN {CATEGORY} c ON c.esco_uri = e.broader_uri GROUP BY n.id""")
def esco_taxonomy(d):
    links, parents = X.taxonomy_links(_of(d, EDGES), skills(d), _categories(d))
    return links.selectExpr("'link' AS kind", "skill_id AS narrower", "category_id AS broader").unionByName(parents.selectExpr("'parent' AS kind", "category_id AS narrower", "parent_id AS broader"))


JOINED = f"(SELECT s.id AS a, t.id AS b, p.relation_type AS r FROM {PAIRS} p JOIN {SKILL} s ON s.esco_uri = p.source_uri JOIN {SKILL} t ON t.esco_uri = p.target_uri WHERE s.id <> t.id)"


@query("esco_relationships", f"""SELECT * FROM (SELECT a AS source_id, b AS target_id, CASE r WHEN 'Broader than' THEN 'broader' WHEN 'narrower' THEN 'narrower' ELSE 'related' END AS kind FROM {JOINED}
    UNION SELECT a, b, 'narrower' FROM {JOINED} WHERE a % 4 = 0 UNION SELECT b, a, 'broader' FROM {JOINED} WHERE a % 4 = 0) x WHERE NOT (source_id % 8 = 0 AND kind = 'broader')""")
def esco_relationships(d):
    pairs = _of(d, PAIRS)
    broader = pairs.selectExpr("source_uri AS concept_uri", "target_uri AS broader_uri").where("CAST(substring(source_uri, 5) AS INT) % 4 = 0")
    ends = pairs.selectExpr("CAST(substring(source_uri, 5) AS LONG) AS a", "CAST(substring(target_uri, 5) AS LONG) AS b")
    known = ends.selectExpr("a AS source_id", "b AS target_id").unionByName(ends.selectExpr("b AS source_id", "a AS target_id")).where("source_id % 8 = 0").distinct()
    return X.relationship_import(pairs, broader, skills(d), known.withColumn("kind", F.lit("broader")))


@query("duplicate_aliases", f"SELECT normalized, string_agg(alias, ', ' ORDER BY alias) AS texts FROM (SELECT DISTINCT {N('alias')} AS normalized, alias FROM {ALIAS} UNION SELECT {N('alias')}, upper(alias) FROM {ALIAS} WHERE skill_id % 3 = 0) GROUP BY 1 HAVING count(*) > 1")
def duplicate_aliases(d):
    rows = _of(d, ALIAS)
    return X.duplicate_aliases(rows.unionByName(rows.where("skill_id % 3 = 0").withColumn("alias", F.upper("alias"))))


@query("duplicate_canonical", f"SELECT t AS normalized, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT DISTINCT t, s.name FROM {TERMS} x JOIN {SKILL} s ON s.id = x.skill_id WHERE kind <> 'keyword') GROUP BY 1 HAVING count(*) > 1")
def duplicate_canonical(d):
    return X.duplicate_canonical(skills(d), _of(d, ALIAS))


@query("unresolved_aliases", f"""SELECT a.alias, a.skill_id, CASE WHEN {N('a.alias')} <> '' THEN c.name END AS canonical FROM {ALIAS} a JOIN {SKILL} s ON s.id = a.skill_id LEFT JOIN {SKILL} c ON {N('c.name')} = {N('a.alias')}
    WHERE {N('a.alias')} = '' OR (c.id IS NOT NULL AND c.id <> s.id)""")
def unresolved_aliases(d):
    return X.unresolved_aliases(skills(d), _of(d, ALIAS))


@query("orphan_relationships", """SELECT e.source_id, e.target_id, e.kind FROM (SELECT id AS source_id, id * 7 % 400 AS target_id, 'related' AS kind FROM d_skill_set) e LEFT JOIN d_skill_set a ON a.id = source_id LEFT JOIN d_skill_set b ON b.id = target_id
    WHERE NOT coalesce(a.is_active, false) OR NOT coalesce(b.is_active, false)""")
def orphan_relationships(d):
    return X.orphan_relationships(d.d_skill_set.selectExpr("id AS source_id", "id * 7 % 400 AS target_id", "'related' AS kind"), d.d_skill_set)


PATTERNS = [("Metals", 0, " Steel "), ("Metals", 1, "lace"), ("Metals", 2, "chartreuse"), ("Plants", 0, "alias 1"), ("Plants", 1, ""), ("Plants", 2, "rose")]
VALUES = ", ".join(f"('{c}', {k}, '{p}')" for c, k, p in PATTERNS)
SEARCHABLE = f"lower(concat_ws(' ', name, {N('name')}, array_to_string(list_filter(string_split(alias_text, '|'), lambda x: trim(x) <> ''), ' ')))"
HELD = f"(SELECT v.c AS category, s.id AS skill_id, v.k AS ord, lower(trim(v.p)) AS pattern, CASE WHEN length(trim(v.p)) >= 8 THEN 0.85 ELSE 0.7 END AS confidence FROM {SKILL} s JOIN (VALUES {VALUES}) v(c, k, p) ON trim(v.p) <> '' AND contains({SEARCHABLE}, lower(trim(v.p))))"
SUGGESTED = f"""(SELECT category, skill_id, CAST(confidence AS DOUBLE) AS confidence, reason FROM (SELECT 'Plants' AS category, id AS skill_id, -1 AS ord, 0.95 AS confidence, 'exact skill match: ' || name AS reason FROM {SKILL} WHERE id % 30 = 0
    UNION ALL SELECT category, skill_id, ord, confidence, 'pattern match: ' || pattern FROM {HELD}) QUALIFY row_number() OVER (PARTITION BY category, skill_id ORDER BY ord) = 1)"""


def seeds(d):
    patterns = d._spark.createDataFrame(PATTERNS, "category string, ord int, pattern string")
    names = skills(d).where("id % 30 = 0").select(F.lit("Plants").alias("category"), F.upper("name").alias("name"))
    return names, patterns


@query("taxonomy_patterns", f"SELECT category, skill_id, pattern, CAST(confidence AS DOUBLE) AS confidence FROM {HELD}")
def taxonomy_patterns(d):
    return X.pattern_matches(skills(d), seeds(d)[1]).select("category", "skill_id", "pattern", "confidence")


@query("taxonomy_suggest", f"SELECT * FROM {SUGGESTED} WHERE skill_id % 4 <> 1")
def taxonomy_suggest(d):
    assigned = skills(d).where("id % 4 = 1").select(F.explode(F.array(F.lit("Plants"), F.lit("Metals"))).alias("category"), F.col("id").alias("skill_id"))
    return X.suggestions(skills(d), *seeds(d), assigned)


LINKS = "(SELECT 'Plants' AS category, id AS skill_id, CAST(0.5 AS DOUBLE) AS confidence, CASE WHEN id % 4 = 0 THEN 'MANUAL' ELSE 'AI' END AS source, false AS is_approved FROM d_skill_set WHERE id % 2 = 0)"


@query("taxonomy_assign", f"""SELECT coalesce(e.category, m.category) AS category, coalesce(e.skill_id, m.skill_id) AS skill_id, CASE WHEN m.skill_id IS NOT NULL THEN 0.9 ELSE e.confidence END AS confidence,
    CASE WHEN m.skill_id IS NOT NULL AND e.source IS DISTINCT FROM 'MANUAL' THEN 'SEED' ELSE e.source END AS source, m.skill_id IS NOT NULL AS is_approved FROM {LINKS} e FULL JOIN {SUGGESTED} m ON m.category = e.category AND m.skill_id = e.skill_id""")
def taxonomy_assign(d):
    return X.assign(skills(d), *seeds(d), _of(d, LINKS))


NEWS = """(SELECT id AS ord, CASE id % 4 WHEN 0 THEN concat('  ', lower(name), ' ') WHEN 1 THEN name WHEN 2 THEN concat('Newco ', CAST(id % 20 AS STRING)) ELSE ' ' END AS name, CASE WHEN id % 3 = 0 THEN concat('https://c', CAST(id AS STRING)) ELSE '' END AS website FROM d_company)"""


@query("upsert_company_plan", f"""SELECT c.id, coalesce(n.name, c.name) AS name, coalesce(n.site, '') AS website, CASE WHEN c.id IS NULL THEN 'insert' WHEN coalesce(n.name, c.name) = c.name AND n.site IS NULL THEN 'keep' ELSE 'update' END AS action FROM d_company c
    FULL JOIN (SELECT lower(trim(name)) AS k, arg_max(trim(name), ord) AS name, arg_max(website, ord) FILTER (website <> '') AS site FROM {NEWS} WHERE trim(name) <> '' GROUP BY 1) n ON n.k = lower(c.name)""")
def upsert_company_plan(d):
    d.d_company.createOrReplaceTempView("d_company")
    return X.company_import(d.d_company.select("id", "name").withColumn("website", F.lit(None).cast("string")), d._spark.sql(f"SELECT * FROM {NEWS}"))


@query("emerging_seed", f"""SELECT s.id, coalesce(s.name, v.n) AS name, CASE WHEN v.n IS NULL THEN array_to_string(list_filter(string_split(alias_text, '|'), lambda x: trim(x) <> ''), '#') WHEN s.id IS NULL THEN v.a
    ELSE array_to_string(list_filter(string_split(alias_text, '|'), lambda x: trim(x) <> '') || [v.a], '#') END AS aliases, CASE WHEN s.id IS NULL THEN 'insert' WHEN v.n IS NULL THEN 'keep' ELSE 'update' END AS action
    FROM {SKILL} s FULL JOIN (SELECT upper(name) AS n, 'Brand new ' || id AS a FROM {SKILL} WHERE id % 20 = 0 UNION ALL SELECT 'Agentic AI', 'agents') v ON lower(v.n) = lower(s.name)""")
def emerging_seed(d):
    some = skills(d).where("id % 20 = 0").select(F.upper("name").alias("name"), F.array(F.concat(F.lit("Brand new "), F.col("id").cast("string")), F.concat(F.lit(" brand NEW "), F.col("id").cast("string"), F.lit(","))).alias("aliases"))
    seed = some.unionByName(d._spark.createDataFrame([("Agentic AI", ["agents"])], "name string, aliases array<string>"))
    out = X.emerging_seed(skills(d), seed)
    return out.withColumn("aliases", F.array_join("aliases", "#"))
