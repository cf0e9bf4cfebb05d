"""Rules over texts of whole tables. Each query has its texts in words that Spark and DuckDB share, and SQL that states the rule over them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.operators import answers as A
from demandlens.operators import canonical as K
from demandlens.operators.monitoring import on_cooldown
from demandlens.plans.catalog import query
from demandlens.sources import parsers as P
from demandlens.sources import settings as S
from demandlens.sources.binding import LOG_AS_OF

VIEWS = ("documents", "pages", "events", "part", "d_job_post", "d_company", "d_link", "d_skill_set", "d_application_skill", "nation", "region")


def given(d, sql: str):
    for name in VIEWS:
        if name in sql:
            getattr(d, name).createOrReplaceTempView(name)
    return d._spark.sql(sql)


def rule(name: str, source: str, sql: str, f, column: str = "value"):
    """Rows (id, x, ...) of ``source``, a SELECT, to (id, value): by ``f`` of the rows' DataFrame or of the column x, and by the SQL expression."""

    @query(name, f"SELECT id, {sql} AS {column} FROM ({source})")
    def run(d):
        rows = given(d, source)
        made = f(F.col("x")) if f.__code__.co_varnames[:1] == ("x",) else f(rows)
        return rows.select("id", made.alias(column)) if isinstance(made, Column) else made


def B(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


EMPTY = "('', '-', '--', '—', 'n/a', 'na', 'none', 'null', 'not applicable', 'not specified', 'unknown', 'undefined')"


def C(x: str) -> str:
    """SQL of a value that says something, else null."""
    return f"(CASE WHEN lower({B(x)}) NOT IN {EMPTY} THEN {B(x)} END)"


def kind(x: str) -> str:
    """SQL of a canonical job type."""
    key = B(f"translate(lower({C(x)}), '_/.', '   ')")
    return f"""(CASE WHEN regexp_full_match({key}, 'full[ -]?time|permanent') THEN 'FULL_TIME' WHEN regexp_full_match({key}, 'part[ -]?time') THEN 'PART_TIME' WHEN regexp_full_match({key}, 'intern|internship|co[ -]op') THEN 'INTERNSHIP'
    WHEN {key} IN ('contract', 'contractor') THEN 'CONTRACT' WHEN {key} IN ('temp', 'temporary') THEN 'TEMPORARY' ELSE translate(upper({C(x)}), ' -', '__') END)"""


def where_(x: str) -> str:
    """SQL of a normalised location."""
    key = B(f"replace(lower({C(x)}), '_', ' ')")
    return f"""(CASE WHEN {key} IN ('remote', 'work from home', 'wfh', 'home based', 'home-based') OR contains({key}, 'work from home') OR {key} LIKE 'remote%' THEN 'Remote' WHEN {key} IN ('hybrid', 'hybrid remote') THEN 'Hybrid'
    WHEN {key} IN ('onsite', 'on site', 'on-site', 'in office', 'office') THEN 'On-site' ELSE {C(x)} END)"""


def labelled(x: str, pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "(CASE " + " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN '{label}'" for label, p in pairs) + f" ELSE {otherwise} END)"


# --- canonical jobs
MESSY = """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN concat(' ', replace(text, ' ', '  ')) WHEN 1 THEN split_part(text, chr(10), 2) WHEN 2 THEN CASE WHEN n_chars % 2 = 0 THEN ' Not  Specified' ELSE upper(lang) END
    ELSE concat(split_part(text, ' ', 1), chr(9), source, chr(10)) END AS x FROM documents"""
rule("clean_text", MESSY, C("x"), lambda x: K.clean(x))
TYPES = """SELECT id, CASE id % 6 WHEN 0 THEN upper(employment_type) WHEN 1 THEN replace(employment_type, '-', '_') WHEN 2 THEN replace(lower(employment_type), '-', '/') WHEN 3 THEN title WHEN 4 THEN concat(' ', replace(employment_type, '-', '')) ELSE concat(employment_type, 'or') END AS x FROM d_job_post"""
rule("norm_job_type_canonical", TYPES, kind("x"), lambda x: K.job_type(x))
rule("norm_job_type", TYPES, f"""CASE WHEN regexp_full_match({B("lower(replace(x, '_', ' '))")}, 'full[ -]?time') THEN 'Full-time' WHEN regexp_full_match({B("lower(replace(x, '_', ' '))")}, 'part[ -]?time') THEN 'Part-time'
    WHEN {B("lower(replace(x, '_', ' '))")} = 'contract' THEN 'Contract' WHEN {B("lower(replace(x, '_', ' '))")} IN ('intern', 'internship') THEN 'Internship' WHEN {B("lower(replace(x, '_', ' '))")} IN ('temp', 'temporary') THEN 'Temporary' ELSE {B("replace(x, '_', ' ')")} END""", lambda x: T.job_type(x))  # fmt: skip
PLACES = "SELECT id, CASE id % 6 WHEN 0 THEN concat('  ', location) WHEN 1 THEN upper(remote_type) WHEN 2 THEN replace(remote_type, '-', '_') WHEN 3 THEN concat(location, ' or work  from home') WHEN 4 THEN concat(lower(remote_type), ', ', location) ELSE concat('Hybrid_', remote_type) END AS x FROM d_job_post"
rule("norm_location", PLACES, where_("x"), lambda x: K.location(x))
PLACED = """SELECT id, CASE id % 6 WHEN 0 THEN concat('{"name": "', location, '"}') WHEN 1 THEN concat('{"city": "', remote_type, '", "x": 1}') WHEN 2 THEN concat('[{"name": "', location, '"}, "n/a", "', lower(remote_type), '"]') WHEN 3 THEN 'true' WHEN 4 THEN '[]' ELSE location END AS x FROM d_job_post"""
NAMED = "coalesce({0} ->> '$.name', {0} ->> '$.location', {0} ->> '$.city', {0} ->> '$.display_name')"
rule("location_value", PLACED, f"""CASE WHEN x LIKE '[%' THEN {where_(f"nullif(array_to_string(list_filter(list_transform(CASE WHEN x LIKE '[%' THEN x::JSON::JSON[] END, lambda j: {C(f'(CASE WHEN json_type(j) = {chr(39)}OBJECT{chr(39)} THEN {NAMED.format(chr(106))} ELSE j ->> {chr(39)}${chr(39)} END)')}), lambda v: v IS NOT NULL), ', '), '')")}
    WHEN x LIKE '{{%' THEN {where_(NAMED.format("CASE WHEN x LIKE '{%' THEN x::JSON END"))} WHEN x = 'true' THEN 'Remote' WHEN x = 'false' THEN NULL ELSE {where_('x')} END""", lambda x: K.place(x))  # fmt: skip
SAID = "SELECT id, concat(title, CASE id % 5 WHEN 0 THEN ' Co-op ' WHEN 1 THEN '; ' WHEN 2 THEN ' contractors, ' WHEN 3 THEN ' internship or ' ELSE ' temp' END, CASE id % 3 WHEN 0 THEN replace(employment_type, '-', ' ') WHEN 1 THEN lower(employment_type) ELSE '' END, '.') AS x FROM d_job_post"
rule("infer_job_type", SAID, labelled("x", [("INTERNSHIP", r"\b(intern|internship|co[\s-]?op)\b"), ("PART_TIME", r"\bpart[\s-]?time\b"), ("CONTRACT", r"\bcontract(or)?\b"), ("TEMPORARY", r"\btemp(orary)?\b"), ("FULL_TIME", r"\bfull[\s-]?time\b")], "NULL"), lambda x: K.infer_job_type(x))
rule("infer_job_label", SAID, labelled("x", [("Full-time", r"\bfull[\s-]?time\b"), ("Part-time", r"\bpart[\s-]?time\b"), ("Internship", r"\b(internship|co[\s-]?op)\b"), ("Contract", r"\bcontract(or)?\b"), ("Temporary", r"\btemp(orary)?\b")], "''"), lambda x: P.job_label(x))
rule("config_bool", """SELECT event_id AS id, CASE user_id % 7 WHEN 0 THEN '{"a": true}' WHEN 1 THEN concat('{"b": " ', CASE WHEN event_type = 'view' THEN 'Yes' ELSE event_type END, ' "}') WHEN 2 THEN '{"a": "no", "b": "yes"}' WHEN 3 THEN concat('{"a": ', CAST(event_id % 3 AS STRING), '}') WHEN 4 THEN props ELSE '{"a": " ON"}' END AS x FROM events""",
     "CASE WHEN coalesce(x ->> '$.a', x ->> '$.b') IS NULL THEN true ELSE lower(trim(coalesce(x ->> '$.a', x ->> '$.b'))) IN ('1', 'true', 'yes', 'on') END", lambda x: K.config_bool(x, ["a", "b"], True))
rule("merge_config", "SELECT event_id AS id, event_type AS x, CAST(user_id AS STRING) AS y FROM events", "'a=' || CASE WHEN x = 'view' THEN y ELSE x END || ',b=' || y || ',c=' || x",
     lambda rows: F.array_join(F.array_sort(F.transform(F.map_entries(K.merged_config(F.create_map(F.lit("a"), F.col("x"), F.lit("b"), F.col("y")), F.when(F.col("x") == "view", F.create_map(F.lit("a"), F.col("y"), F.lit("c"), F.col("x"))).otherwise(F.create_map(F.lit("c"), F.col("x"))))),
                                                 lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))
rule("rolling_window_pick", "SELECT id, title AS x FROM d_job_post", "array_to_string(list_transform(range(least(2, len(string_split(x, ' ')))), lambda i: string_split(x, ' ')[(id + i) % len(string_split(x, ' ')) + 1]), ',')",
     lambda rows: F.array_join(P.picked_window(F.split("x", " "), F.col("id"), 2), ","))
rule("picked_language", """SELECT doc_id AS id, concat('{"', lang, '": "', CASE WHEN n_chars % 5 = 0 THEN '' ELSE source END, '"', CASE doc_id % 3 WHEN 0 THEN ', "en-gb": "Gb"' WHEN 1 THEN ', "en-us": "", "zz": "Last"' ELSE '' END, '}') AS x FROM documents""",
     """coalesce(nullif(x ->> '$.en', ''), nullif(x ->> '$."en-us"', ''), nullif(x ->> '$."en-gb"', ''), nullif(x ->> '$.de', ''), nullif(x ->> '$.fr', ''), nullif(x ->> '$.es', ''), nullif(x ->> '$.zz', ''))""", lambda x: P.picked_language(F.from_json(x, "map<string,string>")))  # fmt: skip
rule("link_uris", """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('{"b": [{"uri": "', p_name, '"}, {"uri": "u2"}], "a": [{"uri": "', p_brand, '"}]}') WHEN 1 THEN concat('{"c": [{"uri": "', p_name, '"}]}') ELSE concat('{"a": [{"uri": "', p_type, '"}]}') END AS x FROM part""",
     "array_to_string(list_sort(list_concat(from_json(json_extract_string(x, '$.a[*].uri')::JSON, '[\"VARCHAR\"]'), from_json(json_extract_string(x, '$.b[*].uri')::JSON, '[\"VARCHAR\"]'))), ',')".replace("from_json(json_extract_string(x, '$.a[*].uri')::JSON, '[\"VARCHAR\"]')", "json_extract_string(x, '$.a[*].uri')").replace("from_json(json_extract_string(x, '$.b[*].uri')::JSON, '[\"VARCHAR\"]')", "json_extract_string(x, '$.b[*].uri')"),
     lambda x: F.array_join(F.array_sort(P.link_uris(F.from_json(x, "map<string,array<struct<uri:string>>>"), ["a", "b"])), ","))
BLANKS = "SELECT id, CASE WHEN id % 3 = 0 THEN ' ' ELSE title END AS title, CASE id % 4 WHEN 0 THEN '' ELSE location END AS company_name, CASE id % 5 WHEN 0 THEN '' ELSE title END AS source_url, CASE WHEN id % 2 = 0 THEN CAST(id AS STRING) END AS external_id FROM d_job_post"
rule("validate_payload", BLANKS, "concat_ws(', ', CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN trim(company_name) = '' THEN 'company_name' END, CASE WHEN source_url = '' AND external_id IS NULL THEN 'source_url_or_external_id' END)",
     lambda rows: K.missing_fields(rows).select("id", F.col("missing").alias("value")))
POSTING = """SELECT id, CASE id % 4 WHEN 0 THEN concat('{"jobTitle": " ', title, ' ", "company": {"name": "', source_type, '"}, "url": "n/a", "link": "https://a/', CAST(id AS STRING), '", "id": ', CAST(id AS STRING), ', "type": "', employment_type, '", "locations": [{"name": "', location, '"}, "wfh"], "about_role": "We do.", "sections": {"about": "old", "perks": "Tea"}}')
    WHEN 1 THEN concat('{"title": "', title, '", "employer": "unknown", "description": "A part time role.", "remote": true, "url": "https://b"}') WHEN 2 THEN concat('{"name": "', title, '", "organization": "', location, '", "employment_type": "', employment_type, '", "workplaceType": "', remote_type, '", "location": "-"}')
    ELSE concat('{"title": "', title, '", "company_name": "', status, '", "metadata": {"default_job_type": "temp"}, "body": "', source_type, '"}') END AS x, title, source_type, location, employment_type, remote_type, status FROM d_job_post"""


def _canonical(rows):
    staged = rows.select("id", F.col("x").alias("raw"), F.lit("A source").alias("source_name"), F.lit("Default Co").alias("default_company"), F.lit("permanent").alias("default_job_type"), F.lit(False).alias("filters_types"))
    shown = [F.coalesce(c, F.lit("")) for c in ("title", "company_name", "source_url", "external_id", "job_type", "location", "remote_type", "description")]
    return K.canonicalize(staged).select("id", F.concat_ws("|", *shown).alias("value"))


NAME = C("coalesce(x ->> '$.title', x ->> '$.jobTitle', x ->> '$.name')")
FIRM = C("coalesce(x ->> '$.company_name', x ->> '$.company', x ->> '$.organization', x ->> '$.employer')")
GIVEN_TYPE = kind("coalesce(x ->> '$.employment_type', x ->> '$.type')")
ABOUT = "concat_ws(chr(10) || chr(10), x ->> '$.about_role', x ->> '$.sections.perks')"
WORDS = f"concat_ws(' ', {NAME}, coalesce({C("coalesce(x ->> '$.description', x ->> '$.body')")}, {ABOUT}))"
INFERRED = labelled(WORDS, [("INTERNSHIP", r"\b(intern|internship|co[\s-]?op)\b"), ("PART_TIME", r"\bpart[\s-]?time\b"), ("CONTRACT", r"\bcontract(or)?\b"), ("TEMPORARY", r"\btemp(orary)?\b"), ("FULL_TIME", r"\bfull[\s-]?time\b")], "NULL")
rule("canonicalize", POSTING, f"""concat_ws('|', coalesce({NAME}, ''), coalesce({FIRM}, 'Default Co'), coalesce({C("coalesce(nullif(x ->> '$.url', 'n/a'), x ->> '$.link')")}, ''), coalesce(x ->> '$.id', ''),
    coalesce({GIVEN_TYPE}, {INFERRED}, {kind("x ->> '$.metadata.default_job_type'")}, 'FULL_TIME'),
    coalesce(CASE WHEN (x -> '$.locations') IS NOT NULL THEN {where_(f"concat_ws(', ', {C("x ->> '$.locations[0].name'")}, x ->> '$.locations[1]')")} ELSE {where_("x ->> '$.location'")} END, ''), coalesce(CASE WHEN x ->> '$.remote' = 'true' THEN 'Remote' ELSE {where_("x ->> '$.workplaceType'")} END, ''),
    coalesce({C("coalesce(x ->> '$.description', x ->> '$.body')")}, {ABOUT}, ''))""", _canonical)  # fmt: skip

# --- filters of a source
JOBS = "SELECT j.id, j.title, c.name AS company_name, j.location, j.remote_type, j.employment_type, '' AS job_type, lower(j.source_type) AS description, c.industry FROM d_job_post j JOIN d_company c ON c.id = j.company_id"


def filtered(name: str, settings: dict, sql: str):
    rule(name, JOBS, sql, lambda rows: rows.withColumn("sections", F.create_map(F.lit("field"), F.col("industry"))).select("id", F.coalesce(K.source_filter(settings), F.lit(False)).alias("value")))


filtered("flt_location", {"locations": ["United_Kingdom", "in", "fran"]}, "contains(lower(location), 'united kingdom') OR contains(lower(location), 'fran') OR lower(location) = 'in' OR regexp_matches(lower(location), '(^|[,\\s])in($|[,\\s(])')")
filtered("flt_workplace", {"workplace_types": ["Remote", "on_site", "odd"]}, "contains(lower(remote_type), 'remote') OR NOT (contains(lower(remote_type || ' ' || location || ' ' || description), 'remote') OR contains(lower(remote_type || ' ' || location || ' ' || description), 'hybrid'))")
filtered("flt_job_type", {"job_types": ["full time", "n/a", "Co-op"]}, "employment_type IN ('Full-time', 'Internship')")
filtered("source_filter", {"include_keywords": ["url", "machinery engineer", "1"], "exclude_keywords": ["germany", "manual"], "workplace_types": ["hybrid"], "job_types": ["contract", "part-time"]},
         r"regexp_matches(lower(concat_ws(' ', title, company_name, location, description, industry)), '\b(url|machinery engineer|1)\b') AND NOT regexp_matches(lower(concat_ws(' ', title, company_name, location, description, industry)), '\b(germany|manual)\b') AND remote_type = 'Hybrid' AND employment_type IN ('Contract', 'Part-time')")
# --- pages
def UN(x: str) -> str:
    """SQL of a text with the usual named entities read, the ampersand last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


rule("entities", "SELECT page_id AS id, html, 65 + page_id % 26 AS a, 200 + page_id % 50 AS b, concat(html, '&#', CAST(65 + page_id % 26 AS STRING), ';&#x', hex(200 + page_id % 50), '; &bogus; &#0;') AS x FROM pages",
     UN("html || chr(a::INT) || chr(b::INT) || ' &bogus; &#0;'"), lambda x: P.unescaped(x))
BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '</(p|li|div|br|ul|ol|h\d)>', chr(10), 'gi'), '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"
rule("html_to_text_lines", "SELECT page_id AS id, html AS x FROM pages", f"array_to_string(list_filter(list_transform(string_split_regex({UN(BARE)}, '[\\r\\n]'), lambda l: {B('l')}), lambda l: l <> ''), chr(10))", lambda x: P.page_text(x, True))
rule("board_text", "SELECT page_id AS id, replace(replace(html, '<', '&lt;'), '>', '&gt;') AS x FROM pages", B(f"regexp_replace({UN('x')}, '<[^>]+>', ' ', 'g')"), lambda x: P.board_text(x))
rule("job_id_from_url", """SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN concat('https://www.linkedin.com/jobs/view/', CAST(page_id AS STRING), '/?x=', url) WHEN 1 THEN concat(url, '&currentJobId=', CAST(page_id AS STRING)) WHEN 2 THEN concat('/jobs-guest/jobs/api/jobPosting/', CAST(page_id AS STRING))
    WHEN 3 THEN concat(url, '/jobs/view/a') ELSE url END AS x FROM pages""", r"coalesce(nullif(regexp_extract(x, '/jobs/view/(\d+)', 1), ''), nullif(regexp_extract(x, '/jobs-guest/jobs/api/jobPosting/(\d+)', 1), ''), regexp_extract(x, '[?&]currentJobId=(\d+)', 1))", lambda x: P.job_id(x))
CARD = """SELECT id, title, status, location, employment_type, substr(CAST(created_at AS STRING), 1, 10) AS day, concat('<div data-entity-urn="urn:li:jobPosting:', CAST(id AS STRING), '"><h3 class="base-search-card__title"> ', title, ' &amp; co </h3><h4 class="x base-search-card__subtitle">', status,
    '</h4><span class="job-search-card__location">', location, '</span> ', lower(employment_type), ' <time class="t" datetime="', substr(CAST(created_at AS STRING), 1, 10), '"></time></div><div data-entity-urn="urn:li:jobPosting:', CAST(id + 1 AS STRING), '"><h3 class="base-search-card__title">', remote_type, '</h3></div><div data-entity-urn="urn:li:jobPosting:', CAST(id AS STRING), '">again</div>') AS x, remote_type FROM d_job_post"""
rule("html_cards", CARD, "array_to_string(list_sort([concat_ws(':', id::VARCHAR, title || ' & co', status, location, employment_type, day), (id + 1) || ':' || remote_type || '::::']), ';')",
     lambda rows: P.search_cards(rows.selectExpr("id AS page_id", "x AS html")).groupBy(F.col("page_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "job_id", *[F.coalesce(c, F.lit("")) for c in ("title", "company", "location", "job_type", "posted_at")]))), ";").alias("value")))
DETAIL = """SELECT id, title, status, location, employment_type, remote_type, CASE WHEN id % 2 = 0 THEN concat('<h1 class="top-card-layout__title">', title, '</h1><a class="topcard__org-name-link">', status, '</a><span class="topcard__flavor--bullet">', location, '</span><div class="show-more-less-html__markup">', remote_type,
    '<br>two</div><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Employment type</h3><span class="description__job-criteria-text">', employment_type, '</span></li>') ELSE concat('<h1>', title, '</h1> a ', lower(employment_type), ' job <div class="show-more-less-html__markup">part time</div>') END AS x FROM d_job_post"""
rule("html_detail", DETAIL, """CASE WHEN id % 2 = 0 THEN concat_ws('|', title, status, location, CASE WHEN employment_type <> '' THEN employment_type ELSE '' END, remote_type || ' two') ELSE concat_ws('|', title, '', '', employment_type, 'part time') END""",
     lambda rows: P.job_pages(rows.selectExpr("id AS page_id", "x AS html")).select(F.col("page_id").alias("id"), F.concat_ws("|", *[F.coalesce(F.replace(F.col(c), F.lit("\n"), F.lit(" ")), F.lit("")) for c in ("title", "company", "location", "job_type", "description")]).alias("value")))
S19 = "substr(CAST(ts AS STRING), 1, 19)"
rule("parse_iso_ts", f"SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN concat(replace({S19}, ' ', 'T'), 'Z') WHEN 1 THEN concat({S19}, '+02:00') WHEN 2 THEN substr({S19}, 1, 16) WHEN 3 THEN substr({S19}, 1, 10) ELSE event_type END AS x FROM events",
     "CASE WHEN x LIKE '%Z' THEN replace(rtrim(x, 'Z'), 'T', ' ') WHEN x LIKE '%+02:00' THEN strftime(left(x, 19)::TIMESTAMP - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN length(x) = 16 THEN x || ':00' WHEN length(x) = 10 THEN x || ' 00:00:00' END",
     lambda x: F.date_format(P.iso_time(x), "yyyy-MM-dd HH:mm:ss"))
BOARD = """SELECT id, title, location, status, source_type, concat(lower(source_type), '-labs') AS board_token, concat('{"jobs": [{"id": ', CAST(id AS STRING), ', "title": "', title, '", "location": {"name": "', location, '"}, "content": "&lt;p&gt;Hi ', lower(status), '&lt;/p&gt; co-op", "absolute_url": "https://g/', CAST(id AS STRING),
    '"}, {"id": ', CAST(id + 1 AS STRING), ', "title": "Lead", "company_name": "Own", "location": "Remote"}]}') AS payload FROM d_job_post"""
rule("greenhouse_rows", BOARD, "array_to_string(list_sort([concat_ws('|', id::VARCHAR, title, left(source_type, 1) || lower(substr(source_type, 2)) || ' Labs', 'https://g/' || id, location, 'Hi ' || lower(status) || ' co-op', 'Internship'), (id + 1) || '|Lead|Own||Remote||']), ';')",
     lambda rows: P.board_jobs(rows.select("board_token", "payload", "id")).withColumn("value", F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("external_id", "title", "company_name", "source_url", "location", "description", "job_type")]))
     .groupBy(F.col("key").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("value")), ";").alias("value")))
POSTED = "SELECT id, title, location, employment_type AS job_type, CASE id % 3 WHEN 0 THEN concat(substr(CAST(created_at AS STRING), 1, 10), 'T00:00:00Z') WHEN 1 THEN '' ELSE 'never' END AS first_published, substr(CAST(created_at AS STRING), 1, 10) AS updated_at FROM d_job_post"
rule("gh_filter", POSTED, "(contains(lower(title), 'machinery') OR contains(title, '1')) AND job_type IN ('', 'Internship') AND (id % 3 = 2 OR updated_at::TIMESTAMP >= TIMESTAMP '1996-02-01' - INTERVAL 30 DAY)",
     lambda rows: rows.select("id", P.board_filter(["MACHINERY", "1"], ["internship"], False, "Past Month", "1996-02-01 00:00:00").alias("value")))
rule("configured_jobs", """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('{"raw_jobs": [{"title": "', p_name, '"}, {"title": "', p_brand, '"}], "jobs": [{"title": "c"}]}') WHEN 1 THEN concat('{"jobs": [{"title": "', p_type, '"}]}') ELSE concat('{"jobs": [], "name": "', p_name, '"}') END AS x FROM part""",
     "nullif(array_to_string(list_transform(coalesce((x -> '$.raw_jobs')::JSON[], (x -> '$.jobs')::JSON[]), lambda j, i: (i - 1) || ':' || (j ->> '$.title')), ','), '')",
     lambda rows: rows.select("id").join(P.inline_jobs(rows.selectExpr("id AS source_id", "x AS crawl_config")).groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("ord").cast("string"), F.lit(":"), F.get_json_object("raw", "$.title")))), ",").alias("value")), "id", "left"))


@query("search_url_expansion", """SELECT r_regionkey AS source_id, ord, keyword, location, workplace FROM (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY keyword, location DESC, workplace DESC) - 1 AS ord FROM
    (SELECT r_regionkey, n_name AS keyword FROM region JOIN nation ON n_regionkey = r_regionkey), (SELECT unnest(['x', 'r']) AS workplace), (SELECT r_regionkey AS k, CASE r_regionkey % 2 WHEN 0 THEN unnest([r_name, '']) ELSE unnest(['', NULL]) END AS location FROM region) WHERE k = r_regionkey AND location IS NOT NULL AND (k % 2 = 1 OR location <> '')) WHERE ord < 7""", views=False)
def search_url_expansion(d):
    named = d.nation.groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_list("n_name")).alias("keywords"))
    none = F.array().cast("array<string>")
    sources = d.region.join(named, F.col("r_regionkey") == F.col("r")).select(F.col("r_regionkey").alias("source_id"), "keywords", F.when(F.col("r_regionkey") % 2 == 0, F.array("r_name", "r_name")).otherwise(none).alias("locations"), F.array(F.lit("x"), F.lit("r")).alias("workplaces"), none.alias("job_types"))
    return P.search_combinations(sources, 7).select("source_id", F.col("ord").cast("long").alias("ord"), "keyword", "location", "workplace")


# --- answers, resumes, runs
def capital(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


EXTRACT = """SELECT p_partkey AS id, p_name, p_brand, CASE p_partkey % 5 WHEN 0 THEN concat('{"candidate_skills": ["', p_name, '", {"name": "', upper(p_name), '"}, {"skill": "', lower(p_type), ' lake", "confidence": "High", "source_fragment": " a  ', p_name, ' "}, "', p_brand, '", "rust"]}') WHEN 1 THEN concat('{"skills": [{"name": "', p_brand, '", "confidence": 0.', CAST(p_size AS STRING), '}]}')
    WHEN 2 THEN '{"candidate_skills": []}' WHEN 3 THEN concat('{"skills": ["', p_name, '", {"name": " "}]}') ELSE concat('{', p_name) END AS x, p_type, p_size FROM part"""
rule("parse_extract", EXTRACT, f"""CASE id % 5 WHEN 0 THEN '1:' || {capital('p_name')} || '::,2:' || {capital("lower(p_type) || ' lake'")} || ':0.9:a ' || p_name || ',3:' || p_brand || '::' WHEN 1 THEN '1:' || p_brand || ':' || ('0.' || p_size)::DOUBLE || ':' WHEN 2 THEN 'no skills' WHEN 3 THEN 'empty name' ELSE 'malformed' END""",
     lambda rows: A.parse_extracted(rows.selectExpr("id", "x AS payload"), 3).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("error", F.concat_ws(":", F.col("at").cast("string"), "name", F.coalesce(F.col("confidence").cast("string"), F.lit("")), F.coalesce("fragment", F.lit("")))))), ",").alias("value")))
VERIFY = """SELECT p_partkey AS id, p_name, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN '{}' ELSE concat('{"verified_skills": ["', p_name, '", "', upper(p_name), '", "', p_brand, '"], "rejected_skills": ["', upper(p_brand), '", {"name": "', p_type, '", "reason": "no"}, "vb", "c"]}') END AS x FROM part"""
rule("parse_verify", VERIFY, f"CASE WHEN id % 3 > 0 THEN array_to_string(list_sort(['+' || {capital('p_name')}, '+' || p_brand, '-' || {capital('p_type')}, '-Vb']), ',') END",
     lambda rows: rows.select("id").join(A.parse_verified(rows.selectExpr("id", "x AS payload"), 4).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.when(F.col("verified"), "+").otherwise("-"), "name"))), ",").alias("value")), "id", "left"))
MAPPED = """SELECT p_partkey AS id, p_name, p_brand, p_size, CASE p_partkey % 4 WHEN 0 THEN concat('{"canonical": " ', replace(p_name, ' ', '  '), ' ", "confidence": ', CAST(p_size / 20 AS STRING), ', "reason": "', p_brand, '"}') WHEN 1 THEN '{"canonical": "", "reason": null}' WHEN 2 THEN concat('{"confidence": "', p_brand, '"}') ELSE p_name END AS x FROM part"""
rule("parse_map", MAPPED, "CASE id % 4 WHEN 0 THEN p_name || '|' || least(p_size / 20, 1.0)::DOUBLE || '|' || p_brand || '|' WHEN 1 THEN '|0.0||' WHEN 2 THEN '|||confidence' ELSE '|||malformed' END",
     lambda rows: A.parse_mapped(rows.selectExpr("id", "x AS payload")).select("id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("canonical", "confidence", "reason", "error")]).alias("value")))
rule("section_fragments", """SELECT id, title, location, concat('{"about": "', title, '", "perks": "  ", "needs": "', location, '"}') AS x FROM d_job_post""", "concat_ws(',', 'about=' || title, CASE WHEN location <> '' THEN 'needs=' || location END)",
     lambda rows: A.section_fragments(rows.select("id", F.from_json("x", "map<string,string>").alias("sections"))).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", "text"))), ",").alias("value")))
LINE = "split_part(text, chr(10), {})"
RESUME = f"SELECT doc_id AS id, {LINE.format(1)} AS a, {LINE.format(2)} AS b, source, lang, concat({LINE.format(1)}, chr(10), 'SKILLS:', chr(10), ' ', source, ' ', chr(10), chr(10), lang, chr(10), 'Work Experience', chr(10), {LINE.format(2)}, chr(10), 'technologies', chr(10), 'sql') AS x FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL"
rule("resume_sections", RESUME, "concat_ws('|', CASE WHEN trim(b) <> '' THEN 'experience=' || trim(b) END, CASE WHEN trim(a) <> '' THEN 'resume=' || trim(a) END, 'skills=' || trim(source) || '/' || trim(lang) || '/sql')",
     lambda rows: A.resume_sections(rows.selectExpr("id", "x AS text")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "section", F.replace("text", F.lit("\n"), F.lit("/"))))), "|").alias("value")))


def runs(d):
    """A run of each job: its skills by score and number stand for what was verified, mapped, expected and rejected."""
    named = d.d_link.join(d.d_skill_set.selectExpr("id AS skill_set_id", "name"), "skill_set_id")
    kept = {"verified": "score >= 50", "mapped": "score >= 80", "expected": "skill_set_id % 2 = 0", "expected_mapped": "skill_set_id % 3 = 0", "reject": "skill_set_id % 25 = 0", "any_of": "skill_set_id % 7 = 0"}
    lists = [F.collect_list(F.when(F.expr(when), F.upper("name") if c == "expected" else F.col("name"))).alias(c) for c, when in kept.items()]
    return A.evaluate(named.groupBy(F.col("job_post_id").alias("run")).agg(*lists).withColumn("minimum_verified", F.lit(1)))


RUNS = """(SELECT job_post_id AS id, list_sort(list(lower(s.name)) FILTER (score < 50 AND s.id % 2 = 0)) AS lost, list_sort(list(lower(s.name)) FILTER (score < 80 AND s.id % 3 = 0)) AS unmapped, list_sort(list(lower(s.name)) FILTER (score >= 50 AND s.id % 25 = 0)) AS bad,
    list_sort(list(lower(s.name)) FILTER (score >= 50)) AS accepted, count(*) FILTER (s.id % 7 = 0) > 0 AND count(*) FILTER (s.id % 7 = 0 AND score >= 50) = 0 AS lacks FROM d_link l JOIN d_skill_set s ON s.id = l.skill_set_id GROUP BY 1)"""


@query("gold_eval", f"SELECT id, lost IS NULL AND unmapped IS NULL AND bad IS NULL AND accepted IS NOT NULL AND NOT lacks AS passed, coalesce(array_to_string(lost, ','), '') AS missing_expected, coalesce(array_to_string(unmapped, ','), '') AS missing_mapped, coalesce(array_to_string(bad, ','), '') AS rejected_present FROM {RUNS}")
def gold_eval(d):
    return runs(d).select(F.col("run").alias("id"), "passed", *[F.array_join(c, ",").alias(c) for c in ("missing_expected", "missing_mapped", "rejected_present")])


@query("eval_accepted", f"SELECT id, coalesce(array_to_string(accepted, ','), '') AS value FROM {RUNS}")
def eval_accepted(d):
    return runs(d).select(F.col("run").alias("id"), F.array_join("accepted", ",").alias("value"))


# --- names, sources, relations
rule("norm_confidence", """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN concat(' ', CASE event_type WHEN 'view' THEN 'High' WHEN 'click' THEN 'MEDIUM' WHEN 'error' THEN 'low' ELSE event_type END) WHEN 2 THEN concat('-', CAST(user_id AS STRING)) ELSE concat('0.', CAST(user_id AS STRING)) END AS x FROM events""",
     "CASE lower(trim(x)) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'moderate' THEN 0.6 WHEN 'low' THEN 0.3 ELSE CASE WHEN try_cast(trim(x) AS DOUBLE) IS NOT NULL THEN greatest(0, least(1, try_cast(trim(x) AS DOUBLE))) END END::DOUBLE", lambda x: T.confidence(x))
rule("relation_type", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat(' Broader', CASE WHEN p_size % 2 = 0 THEN ' Than' ELSE '' END) WHEN 1 THEN concat('NARROWER', CASE WHEN p_size % 3 = 0 THEN 'THAN ' ELSE '' END) WHEN 2 THEN p_type WHEN 3 THEN concat('broader ', p_name) ELSE concat('narrower', CASE WHEN p_size % 2 = 0 THEN '_' ELSE ' ' END, 'than') END AS x FROM part""",
     "CASE WHEN regexp_matches(lower(trim(x)), '^broader( ?than)?$') THEN 'broader' WHEN regexp_matches(lower(trim(x)), '^narrower( ?than)?$') THEN 'narrower' ELSE 'related' END", lambda x: T.relation_type(x))
URLS = """SELECT page_id AS id, CASE page_id % 7 WHEN 0 THEN replace(url, 'example.com', 'linkedin.com') WHEN 1 THEN replace(url, '.example', '.joinhandshake') WHEN 2 THEN replace(replace(url, 'http://', ''), 'example.com', 'boards.greenhouse.io:443') WHEN 3 THEN concat('https://user@jobs.lever.co./', url) WHEN 4 THEN replace(url, 'example.com', 'notlinkedin.com') WHEN 5 THEN ' ' ELSE url END AS x,
    CASE page_id % 3 WHEN 0 THEN 'RSS' WHEN 1 THEN 'GENERIC_HTML' END AS y FROM pages"""
HOST = r"rtrim(regexp_extract(lower(trim(x)), '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)', 1), '.')"
OF_HOST = rf"CASE WHEN regexp_matches({HOST}, '(^|\.)linkedin\.com$') THEN 'LINKEDIN' WHEN regexp_matches({HOST}, '(^|\.)(join)?handshake\.com$') THEN 'HANDSHAKE' WHEN regexp_matches({HOST}, '(^|\.)(my|boards|job-boards)\.greenhouse\.io$') THEN 'GREENHOUSE' WHEN regexp_matches({HOST}, '(^|\.)jobs\.lever\.co$') THEN 'LEVER' END"
rule("detect_source", URLS, f"coalesce({OF_HOST}, CASE WHEN y = 'RSS' THEN y END, 'CAREER_SITE')", lambda rows: T.detect_source(F.col("x"), F.col("y")))
rule("source_scope", URLS, f"trim(x) <> '' AND coalesce({OF_HOST}, '') IN ('LINKEDIN', 'GREENHOUSE')", lambda x: (F.coalesce(F.trim(x), F.lit("")) != "") & T.detect_source(x).isin("LINKEDIN", "GREENHOUSE"), "in_scope")
NAMES = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN concat(' ', p_name, ' ,') WHEN 1 THEN upper(replace(p_name, ' ', '  ')) WHEN 2 THEN p_brand WHEN 3 THEN concat(CASE WHEN p_size % 2 = 0 THEN 'SQL' ELSE 'machine  Learning' END, ';') WHEN 4 THEN CAST(p_size AS STRING) ELSE concat('<', p_name, '>') END AS x FROM part"""
TRIMMED = rf"trim({B('x')}, '.,;:|/\<>')"
rule("display_name", NAMES, f"CASE lower({TRIMMED}) WHEN 'sql' THEN 'SQL' WHEN 'machine learning' THEN 'Machine Learning' ELSE CASE WHEN regexp_matches({TRIMMED}, '[a-zA-Z]') AND {TRIMMED} IN (lower({TRIMMED}), upper({TRIMMED})) THEN {capital(B(TRIMMED))} ELSE {TRIMMED} END END", lambda x: T.display_name(x))
COMPOUND = """SELECT p_partkey AS id, p_name, p_brand, p_type, CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' (', p_brand, ')') WHEN 1 THEN concat(p_name, ' (', p_brand, ', ', p_type, ')') WHEN 2 THEN concat(p_name, ' (', lower(p_type), ') (end to end) (', p_type, ')') WHEN 3 THEN concat('(', p_brand, ')') ELSE concat(p_name, ' (a b c d ', p_type, ') (see: x)') END AS x FROM part"""
rule("expand_compound", COMPOUND, f"CASE id % 5 WHEN 0 THEN {capital('p_name')} || '|' || p_brand WHEN 2 THEN {capital('p_name')} || '|' || {capital('p_type')} || '|End To End' WHEN 3 THEN p_brand ELSE {capital('p_name')} END", lambda x: F.array_join(T.compound_names(x), "|"))


rule("split_values", "SELECT id, concat(title, ',  ', upper(title), chr(10), remote_type, ', ', status, ',', lower(status), ' ,', chr(10), ' ') AS x FROM d_job_post", f"array_to_string([{B('title')}, remote_type, status], '|')".replace("title", "split_part(x, ',', 1)").replace("remote_type", "split_part(split_part(x, chr(10), 2), ',', 1)").replace("status", "trim(split_part(split_part(x, chr(10), 2), ',', 2))"),
     lambda x: F.array_join(S.split_values(x), "|"))
rule("placeholder_flag", "SELECT id, CASE WHEN id % 97 = 0 THEN 'job-12345 67890' ELSE CAST(id AS STRING) END AS x, CASE WHEN id % 89 = 0 THEN 'https://x/jobs/view/0000000000/?a=1' ELSE concat('https://x/jobs/view/', CAST(id AS STRING), '/1111111111') END AS url, CASE WHEN id % 83 = 0 THEN concat('1111', '111111') END AS external_id FROM d_job_post",
     "id % 97 = 0 OR id % 89 = 0 OR id % 83 = 0 OR id = 1234567890", lambda rows: S.placeholder(F.col("x"), F.col("external_id"), F.col("url")))
CODED = """SELECT id, CASE id % 3 WHEN 0 THEN upper(employment_type) WHEN 1 THEN replace(employment_type, '-', '_') ELSE left(employment_type, 1) END AS x, replace(concat(' ', upper(remote_type)), '-', '  ') AS w, CASE id % 6 WHEN 0 THEN 'Past_Week' WHEN 1 THEN ' 24  hours' WHEN 2 THEN 'Any time' WHEN 3 THEN concat(' ', status) WHEN 4 THEN 'r2592000' ELSE 'Month' END AS t,
    CASE id % 5 WHEN 0 THEN 'Newest_First' WHEN 1 THEN 'most relevant' WHEN 2 THEN ' dd ' WHEN 3 THEN status ELSE 'R' END AS s FROM d_job_post"""
rule("filter_codes", CODED, """concat_ws('|', CASE WHEN regexp_matches(lower(x), '^(full.time|f)$') THEN 'F' WHEN regexp_matches(lower(x), '^(part.time|p)$') THEN 'P' WHEN lower(x) IN ('contract', 'c') THEN 'C' WHEN lower(x) IN ('internship', 'i') THEN 'I' ELSE '' END, CASE WHEN w LIKE '%REMOTE' THEN '2' WHEN w LIKE '%HYBRID' THEN '3' ELSE '1' END,
    CASE id % 6 WHEN 0 THEN 'r604800' WHEN 1 THEN 'r86400' WHEN 2 THEN '' WHEN 3 THEN trim(t) ELSE 'r2592000' END, CASE id % 5 WHEN 0 THEN 'DD' WHEN 1 THEN 'R' WHEN 2 THEN 'DD' WHEN 3 THEN '' ELSE 'R' END)""",
     lambda rows: F.concat_ws("|", S.job_type_code(F.col("x")), S.workplace_code(F.col("w")), S.date_code(F.col("t")), S.sort_code(F.col("s"))))


@query("cooldown_flag", f"SELECT user_id AS id, max(ts) > TIMESTAMP '{LOG_AS_OF}' - INTERVAL 12 HOUR AS cooling FROM events GROUP BY 1", views=False)
def cooldown_flag(d):
    """Crawl users wait for half a day after their last event."""
    return on_cooldown(d.events.groupBy(F.col("user_id").alias("id")).agg((F.max("ts") + F.expr("INTERVAL 12 HOURS")).alias("rate_limited_until")), LOG_AS_OF)


@query("stability", "SELECT lower(category) AS normalized, count(*) AS n, count(*) = 3 AS stable FROM d_skill_set GROUP BY 1")
def stability(d):
    return A.stability(d.d_skill_set.select(F.concat(F.lit(" "), F.upper("category"), F.lit(".")).alias("name")), 3)


STEP = "element_at(array('text_extraction', 'ollama_extract', 'ollama_verify', 'skillset_mapping', 'job_match', 'market_fit', 'other'), CAST(id % 7 + 1 AS INT))"


@query("resume_status", """SELECT resume_id, CAST(count(*) FILTER (s IN ('SUCCESS', 'FAILED')) AS BIGINT) AS finished, round(count(*) FILTER (s IN ('SUCCESS', 'FAILED')) * 100 / 6, 2) AS progress, string_agg(s, ',' ORDER BY k) AS statuses FROM
    (SELECT r.resume_id, t.k, coalesce(l.status, CASE WHEN t.k = 5 AND r.resume_id % 2 = 0 THEN 'SUCCESS' END, 'PENDING') AS s FROM (SELECT DISTINCT crawl_run_id AS resume_id FROM d_pipeline_log) r CROSS JOIN range(0, 6) t(k)
    LEFT JOIN (SELECT crawl_run_id AS resume_id, id % 7 AS k, arg_max(status, (created_at, id)) AS status FROM d_pipeline_log GROUP BY 1, 2) l ON l.resume_id = r.resume_id AND l.k = t.k) GROUP BY 1""")
def resume_status(d):
    logs = d.d_pipeline_log.selectExpr("id", "crawl_run_id AS resume_id", f"{STEP} AS step_name", "status", "created_at")
    stored = logs.where("resume_id % 2 = 0").selectExpr("resume_id", "'market_fit' AS step_name", "'SUCCESS' AS status").distinct()
    return A.pipeline_status(logs, stored)
