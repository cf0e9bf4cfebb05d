"""Text, number and date expressions over the documents, pages and domain tables."""

from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.functions.numbers import percentage
from demandlens.plans.catalog import query

WS = r"regexp_replace({0}, '\s+', ' ', 'g')"
#: A text of each document with blanks and punctuation around it, so that the rules have something to do.
NOISY = "' ,; ' || replace(text, chr(10), '  ') || ' ./ '"


def _each(name: str, sql: str, source: str, key: str, f):
    @query(name, sql, views=source.startswith("d_"))
    def run(d):
        return getattr(d, source).select(key, f().alias("value"))


def _noisy():
    return F.concat(F.lit(" ,; "), F.replace("text", F.lit("\n"), F.lit("  ")), F.lit(" ./ "))


def _docs(name: str, expression: str, f):
    _each(name, f"SELECT doc_id, {expression} AS value FROM documents", "documents", "doc_id", f)


_docs("normalize_name", f"lower(trim(trim({WS.format(NOISY)}), '.,;:|/\\'))", lambda: T.normalize_name(_noisy()))
_docs("clean_keyword", f"trim(trim({WS.format(NOISY)}), ' .,;:|/\\')", lambda: T.clean_keyword(_noisy()))
_docs("truncate_label", f"rtrim(substr(trim({WS.format('text')}), 1, 120))", lambda: T.truncated(F.col("text")))
_docs("slugify", "substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120)", lambda: T.slug(F.col("text")))
_docs("board_token", "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')", lambda: T.board_token(F.col("text")))
_docs("clean_lines", "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 0), chr(10))", lambda: T.clean_lines(F.col("text")))
_docs("catalog_tokens", """array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9+#.]+'), lambda x: length(x) > 1
    AND NOT regexp_full_match(x, 'a|an|and|for|in|of|or|the|to|with|skills?|tools?|technology|technologies|engineering|engineer|implementations?|solutions?')),
    lambda x: CASE x WHEN 'ai' THEN ['ai', 'artificial', 'intelligence', 'machine', 'learning', 'genai'] WHEN 'llm' THEN ['llm', 'large', 'language', 'models', 'model', 'generative', 'ai']
    WHEN 'ml' THEN ['ml', 'machine', 'learning'] WHEN 'etl' THEN ['etl', 'extract', 'transform', 'load', 'data'] WHEN 'db' THEN ['db', 'database', 'databases'] WHEN 'devops' THEN ['devops', 'cloud', 'infrastructure', 'deployment']
    WHEN 'ot' THEN ['ot', 'operational', 'technology', 'security', 'cybersecurity'] WHEN 'nas' THEN ['nas', 'storage', 'network', 'infrastructure'] ELSE [x] END)))), ' ')""",
      lambda: F.array_join(F.sort_array(T.expanded_tokens(F.col("text"))), " "))
_docs("split_labels", "array_to_string(list_filter(list_transform(string_split_regex(text, '[\\r\\n|;]'), lambda x: trim(x, ' ')), lambda x: length(x) > 0), '#')", lambda: F.array_join(T.split_labels(F.col("text")), "#"))
_docs("flt_keyword_word", "regexp_matches(lower(text), '(^|[^a-z0-9_])the([^a-z0-9_]|$)') AND lang = 'en'", lambda: T.whole_word(F.regexp_replace("text", "[^\\x00-\\x7F]", "#"), "the") & (F.col("lang") == "en"))
_docs("term_count", "(length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4", lambda: T.occurrences(F.lower("text"), F.lit("tion")))
_each("search_tokens", """SELECT id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), lambda x: x), '|') AS value FROM (SELECT id, list_filter(list_transform(
    string_split_regex(trim(regexp_replace(title || ',  (' || upper(title) || ') [x] ,' || id, '\\s+', ' ', 'g')), '[\\s,]+'), lambda x: trim(x, '()[]{}')), lambda x: length(x) > 0) AS l FROM d_job_post)""".replace("\\\\", "\\"),
      "d_job_post", "id", lambda: F.array_join(T.search_tokens(F.concat("title", F.lit(",  ("), F.upper("title"), F.lit(") [x] ,"), F.col("id").cast("string"))), "|"))
_each("html_to_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS value FROM pages""", "pages", "page_id", lambda: T.html_text(F.col("html")))
_each("url_host", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\.', '') AS value FROM pages", "pages", "page_id", lambda: T.host(F.col("url")))
_each("norm_company", "SELECT id, lower(name) AS value FROM d_company", "d_company", "id", lambda: T.company_name(F.concat("name", F.element_at(F.array(F.lit(", Inc."), F.lit(" LLC"), F.lit(" Ltd."), F.lit(""), F.lit("  ")), (F.col("id") % 5 + 1).cast("int")))))
_each("norm_source", "SELECT id, replace(lower(remote_type), '-', '_') AS value FROM d_job_post", "d_job_post", "id", lambda: T.source_key(F.col("remote_type")))
_each("parse_id_list", "SELECT id, id || ',' || (id + 1) AS value FROM d_skill_set", "d_skill_set", "id", lambda: F.array_join(F.transform(T.id_list(F.concat_ws(",", F.col("id"), F.lit(" x"), F.col("id") + 1, F.lit(""))), lambda x: x.cast("string")), ","))
_each("format_percent", "SELECT id, CASE WHEN score % 4 = 0 THEN CAST(score // 4 AS VARCHAR) ELSE printf('%.2f', score / 4) END AS value FROM d_link", "d_link", "id", lambda: T.format_percent(F.col("score") / 4))
_each("percentage", "SELECT id, CASE WHEN score = 0 THEN 0.0 ELSE CAST(floor((7 * 2000 + score) / (2 * score)) AS DOUBLE) / 10 END AS value FROM d_link", "d_link", "id", lambda: percentage(F.lit(7), F.col("score")))
_each("subtract_months", "SELECT id, created_at - INTERVAL 3 MONTH AS value FROM d_job_post", "d_job_post", "id", lambda: F.col("created_at") - F.expr("INTERVAL 3 MONTHS"))
_each("parse_iso_date", "SELECT id, CASE WHEN id % 2 = 0 THEN CAST(created_at AS DATE) END AS value FROM d_job_post", "d_job_post", "id", lambda: F.try_to_date(F.when(F.col("id") % 2 == 0, F.date_format("created_at", "yyyy-MM-dd")).otherwise("no date"), "yyyy-MM-dd"))
_each("iso_format", "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS value FROM d_job_post", "d_job_post", "id", lambda: F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
_each("display_ts", "SELECT id, strftime(created_at, '%b %-d, %-I:%M %p') AS value FROM d_pipeline_log", "d_pipeline_log", "id", lambda: F.date_format("created_at", "MMM d, h:mm a"))
