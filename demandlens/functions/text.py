"""Text expressions. White space is Unicode's throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
JOB_TYPES = {
    "full time": "Full-time", "full-time": "Full-time", "fulltime": "Full-time", "intern": "Internship", "internship": "Internship", "part time": "Part-time",
    "part-time": "Part-time", "parttime": "Part-time", "contract": "Contract", "temporary": "Temporary", "temp": "Temporary",
}
STOP_WORDS = [
    "a", "an", "and", "for", "in", "of", "or", "the", "to", "with", "skill", "skills", "tool", "tools", "technology", "technologies",
    "engineering", "engineer", "implementation", "implementations", "solution", "solutions",
]
EXPANSIONS = {
    "ai": ["artificial", "intelligence", "machine", "learning", "genai"], "llm": ["large", "language", "models", "model", "generative", "ai"],
    "ml": ["machine", "learning"], "etl": ["extract", "transform", "load", "data"], "db": ["database", "databases"],
    "devops": ["cloud", "infrastructure", "deployment"], "ot": ["operational", "technology", "security", "cybersecurity"], "nas": ["storage", "network", "infrastructure"],
}
SOURCE_HOSTS = {
    "linkedin.com": "LINKEDIN", "joinhandshake.com": "HANDSHAKE", "handshake.com": "HANDSHAKE", "my.greenhouse.io": "GREENHOUSE",
    "boards.greenhouse.io": "GREENHOUSE", "job-boards.greenhouse.io": "GREENHOUSE", "jobs.lever.co": "LEVER",
}
SPECIFIC_SOURCES = ["LINKEDIN", "HANDSHAKE", "GREENHOUSE", "LEVER", "RSS", "API"]
BROADER = ["broader", "broader than", "broaderthan"]
NARROWER = ["narrower", "narrower than", "narrowerthan"]
SPELLINGS = {
    "aws": "AWS", "api": "API", "apis": "APIs", "css": "CSS", "django": "Django", "docker": "Docker", "graphql": "GraphQL", "html": "HTML", "javascript": "JavaScript",
    "kubernetes": "Kubernetes", "machine learning": "Machine Learning", "mysql": "MySQL", "node.js": "Node.js", "postgresql": "PostgreSQL", "python": "Python",
    "react": "React", "rest": "REST", "sql": "SQL", "typescript": "TypeScript",
}
CONFIDENCE = {"high": 0.9, "medium": 0.6, "moderate": 0.6, "low": 0.3}


def collapse(text: Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_name(text: Column) -> Column:
    """Collapsed, without punctuation at the ends, lower-cased; inner blanks before the punctuation stay."""
    return F.lower(F.btrim(collapse(text), F.lit(".,;:|/\\")))


def clean_keyword(text: Column) -> Column:
    return F.btrim(collapse(text), F.lit(" .,;:|/\\"))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def distinct_by(items: Column, key) -> Column:
    """The first of the items of each key, in order; for short lists, since every item is looked up among all keys."""
    return let(items, lambda some: let(F.transform(some, key), lambda keys: F.filter(some, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def clean_aliases(items: Column) -> Column:
    cleaned = F.filter(F.transform(items, clean_keyword), lambda x: F.length(x) > 0)
    return distinct_by(cleaned, normalize_name)


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def job_type(text: Column) -> Column:
    """One of the known labels, else the text itself."""
    bare = collapse(F.regexp_replace(text, "_", " "))
    return F.coalesce(lookup(JOB_TYPES, F.lower(bare)), bare)


# Legal suffixes, tried once each in this order.
SUFFIXES = [", inc.", " inc.", ", llc", " llc", " ltd.", " ltd"]


def company_name(text: Column) -> Column:
    """Lower case, without one legal suffix of each kind, in this order."""
    out = F.lower(collapse(text))
    for suffix in SUFFIXES:
        out = F.trim(F.regexp_replace(out, rf"\Q{suffix}\E$", ""))
    return out


def plain_company(name: str) -> str:
    """The same of a plain text."""
    out = " ".join(name.split()).lower()
    for suffix in SUFFIXES:
        out = out.removesuffix(suffix).strip()
    return out


def source_key(text: Column) -> Column:
    return F.translate(F.lower(collapse(text)), "-", "_")


def slug(text: Column, most: int = 120) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def board_token(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def truncated(text: Column, most: int = 120) -> Column:
    return F.rtrim(F.substring(collapse(text), 1, most))


def tokens(text: Column) -> Column:
    """Distinct words of two or more characters, stop words left out."""
    parts = F.split(F.lower(text), "[^a-z0-9+#.]+")
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) > 1) & ~x.isin(STOP_WORDS)))


def expanded_tokens(text: Column) -> Column:
    """The tokens with the words that their abbreviations stand for."""
    table = F.create_map(*[x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    short = F.array(*map(F.lit, EXPANSIONS))
    more = lambda t: F.flatten(F.transform(F.array_intersect(t, short), lambda x: F.try_element_at(table, x)))
    return let(tokens(text), lambda t: F.array_union(t, more(t)))


def display_name(text: Column) -> Column:
    """Known spellings; a name all in one case gets capitals; others stay."""
    def spelt(bare: Column) -> Column:
        def shown(low: Column) -> Column:
            cased = bare.rlike(r"\p{L}") & ((bare == low) | (bare == F.upper(bare))) & (low != F.upper(bare))
            capital = F.array_join(F.transform(F.split(F.trim(bare), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")
            return F.coalesce(lookup(SPELLINGS, low), F.when(cased, capital).otherwise(bare))

        return let(F.lower(bare), shown)

    return let(F.btrim(collapse(text), F.lit(".,;:|/\\<>")), spelt)


def compound_names(text: Column) -> Column:
    """The text outside parentheses and each short one inside that could stand alone, the first of each name."""
    bare = F.btrim(collapse(text), F.lit(".,;:|/\\<>"))
    inner = F.transform(F.regexp_extract_all(bare, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.btrim(collapse(x), F.lit(".,;:|/\\<>")))
    inner = F.filter(inner, lambda x: x.rlike("[A-Za-z0-9]") & ~x.contains(",") & ~x.contains(":") & (F.size(F.split(x, " ")) <= 4))
    outer = F.filter(F.array(F.trim(F.regexp_replace(bare, r"\([^()]*\)", " "))), lambda x: x != "")
    parts = F.concat(outer, inner)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.filter(F.array(bare), lambda x: x != ""))
    names = F.filter(F.transform(parts, display_name), lambda x: normalize_name(x) != "")
    return distinct_by(names, normalize_name)


def evidence_text(text: Column) -> Column:
    """White space collapsed, in lower case; empty for null."""
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def search_tokens(text: Column) -> Column:
    parts = F.transform(F.split(collapse(text), r"(?U)[\s,]+"), lambda x: F.btrim(x, F.lit("()[]{}")))
    return distinct_by(F.filter(parts, lambda x: F.length(x) > 0), F.lower)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags become blanks; the five named entities are read."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(out)


def clean_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0), "\n")


def split_labels(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[\r\n|;]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def host(url: Column) -> Column:
    """The host of a URL, with or without a scheme; without user, port, a last dot and www."""
    bare = F.trim(url)
    full = F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    place = F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    name = F.rtrim(F.element_at(F.split(F.element_at(F.split(place, "@"), -1), ":"), 1), F.lit("."))
    return F.regexp_replace(name, r"^www\.", "")


def detect_source(url: Column, resource: Column | None = None) -> Column:
    """The source whose domain the host is or lies under; else the declared resource if it is a specific one; else a career site."""
    name, out = host(url), F.lit(None).cast("string")
    for domain, source in reversed(SOURCE_HOSTS.items()):
        out = F.when((name == domain) | name.endswith(f".{domain}"), source).otherwise(out)
    declared = F.when(resource.isin(SPECIFIC_SOURCES), resource) if resource is not None else F.lit(None).cast("string")
    return F.coalesce(out, declared, F.lit("CAREER_SITE"))


def relation_type(text: Column) -> Column:
    key = F.lower(F.trim(text))
    return F.when(key.isin(BROADER), "broader").when(key.isin(NARROWER), "narrower").otherwise("related")


def confidence(text: Column) -> Column:
    """A label's value or the number itself, between 0 and 1; null if neither."""
    key = F.lower(F.trim(text))
    value = F.coalesce(lookup(CONFIDENCE, key), key.try_cast("double"))
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def id_list(text: Column) -> Column:
    """The integers of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())


def format_percent(value: Column) -> Column:
    return F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(F.format_string("%.2f", value))


def whole_word(text: Column, word: str) -> Column:
    escaped = "".join("\\" + c if not c.isalnum() else c for c in word.lower())
    return F.lower(text).rlike(rf"\b{escaped}\b")


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs in a text, without overlap; 0 for an empty term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.coalesce(F.floor(gone / F.nullif(F.length(term), F.lit(0))), F.lit(0)).cast("long")
