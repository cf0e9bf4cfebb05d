"""Raw postings to canonical jobs, and the filters of a source. Raw postings are JSON objects in a text column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions import text as T

# Fixed values.
EMPTY = ["", "-", "--", "—", "n/a", "na", "none", "null", "not applicable", "not specified", "unknown", "undefined"]
JOB_TYPES = {
    "full time": "FULL_TIME", "full-time": "FULL_TIME", "fulltime": "FULL_TIME", "permanent": "FULL_TIME", "part time": "PART_TIME", "part-time": "PART_TIME",
    "parttime": "PART_TIME", "intern": "INTERNSHIP", "internship": "INTERNSHIP", "co op": "INTERNSHIP", "co-op": "INTERNSHIP", "contract": "CONTRACT",
    "contractor": "CONTRACT", "temporary": "TEMPORARY", "temp": "TEMPORARY",
}
REMOTE = ["remote", "work from home", "wfh", "home based", "home-based"]
HYBRID = ["hybrid", "hybrid remote"]
ON_SITE = ["onsite", "on site", "on-site", "in office", "office"]
UNITED_STATES = ["united states", "us", "usa", "u.s.", "u.s.a."]
TYPE_PATTERNS = [
    (r"\b(intern|internship|co[\s-]?op)\b", "INTERNSHIP"), (r"\b(part[\s-]?time)\b", "PART_TIME"), (r"\b(contract|contractor)\b", "CONTRACT"),
    (r"\b(temp|temporary)\b", "TEMPORARY"), (r"\b(full[\s-]?time|fulltime)\b", "FULL_TIME"),
]
SECTIONS = {
    "about": ["about", "about_role", "aboutRole"], "responsibilities": ["responsibilities", "what_you_will_do", "whatYouWillDo"],
    "requirements": ["requirements", "qualifications", "required_skills"],
    "minimum_qualifications": ["minimum_qualifications", "minimumQualifications", "minimum_qualification"],
    "preferred_qualifications": ["preferred_qualifications", "preferredQualifications", "preferred_qualification"],
}
FIELDS = {
    "source_url": ["source_url", "url", "jobUrl", "job_url", "absolute_url", "hostedUrl", "hosted_url", "apply_url", "jobPostingUrl", "link"],
    "external_id": ["external_id", "id", "job_id", "jobId", "jobPostingId", "gh_jid", "lever_id"],
    "company_name": ["company_name", "company", "companyName", "organization", "employer", "employerName", "employer_name"],
    "title": ["title", "jobTitle", "job_title", "position", "positionTitle", "name", "text"],
    "job_type": ["job_type", "jobType", "employmentType", "type"],
    "employment_type": ["employment_type", "employmentType", "commitment", "job_type", "jobType", "type"],
    "remote_type": ["remote_type", "remoteType", "workplaceType", "workplace_type", "workplace", "remote"],
    "location": ["location", "formattedLocation", "formatted_location", "workplaceLocation", "workplace_location", "locations"],
    "description": ["description", "descriptionPlain", "description_plain", "jobDescription", "job_description", "content", "body"],
    "posted_at": ["posted_at", "postedAt", "datePosted", "created_at", "published_at", "first_published"],
}


def clean(text: Column) -> Column:
    """White space collapsed; null for the words that stand for nothing."""
    bare = T.collapse(text)
    return F.when(~F.lower(bare).isin(EMPTY), bare)


def job_type(text: Column) -> Column:
    """One of the known types, else the text in capitals with underscores."""
    bare = clean(text)
    key = T.collapse(F.translate(F.lower(bare), "_/.", "   "))
    return F.coalesce(T.lookup(JOB_TYPES, key), F.translate(F.upper(bare), " -", "__"))


def location(text: Column) -> Column:
    bare = clean(text)
    key = T.collapse(F.translate(F.lower(bare), "_", " "))
    return (
        F.when(key.isin(REMOTE) | key.contains("work from home") | key.startswith("remote"), "Remote")
        .when(key.isin(HYBRID), "Hybrid").when(key.isin(ON_SITE), "On-site").otherwise(bare)
    )


def fields_of(raw: Column) -> Column:
    """A JSON object's fields as texts, read once; objects and lists stay JSON."""
    return F.from_json(raw, "map<string,string>")


def first_value(fields: Column, keys: list[str]) -> Column:
    """The first of the fields that says something; objects and lists always do."""
    names = F.filter(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.try_element_at(fields, k).rlike(r"^\s*[\[{]"), F.lit(False)) | clean(F.try_element_at(fields, k)).isNotNull())
    return F.try_element_at(fields, F.try_element_at(names, F.lit(1)))


def place(value: Column) -> Column:
    """Where a job is, from a text, an object with a name, a list of such, or true for remote."""
    named = lambda v: F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in ("name", "location", "city", "display_name")])
    bare = lambda v: F.when(v.rlike(r"^\s*\{"), named(v)).when(v == "true", "Remote").when(v == "false", None).otherwise(v)
    items = F.transform(F.from_json(value, "array<string>"), lambda x: clean(bare(x)))
    joined = F.array_join(F.filter(items, lambda x: x.isNotNull()), ", ")
    return location(F.when(value.rlike(r"^\s*\["), F.nullif(joined, F.lit(""))).otherwise(bare(value)))


def sections(fields: Column) -> Column:
    """A map of the posting's sections: those given as such, then the five known ones under their other names, which win."""
    given = F.from_json(F.try_element_at(fields, F.lit("sections")), "map<string,string>")
    kept = F.filter(F.map_entries(F.coalesce(given, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: clean(e["value"]).isNotNull())
    own = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), clean(e["value"]).alias("value")))
    named = F.array(*[F.struct(F.lit(k).alias("key"), clean(first_value(fields, v)).alias("value")) for k, v in SECTIONS.items()])
    named = F.filter(named, lambda e: e["value"].isNotNull())
    of_name = lambda key: F.try_element_at(F.transform(F.filter(named, lambda n: n["key"] == key), lambda n: n["value"]), F.lit(1))
    over = F.transform(own, lambda e: F.struct(e["key"].alias("key"), F.coalesce(of_name(e["key"]), e["value"]).alias("value")))
    new = F.filter(named, lambda n: ~F.exists(own, lambda e: e["key"] == n["key"]))
    return F.map_from_entries(F.concat(over, new))


def infer_job_type(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), label) for p, label in TYPE_PATTERNS])


def canonicalize(rows: DataFrame) -> DataFrame:
    """rows (raw, source_name, default_company, default_job_type, filters_types) with the canonical fields beside them.

    The type of a job is given, inferred from its texts, or, unless its source filters by type, the source's default.
    """
    raw, fields = F.col("raw"), F.col("_fields")
    staged = rows.withColumn("_fields", fields_of(raw)).withColumns({k: first_value(fields, v) for k, v in FIELDS.items()}).withColumn("sections", sections(fields)).drop("_fields")
    staged = staged.withColumns({k: place(F.col(k)) if k in ("location", "remote_type") else clean(F.col(k)) for k in FIELDS})
    texts = F.map_values("sections")
    staged = staged.withColumn("description", F.coalesce("description", F.nullif(F.array_join(texts, "\n\n"), F.lit(""))))
    searchable = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.array_join(texts, " "))
    default = F.coalesce(job_type(F.get_json_object(raw, "$.metadata.default_job_type")), job_type(F.get_json_object(raw, "$.metadata.default_employment_type")), job_type(F.col("default_job_type")))
    kind = F.coalesce(job_type(F.col("employment_type")), job_type(F.col("job_type")), infer_job_type(searchable), F.when(~F.coalesce("filters_types", F.lit(False)), default))
    return staged.withColumns({"employment_type": kind, "job_type": kind, "company_name": F.coalesce("company_name", clean(F.col("default_company")), clean(F.col("source_name")))})


def missing_fields(rows: DataFrame) -> DataFrame:
    """rows with ``missing``: title, company and one of URL and external id, as far as a payload lacks them."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    lacks = [F.when(blank("title"), "title"), F.when(blank("company_name"), "company_name"), F.when(blank("source_url") & blank("external_id"), "source_url_or_external_id")]
    return rows.withColumn("missing", F.array_join(F.filter(F.array(*lacks), lambda x: x.isNotNull()), ", "))


# --- filters of a source: settings are lists of plain texts


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """Does one of the keywords stand in a lower-case text as whole words; co-op is also coop and co op."""
    def one(keyword: str) -> Column:
        key = " ".join(keyword.lower().split())
        if key == "co-op":
            return text.rlike(r"\bco[\s-]?op\b")
        return T.whole_word(text, key) if key else F.lit(False)

    return reduce(Column.__or__, map(one, keywords), F.lit(False))


def location_matches(where: Column, wanted: list[str]) -> Column:
    """Names of the country take every place; two letters stand between delimiters, longer names anywhere."""
    names = {" ".join(w.lower().replace("_", " ").split()) for w in wanted if w.strip()}
    if not names or names & set(UNITED_STATES):
        return F.lit(True)
    low = F.lower(F.coalesce(where, F.lit("")))
    one = lambda n: low.rlike(rf"(^|[,\s])\Q{n}\E($|[,\s(])") if len(n) == 2 else low.contains(n)
    return (low != "") & reduce(Column.__or__, map(one, sorted(names)))


def workplace_matches(remote_type: Column, where: Column, description: Column, wanted: list[str]) -> Column:
    """Remote and hybrid stand somewhere in the texts; on site is neither. All three are no filter."""
    keys = {" ".join(w.lower().replace("_", " ").split()) for w in wanted}
    kinds = {"remote" for k in keys if k in REMOTE[:3]} | {"hybrid" for k in keys if k == "hybrid"} | {"on-site" for k in keys if k in ON_SITE}
    if not kinds or len(kinds) == 3:
        return F.lit(True)
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (remote_type, where, description)]))
    out = F.lit(False)
    for kind in ("remote", "hybrid"):
        if kind in kinds:
            out = out | text.contains(kind)
    return out | ~(text.contains("remote") | text.contains("hybrid")) if "on-site" in kinds else out


def job_type_matches(employment_type: Column, kind: Column, wanted: list[str]) -> Column:
    names = [w for w in wanted if " ".join(w.split()).lower() not in EMPTY]
    if not names:
        return F.lit(True)
    allowed = F.array(*[job_type(F.lit(w)) for w in names])
    return F.coalesce(F.arrays_overlap(F.filter(F.array(job_type(employment_type), job_type(kind)), lambda x: x.isNotNull()), allowed), F.lit(False))


def source_filter(settings: dict[str, list[str]]) -> Column:
    """One condition over canonical jobs: company, included and excluded keywords, location, workplace, type."""
    texts = ["title", "company_name", "location", "description"]
    searchable = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in texts], F.array_join(F.map_values("sections"), " ")))
    out = F.lit(True)
    if companies := settings.get("target_companies"):
        out = out & F.coalesce(T.company_name(F.coalesce("company_name", F.lit(""))).isin(*[T.plain_company(c) for c in companies]), F.lit(False))
    if included := settings.get("include_keywords"):
        out = out & any_keyword(searchable, included)
    if excluded := settings.get("exclude_keywords"):
        out = out & ~any_keyword(searchable, excluded)
    out = out & location_matches(F.col("location"), settings.get("locations", [])) & workplace_matches(F.col("remote_type"), F.col("location"), F.col("description"), settings.get("workplace_types", []))
    return out & job_type_matches(F.col("employment_type"), F.col("job_type"), settings.get("job_types", []))


def config_bool(config: Column, keys: list[str], default: bool = False) -> Column:
    """A switch in a JSON object under the first of the names that is there."""
    value = F.coalesce(*[F.get_json_object(config, f"$.{k}") for k in keys])
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(default))


def merged_config(low: Column, high: Column) -> Column:
    """Two maps as one, the second's values winning."""
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)
