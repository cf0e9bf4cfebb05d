"""Parsers of given pages and payloads: search cards, job pages, board postings, inline jobs, CSV files of a taxonomy."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.functions import text as T

# Fixed values.
JOB_TYPE_LABELS = {
    "Full-time": r"\bfull[\s-]?time\b", "Part-time": r"\bpart[\s-]?time\b", "Internship": r"\binternship\b|\bco[\s-]?op\b", "Contract": r"\bcontract(or)?\b", "Temporary": r"\btemp(orary)?\b",
}
BOARD_LABELS = JOB_TYPE_LABELS | {"Internship": r"\bintern(ship)?\b|\bco[\s-]?op\b"}
NAMED_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def unescaped(text: Column) -> Column:
    """Numeric entities in decimal or hexadecimal, and the usual named ones; the ampersand last, so nothing is read twice."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), F.lit(1)))
    code = lambda x: F.when(F.lower(x).startswith("x"), F.conv(F.substring(x, 2, 9), 16, 10)).otherwise(x).cast("int")
    wide = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    out = F.aggregate(F.filter(found, lambda x: (code(x) > 0) & (code(x) < 0x110000)), text, lambda s, x: F.replace(s, F.concat(F.lit("&#"), x, F.lit(";")), wide(code(x))))
    for name, char in NAMED_ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def page_text(html: Column, breaks: bool = False) -> Column:
    """Text of a piece of a page, tags before entities; with ``breaks`` the ends of blocks end lines."""
    out = F.coalesce(html, F.lit(""))
    if breaks:
        out = F.regexp_replace(out, r"(?i)</(p|li|div|br|ul|ol|h\d)>", "\n")
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = unescaped(F.regexp_replace(out, r"<[^>]+>", " "))
    if not breaks:
        return T.collapse(out)
    return F.array_join(F.filter(F.transform(F.split(out, r"\r\n|[\r\n]"), T.collapse), lambda x: x != ""), "\n")


def board_text(html: Column) -> Column:
    """Text of a board's content, which is escaped once more: entities before tags."""
    return T.collapse(F.regexp_replace(unescaped(F.coalesce(html, F.lit(""))), r"<[^>]+>", " "))


def class_text(html: Column, name: str, breaks: bool = False) -> Column:
    """Text of the first element whose class holds a name, up to the next end of a tag."""
    return page_text(F.regexp_extract(html, rf"(?is)<[^>]+class=[\"'][^\"']*\Q{name}\E[^\"']*[\"'][^>]*>(.*?)</[^>]+>", 1), breaks)


def tag_text(html: Column, tag: str) -> Column:
    return page_text(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))


def time_value(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<time[^>]+datetime=[\"']([^\"']+)[\"']", 1)


def job_label(text: Column, labels: dict[str, str] = JOB_TYPE_LABELS) -> Column:
    """The first kind of job that a text names, in the order of the patterns; empty without one."""
    return F.coalesce(*[F.when(F.lower(text).rlike(p), label) for label, p in labels.items()], F.lit(""))


def job_id(url: Column) -> Column:
    found = [F.regexp_extract(url, p, 1) for p in (r"/jobs/view/(\d+)", r"/jobs-guest/jobs/api/jobPosting/(\d+)", r"[?&]currentJobId=(\d+)")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def search_cards(pages: DataFrame) -> DataFrame:
    """(page_id, job_id, url, title, company, location, job_type, posted_at) of every card of pages (page_id, html), each job of a page once."""
    blocks = F.split("html", r"(?i)(?=<[^>]+data-entity-urn=[\"']urn:li:jobPosting:\d+[\"'])")
    rows = pages.select("page_id", F.posexplode(blocks).alias("at", "b"))
    found = F.regexp_extract("b", r"(?i)data-entity-urn=[\"']urn:li:jobPosting:(\d+)[\"']", 1)
    b = F.col("b")
    cards = rows.withColumn("job_id", found).where("job_id <> ''").select(
        "page_id", "at", "job_id", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), "job_id", F.lit("/")).alias("url"), class_text(b, "base-search-card__title").alias("title"),
        class_text(b, "base-search-card__subtitle").alias("company"), class_text(b, "job-search-card__location").alias("location"), job_label(page_text(b)).alias("job_type"), time_value(b).alias("posted_at"),
    )
    rest = [c for c in cards.columns if c not in ("page_id", "job_id", "at")]
    return cards.groupBy("page_id", "job_id").agg(F.min(F.struct("at", *rest)).alias("x")).select("page_id", "job_id", *[F.nullif(F.col(f"x.{c}"), F.lit("")).alias(c) for c in rest])


def job_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, company, location, job_type, description, posted_at, criteria) of pages (page_id, html)."""
    h = F.col("html")
    items = F.regexp_extract_all(h, F.lit(r"(?is)<li[^>]*class=[\"'][^\"']*description__job-criteria-item[^\"']*[\"'][^>]*>(.*?)</li>"), F.lit(1))
    pairs = F.transform(items, lambda x: F.struct(F.lower(class_text(x, "description__job-criteria-subheader")).alias("key"), class_text(x, "description__job-criteria-text").alias("value")))
    pairs = F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != ""))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.lit(1 << 20)), lambda o: o["key"] == e["key"]))
    out = pages.withColumn("criteria", F.map_from_entries(last))
    either = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    top = F.element_at(F.split(h, r"(?i)class=[\"'][^\"']*show-more-less-html__markup[^\"']*[\"']"), 1)
    return out.select(
        "page_id", either(class_text(h, "top-card-layout__title"), tag_text(h, "h1")).alias("title"), either(class_text(h, "topcard__org-name-link"), class_text(h, "topcard__flavor--black-link")).alias("company"),
        either(class_text(h, "topcard__flavor--bullet")).alias("location"), either(F.try_element_at("criteria", F.lit("employment type")), job_label(page_text(top))).alias("job_type"),
        either(class_text(h, "show-more-less-html__markup", True)).alias("description"), either(time_value(h)).alias("posted_at"), "criteria",
    )


BOARD = "struct<id: long, title: string, company_name: string, absolute_url: string, content: string, updated_at: string, first_published: string, internal_job_id: long, requisition_id: string>"


def board_jobs(payloads: DataFrame, default_job_type: str | None = None) -> DataFrame:
    """Jobs of board payloads (board_token, payload and, if there, id, which is given back as ``key``), JSON objects with a list ``jobs``; a location is a text or an object with a name."""
    raw = F.explode(F.from_json(F.get_json_object("payload", "$.jobs"), "array<string>"))
    rows = payloads.select("board_token", F.col("id").alias("key") if "id" in payloads.columns else F.lit(None).cast("long").alias("key"), raw.alias("raw")).withColumn("j", F.from_json("raw", BOARD))
    place = F.coalesce(F.get_json_object("raw", "$.location.name"), F.when(~F.get_json_object("raw", "$.location").startswith("{"), F.get_json_object("raw", "$.location")))
    company = F.coalesce(F.nullif(F.col("j.company_name"), F.lit("")), F.initcap(F.replace("board_token", F.lit("-"), F.lit(" "))))
    rows = rows.withColumns({"location": place, "company_name": company, "description": board_text(F.col("j.content"))})
    searchable = F.concat_ws(" ", F.col("j.title"), "description", "location", "company_name")
    kind = F.lit(default_job_type) if default_job_type else job_label(searchable, BOARD_LABELS)
    return rows.select(
        "key", "board_token", F.col("j.id").cast("string").alias("external_id"), "j.title", "company_name", F.col("j.absolute_url").alias("source_url"), "location", "description",
        "j.updated_at", "j.first_published", kind.alias("job_type"),
    )


def iso_time(text: Column) -> Column:
    """An ISO date or time, in UTC where it names no zone; null if it can't be read."""
    bare = F.trim(text)
    ok = bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    zone = F.regexp_replace(F.regexp_replace(bare, "Z$", "+00:00"), r"(:.*[+-]\d{2})(\d{2})$", "$1:$2")
    zone = F.regexp_replace(zone, r"([T ]\d{2}:\d{2})([+-]|$)", "$1:00$2")
    whole = F.when(ok & zone.rlike(r"[+-]\d{2}:\d{2}$") & zone.rlike(":.*[+-]"), zone).when(ok, F.concat(zone, F.when(zone.rlike(":"), "+00:00").otherwise(" 00:00:00+00:00")))
    return whole.try_cast("timestamp")


#: Days of the windows in which a job was posted.
WINDOWS = {"r86400": 1, "past_24_hours": 1, "r604800": 7, "past_week": 7, "r2592000": 30, "past_month": 30}


def board_filter(keywords: list[str], job_types: list[str], remote_only: bool, posted_within: str | None, as_of: str) -> Column:
    """A condition over board jobs; a type that isn't known and a time that can't be read pass."""
    out = F.lit(True)
    if keywords:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.coalesce(F.lower("title").contains(k.lower()), F.lit(False))
        out = out & hit
    if job_types:
        out = out & ((F.coalesce("job_type", F.lit("")) == "") | F.lower("job_type").isin([t.lower() for t in job_types]))
    if remote_only:
        out = out & F.coalesce(F.lower("location").contains("remote"), F.lit(False))
    days = WINDOWS.get((posted_within or "").strip().lower().replace(" ", "_"))
    if days:
        posted = iso_time(F.coalesce(F.nullif("first_published", F.lit("")), "updated_at"))
        out = out & F.coalesce(posted >= F.expr(f"TIMESTAMP'{as_of} UTC' - INTERVAL {days} DAYS"), F.lit(True))
    return out


def inline_jobs(sources: DataFrame) -> DataFrame:
    """(source_id, ord, raw) of the jobs that a source's crawl_config (JSON) lists itself, under raw_jobs or else jobs."""
    listed = F.coalesce(*[F.from_json(F.get_json_object("crawl_config", f"$.{k}"), "array<string>") for k in ("raw_jobs", "jobs")])
    return sources.select("source_id", F.posexplode(listed).alias("ord", "raw"))


def picked_window(items: Column, offset: Column, most: int) -> Column:
    """The next ``most`` items of a list from an offset of any size on, around its end, each once."""
    n = F.size(items)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most)) - 1), lambda i: F.get(items, ((offset + i) % n).cast("int")))).otherwise(F.array().cast("array<string>"))


def search_combinations(sources: DataFrame, most: int = 60) -> DataFrame:
    """(source_id, ord, keyword, location, workplace, job_type): all combinations of a source's lists, an empty list standing for any, at most ``most``."""
    lists = ["keywords", "locations", "workplaces", "job_types"]
    rows = sources.select("source_id", *[F.when(F.size(c) > 0, F.array_distinct(c)).otherwise(F.array(F.lit(""))).alias(c) for c in lists])
    total = F.size("keywords") * F.size("locations") * F.size("workplaces") * F.size("job_types")
    rows = rows.withColumn("ord", F.explode(F.sequence(F.lit(0), F.least(total, F.lit(most)) - 1)))
    after = F.lit(1)
    picks = {}
    for c in reversed(lists):
        picks[c] = F.get(c, (F.floor(F.col("ord") / after) % F.size(c)).cast("int"))
        after = after * F.size(c)
    return rows.select("source_id", "ord", picks["keywords"].alias("keyword"), picks["locations"].alias("location"), picks["workplaces"].alias("workplace"), picks["job_types"].alias("job_type"))


def picked_language(texts: Column) -> Column:
    """Of a map from languages to texts: English, its variants, else the first of all."""
    tried = [F.nullif(F.try_element_at(texts, F.lit(k)), F.lit("")) for k in ("en", "en-us", "en-gb")]
    return F.coalesce(*tried, F.try_element_at(F.filter(F.map_values(texts), lambda x: x != ""), F.lit(1)))


def link_uris(links: Column, keys: list[str]) -> Column:
    """The uris under the given keys of a map to lists of (uri, title), in order of the keys."""
    none = F.array().cast("array<string>")
    found = [F.coalesce(F.transform(F.try_element_at(links, F.lit(k)), lambda x: x["uri"]), none) for k in keys]
    return F.filter(F.concat(*found), lambda x: x != "")


def header_map(headers: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Which column stands for each field: a header equal to an alias, else one that holds it or is held by it, the first of each field."""
    folded = {h: " ".join(h.split()).lower() for h in headers}
    exact = {a: f for f, names in aliases.items() for a in names}
    out: dict[str, str] = {}
    for header, key in folded.items():
        near = next((f for f, names in aliases.items() for a in names if a in key or key in a), None) if key else None
        if (name := exact.get(key) or near) and name not in out:
            out[name] = header
    return out


def read_taxonomy_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """A CSV file's rows under the names of the fields, trimmed, blank cells null; ``ord`` orders rows of a file as they stand.

    The delimiter is told from the file's head, the only part that the driver reads. A required field that no header names raises.
    """
    head = spark.read.text(path).limit(5).collect()  # a few lines
    sample = "\n".join(r["value"] for r in head).lstrip("﻿")[:4096]
    try:
        mark = csv.Sniffer().sniff(sample, ",;\t|").delimiter
    except csv.Error:
        mark = ","
    raw = spark.read.csv(path, header=True, sep=mark, multiLine=True, quote='"', escape='"')
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    names = header_map(raw.columns, aliases)
    if lacking := [f for f in required if f not in names]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    cells = [F.nullif(F.trim(F.col(f"`{h}`")), F.lit("")).alias(f) for f, h in names.items()]
    return raw.select(*cells, F.monotonically_increasing_id().alias("ord"))


def docx_text(content: bytes) -> str:
    """Paragraph texts of a word-processor file's main part, a line each; what the file doesn't hold is empty."""
    import io
    import zipfile
    from xml.etree import ElementTree

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError):
        return ""
    lines = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p")]
    return "\n".join(x for x in lines if x.strip())


def uploads(spark: SparkSession, path: str, most_bytes: int = 5 << 20) -> DataFrame:
    """(path, text, error) of uploaded files: plain and marked-down text in UTF-8, else Latin-1, and word-processor files.

    Files of other kinds and those above the bound are told as errors without being read.
    """
    import pandas as pd

    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = spark.read.format("binaryFile").load(path).withColumn("kind", kind)
    error = F.when(~F.col("kind").isin("txt", "md", "docx"), "unsupported type").when(F.col("length") > most_bytes, "too large")

    @F.pandas_udf("string")
    def read(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for k, c in zip(kinds, contents, strict=True):
            if k == "docx":
                out.append(docx_text(bytes(c)))
                continue
            try:
                out.append(bytes(c).decode("utf-8-sig"))
            except UnicodeDecodeError:
                out.append(bytes(c).decode("latin-1"))
        return pd.Series(out)

    rows = files.withColumn("error", error)
    good = rows.where("error IS NULL").select("path", T.clean_lines(read("kind", "content")).alias("text"), "error")
    return good.unionByName(rows.where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("text"), "error"))
