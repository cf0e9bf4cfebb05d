"""Settings of sources as texts: lists of values, codes of a site's search, and ids that only stand for one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.sources.parsers import job_id

# Fixed values.
PLACEHOLDERS = ["1234567890", "0000000000", "1111111111"]
JOB_TYPE_CODES = {
    "full time": "F", "full-time": "F", "fulltime": "F", "full_time": "F", "f": "F", "part time": "P", "part-time": "P", "parttime": "P", "part_time": "P", "p": "P", "contract": "C", "contractor": "C", "c": "C",
    "temporary": "T", "temp": "T", "t": "T", "internship": "I", "intern": "I", "i": "I", "volunteer": "V", "v": "V", "other": "O", "o": "O",
}
WORKPLACE_CODES = {"on site": "1", "onsite": "1", "on-site": "1", "remote": "2", "hybrid": "3"}
DATE_CODES = {
    "r86400": "r86400", "24h": "r86400", "24 hours": "r86400", "past 24 hours": "r86400", "last 24 hours": "r86400", "day": "r86400", "today": "r86400", "r604800": "r604800", "week": "r604800", "past week": "r604800",
    "last week": "r604800", "7 days": "r604800", "r2592000": "r2592000", "month": "r2592000", "past month": "r2592000", "last month": "r2592000", "30 days": "r2592000", "any": "", "any time": "", "all": "",
}
SORT_CODES = {"dd": "DD", "date": "DD", "date posted": "DD", "newest": "DD", "newest first": "DD", "latest": "DD", "r": "R", "relevance": "R", "relevant": "R", "most relevant": "R"}


def split_values(text: Column, lines: bool = True) -> Column:
    """The values of a text between commas, and ends of lines unless ``lines`` is off, white space collapsed, the first of each, case ignored; none of a null."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\r\n]" if lines else ","), T.collapse)
    return T.distinct_by(F.filter(parts, lambda x: x != ""), F.lower)


def _key(text: Column) -> Column:
    return T.collapse(F.replace(F.lower(text), F.lit("_"), F.lit(" ")))


def job_type_code(text: Column) -> Column:
    return F.coalesce(T.lookup(JOB_TYPE_CODES, _key(text)), F.lit(""))


def workplace_code(text: Column) -> Column:
    return F.coalesce(T.lookup(WORKPLACE_CODES, _key(text)), F.lit(""))


def date_code(text: Column) -> Column:
    """A window's code; a word that isn't known stays as it is."""
    return F.coalesce(T.lookup(DATE_CODES, _key(text)), F.trim(text), F.lit(""))


def sort_code(text: Column) -> Column:
    return F.coalesce(T.lookup(SORT_CODES, _key(text)), F.lit(""))


def placeholder(*fields: Column) -> Column:
    """Is one of the fields an id that stands for none: the job id of a URL, else all digits of the text."""
    digits = lambda x: F.coalesce(F.nullif(job_id(x), F.lit("")), F.regexp_replace(x, "[^0-9]", ""))
    return F.exists(F.transform(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), digits), lambda d: d.isin(PLACEHOLDERS))
