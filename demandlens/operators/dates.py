"""Dates in searches: words and numbers of a query become ranges of time that reach the scan."""

from __future__ import annotations

import calendar
import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The spellings of months: full names, three letters, and one of four.
MONTHS = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if name} | {"sept": 9}


def words(query: str | None) -> list[str]:
    """The query's words in order, without brackets and repeats; a word is told from another by its folded form."""
    found: dict[str, str] = {}
    for word in re.split(r"[\s,]+", " ".join((query or "").split())):
        word = word.strip(" ;()[]{}")
        if word:
            found.setdefault(word.casefold(), word)
    return list(found.values())


def _day(word: str) -> date | None:
    try:
        return date.fromisoformat(word) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", word) else None
    except ValueError:
        return None


def _year(word: str) -> int | None:
    return int(word) if re.fullmatch(r"[0-9]{4}", word) and word != "0000" else None


def within(column: str, first: date, after: date) -> Column:
    """A half-open range of days, in the column's own type."""
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'{d.isoformat()} 00:00:00'")
    return (F.col(column) >= at(first)) & (F.col(column) < at(after))


def _years(column: str, first: int, after: int) -> Column:
    return within(column, date(first, 1, 1), date(after, 1, 1)) if after <= date.max.year else F.col(column) >= F.expr(f"TIMESTAMP_NTZ'{first}-01-01 00:00:00'")


def is_date(word: str) -> bool:
    """Whether a word is looked for among times: a month's name, a year, something with a date in it, or with a colon."""
    return word.casefold() in MONTHS or re.fullmatch(r"\d{4}", word) is not None or re.search(r"\d{4}-\d{1,2}-\d{1,2}", word) is not None or ":" in word


def date_filter(word: str, columns: list[str]) -> Column | None:
    """Rows of which a time column fits a word; None if the word is no date.

    A year and a day are ranges; a month's name is any year's; what holds a colon or a hyphen stands in the time as text.
    """
    if not is_date(word):
        return None
    found: list[Column] = []
    day, year = _day(word), _year(word)
    for c in columns:
        if ":" in word or "-" in word:
            found.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").contains(word))
        if day:
            found.append(within(c, day, day + timedelta(days=1)))
        if word.casefold() in MONTHS:
            found.append(F.month(c) == MONTHS[word.casefold()])
        if year:
            found.append(_years(c, year, year + 1))
    out = F.lit(False)
    for f in found:
        out = out | f
    return F.coalesce(out, F.lit(False))


def span(tokens: list[str]) -> tuple[date, date] | None:
    """The half-open range of days that the tokens fix together: of their days, years, and months of a fixed year; None if none is fixed.

    Tokens that contradict one another give an empty range.
    """
    days, years = ({x for t in tokens if (x := f(t)) is not None} for f in (_day, _year))
    months = {MONTHS[t.casefold()] for t in tokens if t.casefold() in MONTHS}
    ranges = [(d, d + timedelta(days=1)) for d in days] + [(date(y, 1, 1), date(y + 1, 1, 1)) for y in years if y < date.max.year]
    if len(years) == 1 and max(years) < date.max.year:
        y = max(years)
        ranges += [(date(y, m, 1), date(y + (m == 12), m % 12 + 1, 1)) for m in months]
    if not ranges:
        return None
    first, after = max(a for a, _ in ranges), min(b for _, b in ranges)
    return (first, max(first, after))


def search(rows: DataFrame, query: str | None, texts: list[str], time: str) -> DataFrame:
    """Rows that meet every word of a query, in one of the texts, case ignored, or in the time column; all rows for a query without words.

    Words that no text can hold, here those that are dates when ``texts`` is empty, fix one range of time together, which reaches the scan as a pushed filter.
    """
    tokens = words(query)
    if not texts and tokens and all(is_date(t) for t in tokens) and (fixed := span(tokens)):
        rows = rows.where(within(time, *fixed))
    for token in tokens:
        hit = date_filter(token, [time])
        met = F.lit(False) if hit is None else hit
        for c in texts:
            met = met | F.coalesce(F.lower(c).contains(token.lower()), F.lit(False))
        rows = rows.where(met)
    return rows


def search_any(rows: DataFrame, queries: list[str], texts: list[str], time: str) -> DataFrame:
    """(query, ...) rows that each of the alternatives, joined by OR on the whole, meets: one scan for each, a row once for every query."""
    out = None
    for q in queries:
        some = search(rows, q, texts, time).withColumn("query", F.lit(q))
        out = some if out is None else out.unionByName(some)
    return out if out is not None else rows.limit(0).withColumn("query", F.lit(""))
