"""Elements of HTML pages as rows, by a table function that keeps the open elements on a stack.

Each element spans from its ``start`` to its ``stop`` in the order of tags and texts, so what lies inside another lies within its span, and
questions about pages are joins and groups over spans.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.functions.text import collapse

#: Elements that hold nothing, and for some elements those that one of them, opened inside, ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "h4": {"p"}, "ul": {"p"}, "ol": {"p"}, "div": {"p"}, "section": {"p"}, "article": {"p"}, "table": {"p"},
}
#: An opening tag ends none beyond the nearest of these.
WALLS = frozenset("html body table ul ol dl select article section div nav td th".split())
SHAPE = "start int, stop int, parent int, depth int, tag string, attributes map<string,string>, text string"


class _Stack(HTMLParser):
    """Rows of SHAPE; texts have the tag ``#text`` and no attributes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, attributes: dict[str, str] | None, text: str | None) -> int:
        at = len(self.rows)
        self.rows.append([at, at, self.open[-1] if self.open else None, len(self.open), tag, attributes, text])
        return at

    def _close(self, down_to: int) -> None:
        for at in self.open[down_to:]:
            self.rows[at][1] = len(self.rows) - 1
        del self.open[down_to:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended = ENDS.get(tag, ())
        for k in reversed(range(len(self.open))):
            name = self.rows[self.open[k]][4]
            if name in ended:
                self._close(k)
                break
            if name in WALLS:
                break
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        at = self._add(tag, first, None)
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in reversed(range(len(self.open))):
            if self.rows[self.open[k]][4] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add("#text", None, data)


def parsed(html: str | None) -> list[tuple]:
    """Rows of SHAPE; an element still open at the end of the page ends there, and an end tag without an open element is passed over."""
    stack = _Stack()
    stack.feed(html or "")
    stack.close()
    stack._close(0)
    return [tuple(r) for r in stack.rows]


class PageElements:
    """Table function of one page's HTML; null and empty pages have no elements."""

    def eval(self, html: str):
        yield from parsed(html)


def register(spark: SparkSession, name: str = "page_elements") -> None:
    spark.udtf.register(name, F.udtf(PageElements, returnType=SHAPE))


def elements(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, ...SHAPE) of pages (page_id, html)."""
    spark = pages.sparkSession
    register(spark)
    return spark.sql(f"SELECT p.{key}, e.* FROM {{pages}} p, LATERAL page_elements(p.html) e", pages=pages)


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.try_element_at("attributes", F.lit("class")), F.lit("")), r"\s+"), name)


def texts_of(found: DataFrame, every: DataFrame, key: str = "page_id") -> DataFrame:
    """found, elements of a page, with ``inner``: the texts inside each in order, white space collapsed; scripts and styles are no text."""
    hidden = every.where("tag IN ('script', 'style')").select(F.col(key).alias("_hk"), F.col("start").alias("_hidden"))
    shown = every.where("tag = '#text'").select(F.col(key).alias("_k"), F.col("start").alias("_at"), F.col("parent").alias("_parent"), F.col("text").alias("_text"))
    shown = shown.join(hidden, (F.col("_k") == F.col("_hk")) & (F.col("_parent") == F.col("_hidden")), "left_anti")
    met = found.join(shown, (found[key] == F.col("_k")) & (F.col("_at") > found["start"]) & (F.col("_at") <= found["stop"]), "left")
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda x: x["_text"]), " ")
    words = met.groupBy(found[key].alias(key), found["start"].alias("start")).agg(collapse(inner).alias("inner"))
    return found.join(words, [key, "start"])


def job_cards(every: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, job_id, title, company, location, posted_at): the first card of each job of a search page, by its elements."""
    ident = F.regexp_extract(F.coalesce(F.try_element_at("attributes", F.lit("data-entity-urn")), F.lit("")), r"^urn:li:jobPosting:(\d+)$", 1)
    cards = every.withColumn("job_id", ident).where("job_id <> ''").groupBy(key, "job_id").agg(F.min(F.struct("start", "stop")).alias("c"))
    out = cards.select(F.col(key), "job_id", F.col("c.start").alias("from_"), F.col("c.stop").alias("to_"))
    wanted = {"title": "base-search-card__title", "company": "base-search-card__subtitle", "location": "job-search-card__location"}
    for column, name in wanted.items():
        inside = texts_of(every.where(has_class(name)), every, key).select(F.col(key).alias("_p"), F.col("start").alias("_s"), F.col("inner").alias("_inner"))
        met = out.join(inside, (F.col(key) == F.col("_p")) & (F.col("_s") > F.col("from_")) & (F.col("_s") <= F.col("to_")))
        first = met.groupBy(key, "job_id").agg(F.min_by("_inner", "_s").alias(column))
        out = out.join(first, [key, "job_id"], "left")
    times = every.where("tag = 'time'").select(F.col(key).alias("_p"), F.col("start").alias("_s"), F.try_element_at("attributes", F.lit("datetime")).alias("_time"))
    met = out.join(times, (F.col(key) == F.col("_p")) & (F.col("_s") > F.col("from_")) & (F.col("_s") <= F.col("to_")))
    out = out.join(met.groupBy(key, "job_id").agg(F.min_by("_time", "_s").alias("posted_at")), [key, "job_id"], "left")
    return out.select(key, "job_id", "title", "company", "location", "posted_at")
