"""Elements of all rows of ``pages`` by the table function, with SQL that cuts the same out of the text."""

from pyspark.sql import functions as F

from demandlens.plans.catalog import query
from demandlens.sources import elements as E


def plain(x: str) -> str:
    """SQL of a piece's text: tags are blanks, entities read, white space collapsed."""
    out = rf"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", chr(160)), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{char}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query("page_links", """SELECT page_id, k - 1 AS nth, split_part(x, '">', 1) AS href, split_part(x, '">', 2) AS label FROM
    (SELECT page_id, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*">[^<]*)</a>', 1) AS xs FROM pages))""", views=False)
def page_links(d):
    every = E.elements(d.pages.select("page_id", "html"))
    found = E.texts_of(every.where("tag = 'a'"), every)
    return found.selectExpr("page_id", "row_number() OVER (PARTITION BY page_id ORDER BY start) - 1L AS nth", "attributes['href'] AS href", "inner AS label")


@query("page_paragraphs", f"""SELECT page_id, k - 1 AS nth, {plain("split_part(x, '</p>', 1)")} AS text FROM (SELECT page_id, unnest(xs[2:]) AS x, unnest(range(1, len(xs))) AS k FROM
    (SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS xs FROM pages))""", views=False)
def page_paragraphs(d):
    """Paragraphs of articles; many are not closed but by the next."""
    every = E.elements(d.pages.select("page_id", "html"))
    found = E.texts_of(every.where("tag = 'p'"), every)
    return found.selectExpr("page_id", "row_number() OVER (PARTITION BY page_id ORDER BY start) - 1L AS nth", "inner AS text")


@query("page_outline", r"""SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g'), '<([a-z0-9]+)[ >]', 1)) AS tag FROM pages) GROUP BY 1""", views=False)
def page_outline(d):
    every = E.elements(d.pages.select("page_id", "html")).where("tag NOT IN ('#text', 'script', 'style')")
    return every.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))
