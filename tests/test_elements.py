"""Elements of pages: nesting, unclosed tags, quoted brackets, and cards among them."""

from demandlens.sources import elements as E


def tree(html):
    return [(r[4], r[3], r[6] if r[4] == "#text" else r[5] or {}) for r in E.parsed(html)]


def test_nested_elements_of_one_class():
    html = '<div class="a x">one<div class="a">two</div>three</div><p>four'
    spans = [(r[0], r[1], r[2]) for r in E.parsed(html)]
    assert spans == [(0, 4, None), (1, 1, 0), (2, 3, 0), (3, 3, 2), (4, 4, 0), (5, 6, None), (6, 6, 5)]
    assert [t for t, _, _ in tree(html)] == ["div", "#text", "div", "#text", "#text", "p", "#text"]


def test_unclosed_stray_and_quoted():
    assert tree('<ul><li>a<li>b<ul><li>c</ul></ul>') == [("ul", 0, {}), ("li", 1, {}), ("#text", 2, "a"), ("li", 1, {}), ("#text", 2, "b"), ("ul", 2, {}), ("li", 3, {}), ("#text", 4, "c")]
    assert tree("<p><b>x<br><p>y</b></p></i>z") == [("p", 0, {}), ("b", 1, {}), ("#text", 2, "x"), ("br", 2, {}), ("p", 0, {}), ("#text", 1, "y"), ("#text", 0, "z")]
    assert tree('<a title="1 > 0" title="no" data-x>q</a><!-- <p> -->') == [("a", 0, {"title": "1 > 0", "data-x": ""}), ("#text", 1, "q")]
    assert tree("<script>if (a<b) '<p>'</script>&lt;p&gt;")[-1] == ("#text", 0, "<p>")
    assert E.parsed(None) == E.parsed("") == []


def test_texts_and_cards(spark):
    card = '<div data-entity-urn="urn:li:jobPosting:{}"><div><h3 class="x base-search-card__title"> Data <b>&amp;</b>\n AI </h3></div>{}<time datetime="2024-01-02"></time></div>'
    html = card.format(11, '<h4 class="base-search-card__subtitle"><a>Acme</a></h4><span class="job-search-card__location">Oslo') + card.format(12, "") + card.format(11, "again")
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>nothing")], "page_id long, html string")
    every = E.elements(pages)
    rows = sorted(tuple(r) for r in E.job_cards(every).collect())
    assert rows == [(1, "11", "Data & AI", "Acme", "Oslo", "2024-01-02"), (1, "12", "Data & AI", None, None, "2024-01-02")]
    deep = spark.createDataFrame([(1, "<div>" * 3000 + "x")], "page_id long, html string")
    assert E.elements(deep).agg({"depth": "max"}).first()[0] == 3000
