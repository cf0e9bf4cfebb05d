"""Date words against their meaning and the scan, values of any shape, chains and rings of parents."""

import calendar
import json
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from demandlens.functions import json_safe
from demandlens.operators import dates, profile, taxonomy

DATA = "/root/testdata/sf0.001"


def test_month_spellings():
    assert len(dates.MONTHS) == 24 and dates.MONTHS["sept"] == 9 and dates.MONTHS["may"] == 5
    assert all(dates.MONTHS[calendar.month_name[k].lower()] == k for k in range(1, 13))


@pytest.mark.parametrize(
    ("query", "keeps"),
    [
        ("1996", lambda t: t.year == 1996), ("sept", lambda t: t.month == 9), ("MARCH 1996", lambda t: t.month == 3 and t.year == 1996), ("1996-02-29", lambda t: t.date() == date(1996, 2, 29)),
        ("1996-02-30", lambda t: False), ("(1996-02-1)", lambda t: "1996-02-1" in str(t)), ("10:30", lambda t: "10:30" in str(t)), ("1996, 1997", lambda t: False), ("jan feb", lambda t: False),
        ("", lambda t: True), ("9999", lambda t: False), ("0000", lambda t: False), ("word", lambda t: False),
    ],
)
def test_each_branch(spark, query, keeps):
    times = [datetime(1995, 12, 31, 23, 59, 59) + timedelta(hours=37 * k, minutes=11 * k) for k in range(400)] + [datetime(1996, 2, 29), datetime(1996, 3, 1), datetime(1997, 1, 1)]
    rows = spark.createDataFrame([(t,) for t in times], "at timestamp_ntz")
    assert sorted(r[0] for r in dates.search(rows, query, [], "at").collect()) == sorted(t for t in times if keeps(t))


def test_ranges_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(datetime(1996, 3, k), k) for k in range(1, 20)], "at timestamp_ntz, k int").write.parquet(f"file://{tmp_path}/t")
    rows = spark.read.parquet(f"file://{tmp_path}/t")
    plan = dates.search(rows, "march 1996", [], "at")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(at,1996-03-01T00:00)" in plan and "LessThan(at,1996-04-01T00:00)" in plan
    assert dates.span(["dec", "1999"]) == (date(1999, 12, 1), date(2000, 1, 1)) and dates.span(["march"]) is None
    assert dates.span(["1996", "1997-01-01"]) == (date(1997, 1, 1), date(1997, 1, 1))


def test_nulls_and_texts(spark):
    rows = spark.createDataFrame([(1, "May plans", None), (2, None, datetime(2020, 5, 1)), (3, None, None), (4, "x", datetime(2020, 6, 1))], "id int, title string, at timestamp_ntz")
    assert sorted(r["id"] for r in dates.search(rows, "may", ["title"], "at").collect()) == [1, 2]
    assert sorted((r["query"], r["id"]) for r in dates.search_any(rows, ["2020", "plans"], ["title"], "at").collect()) == [("2020", 2), ("2020", 4), ("plans", 1)]


def test_values_of_any_shape(spark):
    moment = datetime(2024, 1, 2, 3, 4, 5, 60)
    value = {"d": date(2024, 1, 2), "t": moment, "z": None, "n": Decimal("1.50"), "f": float("inf"), "l": [[date(2020, 2, 29), None]], "m": {1: Decimal("2.0")}, "e": [], "b": b"hi"}
    rows = spark.createDataFrame([(1, value), (2, None)], "id int, v struct<d: date, t: timestamp_ntz, z: string, n: decimal(9,2), f: double, l: array<array<date>>, m: map<int,decimal(9,1)>, e: array<int>, b: binary>")
    got = [r[0] for r in rows.orderBy("id").select(json_safe.json_text(rows, "v")).collect()]
    assert json.loads(got[0]) == {"d": "2024-01-02", "t": "2024-01-02T03:04:05.000060", "z": None, "n": 1.5, "f": None, "l": [["2020-02-29", None]], "m": {"1": 2.0}, "e": [], "b": "aGk="}
    assert got[1] is None


def test_leaves_of_nested_texts(spark):
    texts = [(1, '{"a": {"b": [1, {"c": null}], "e": {}}, "x": "y"}'), (2, "7"), (3, "no json"), (4, None), (5, "[]"), (6, "[" * 20 + "1" + "]" * 20)]
    got = {(r["id"], r["path"]): r["value"] for r in json_safe.leaves(spark.createDataFrame(texts, "id int, j string"), "id", "j").collect()}
    assert got == {(1, "$.a.b[0]"): "1", (1, "$.a.b[1].c"): None, (1, "$.a.e"): "{}", (1, "$.x"): "y", (2, "$"): "7", (5, "$"): "[]", (6, "$" + "[0]" * 20): "1"}
    with pytest.raises(ValueError):
        json_safe.leaves(spark.createDataFrame(texts, "id int, j string"), "id", "j", most=10)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    cuts = []
    plain = taxonomy.cut_lineage
    monkeypatch.setattr(taxonomy, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    items = spark.range(5000).selectExpr("concat('u', id) AS uri", "CASE WHEN id > 0 THEN concat('u', id - 1) END AS broader")
    got = taxonomy.hierarchy(items, spark.createDataFrame([], "uri string, parent string"))
    assert got.where("root = 'u0'").count() == 5000 and got.agg(F.max("depth")).first()[0] == 4999
    assert len(cuts) <= 2 + 14


def test_rings_and_missing_parents(spark):
    items = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "gone"), ("f", "f"), ("g", "e"), ("h", None), ("", "a"), ("k", "old")], "uri string, broader string")
    known = spark.createDataFrame([("old", None), ("k", "old"), ("p", "lost")], "uri string, parent string")
    got = {r["uri"]: tuple(r)[1:] for r in taxonomy.hierarchy(items, known).collect()}
    assert {u: got[u] for u in "abcd"} == {"a": ("b", None, None, "cycle"), "b": ("c", None, None, "cycle"), "c": ("a", None, None, "cycle"), "d": ("a", None, None, "cycle")}
    assert got["e"] == (None, "e", 0, "missing") and got["f"] == (None, "f", 0, "root") and got["g"] == ("e", "e", 1, "linked") and got["h"] == (None, "h", 0, "root")
    assert got["k"] == ("old", "old", 1, "kept") and got["p"] == ("lost", "p", 0, "kept") and set(got) == set("abcdefghkp") | {"old"}


def test_bridges_count_each_category_once_a_job(spark):
    links = spark.createDataFrame([(1, 10, datetime(2024, 1, 1)), (2, 10, datetime(2024, 1, 1)), (1, 11, datetime(2024, 1, 1)), (3, 12, datetime(2024, 1, 1))], "skill_set_id long, job_post_id long, created_at timestamp_ntz")
    categories = spark.createDataFrame([("business", 1, "b1", True), ("business", 2, "b2", True), ("business", 3, "b3", False), ("esco", 1, "e1", True)], "kind string, id long, name string, is_active boolean")
    bridge = spark.createDataFrame([("business", 1, 1, True), ("business", 2, 1, True), ("business", 1, 2, False), ("business", 3, 3, True), ("esco", 1, 1, False), ("esco", 1, 1, False)], "kind string, skill_set_id long, category_id long, is_approved boolean")
    assert sorted(map(tuple, profile.category_jobs(links, bridge, categories).collect())) == [("business", "b1", 2), ("esco", "e1", 2)]
    skills = spark.createDataFrame([(1, "One"), (2, "two"), (3, "Three")], "id long, name string")
    got = profile.market_profile(links, skills, bridge, categories, "2024-01-10 00:00:00", limit=2).collect()
    assert [(r["name"], r["value"]) for r in got if r["list"] == "business_categories"] == [("b1", 2.0)]
    assert [r["name"] for r in sorted(got, key=lambda r: r["rank"]) if r["list"] == "top_skills"] == ["One", "Three"]
    assert [(r["name"], r["share"]) for r in got if r["list"] == "top_business"] == [("b1", 100.0)]
