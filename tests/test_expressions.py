"""Rules with fixed examples, edge cases above all."""

import pytest
from pyspark.sql import functions as F

from demandlens.functions import numbers, text, vectors
from demandlens.operators import matching, merges, monitoring, skills


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.normalize_name, "  Python\xa0 ,", "python "), (text.clean_keyword, " Python ,", "Python"), (text.normalize_name, "", ""), (text.normalize_name, None, None),
        (text.job_type, " FULL_TIME ", "Full-time"), (text.job_type, "Seasonal  work", "Seasonal work"), (text.company_name, "Acme, Inc.", "acme"), (text.company_name, "Acme LLC", "acme"),
        (text.slug, "C++ & Rust!", "c-rust"), (text.board_token, "Open-AI 2", "openai2"), (text.confidence, "High", 0.9), (text.confidence, "1.7", 1.0), (text.confidence, "maybe", None),
        (text.detect_source, "https://www.linkedin.com/jobs/1", "LINKEDIN"), (text.detect_source, "https://boards.greenhouse.io/x", "GREENHOUSE"), (text.detect_source, "https://notlinkedin.com/", "CAREER_SITE"),
        (text.detect_source, None, "CAREER_SITE"), (text.relation_type, "Broader than", "broader"), (text.html_text, "<p>a &amp; b</p><script>x<y</script>c", "a & b c"), (text.clean_lines, " a \n\n b", "a\nb"),
        (text.split_labels, "a | b;\n\nc", ["a", "b", "c"]), (text.search_tokens, "Go, (go) rust", ["Go", "rust"]), (text.id_list, "1, x,2,", [1, 2]), (text.tokens, "The C++ and C# dev.", ["c++", "c#", "dev."]), (text.tokens, "skill tools and engineering", []), (text.detect_source, "https://greenhouse.io/x", "CAREER_SITE"),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, given, f) == want


def test_whole_words_and_occurrences(spark):
    assert one(spark, "a co-op role", lambda x: text.whole_word(x, "co-op")) is True
    assert one(spark, "storage", lambda x: text.whole_word(x, "rag")) is False
    assert one(spark, "go go gopher", lambda x: text.occurrences(x, F.lit("go"))) == 3


@pytest.mark.parametrize(("r30", "r90", "ratio", "kind"), [(0, 0, 1.0, "stable"), (3, 0, 2.0, "rising"), (5, 5, 3.0, "rising"), (10, 30, 1.0, "stable"), (0, 30, 0.0, "declining"), (20, 50, 4 / 3, "rising")])
def test_growth(spark, r30, r90, ratio, kind):
    row = spark.createDataFrame([(r30, r90)], "a long, b long").select(numbers.growth_ratio(F.col("a"), F.col("b")).alias("r")).first()
    assert row["r"] == pytest.approx(ratio)
    assert spark.range(1).select(numbers.trend_type(F.lit(r30), F.lit(r90), F.lit(ratio)).alias("t")).first()["t"] == kind


def test_numbers(spark):
    assert one(spark, 1, lambda x: numbers.percentage(x, F.lit(0)), "long") == 0.0
    assert one(spark, 1, lambda x: numbers.percentage(x, F.lit(3)), "long") == 33.3
    assert one(spark, None, lambda x: numbers.mean2(x, F.lit(0)), "long") == 0.0
    assert [one(spark, ms, monitoring.duration_display, "long") for ms in (None, 499, 500, 1500, 61_000)] == ["0:00", "0:00", "0:00", "0:02", "1:01"]


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0], None)], "a array<double>, b array<double>, z array<double>, n array<double>")
    got = row.select(*[vectors.cosine(F.col("a"), F.col(c)).alias(c) for c in "abzn"]).first()
    assert got["a"] == pytest.approx(1) and got["b"] == pytest.approx(0.5**0.5) and got["z"] is None and got["n"] is None


def scanned(rows):
    """The rule by a scan in order: what a kept row has, drops later rows; nulls drop nothing."""
    kept, seen = [], set()
    for source, at, exact, finger in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        keys = {(source, k, v) for k, v in (("e", exact), ("f", finger)) if v is not None}
        if not keys & seen:
            kept.append((source, at))
            seen |= keys
    return sorted(kept, key=str)


def test_greedy_dedupe_equals_a_scan(spark):
    import random

    rng = random.Random(2)
    schema = "source string, ord long, exact string, finger string"
    pick = lambda n: rng.choice([None, *(f"k{k}" for k in range(n))])
    many = [(rng.choice(["s", "t", None]), k, pick(40), pick(40)) for k in range(300)]
    chain = [("s", 1, "k1", "f1"), ("s", 2, "k2", "f1"), ("s", 3, "k2", "f2"), ("t", 4, "k1", "f1"), ("s", 5, "k1", "f9"), ("s", 6, None, None), ("s", 7, None, None)]
    for rows in (chain, many):
        got = merges.greedy_dedupe(spark.createDataFrame(rows, schema)).collect()
        assert sorted(((r["source"], r["ord"]) for r in got), key=str) == scanned(rows)
    assert merges.greedy_dedupe(spark.createDataFrame([], schema)).count() == 0


def test_percentages_add_up(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert {r["k"]: r["percent"] for r in matching.whole_percentages(rows, "n", ["k"]).collect()} == {"a": 34, "b": 33, "c": 33}


def test_filters_reach_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumnRenamed("l_shipdate", "created_at")
    plan = skills.LinkFilters(start="1998-01-01", end="1998-02-01").apply(rows).select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan and "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan


def test_score_max_of_zero_counts(spark):
    rows = spark.createDataFrame([(0,), (5,)], "score int")
    assert skills.LinkFilters(score_max=0).apply(rows).count() == 1


def test_merge_keeps_status_and_blanks(spark):
    old = spark.createDataFrame([(1, "a", "x", "APPLIED"), (2, "b", None, "CLOSED")], "id long, title string, place string, status string")
    new = spark.createDataFrame([(1, "", "y", "ACTIVE"), (3, "c", "", None)], "id long, title string, place string, status string")
    got = {r["id"]: tuple(r)[1:] for r in merges.merge_preserve(old, new, "id", ["title", "place"]).collect()}
    assert got == {1: ("a", "y", "APPLIED", "update"), 2: ("b", None, "CLOSED", "keep"), 3: ("c", None, "ACTIVE", "insert")}
