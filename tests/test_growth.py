"""Steps whose work must grow no faster than their tables: plans, and results where pairs are left out."""

import random
import re

from pyspark.sql import functions as F

from demandlens.operators import fuzzy, matching, resolution
from demandlens.operators import taxonomy as X
from demandlens.plans import catalog
from demandlens.session import cut_lineage
from demandlens.sources import parsers as P
from demandlens.sources.binding import Domain


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_of_a_large_offset(spark):
    rows = spark.createDataFrame([(1_000_000, "a b c"), (3_000_000_001, "a b c")], "id long, x string")
    got = rows.orderBy("id").select(F.array_join(P.picked_window(F.split("x", " "), F.col("id"), 2), ",").alias("v")).collect()
    assert [r.v for r in got] == ["b,c", "b,c"]


def test_large_ids_reach_the_rule(spark, tmp_path):
    """The query takes ids of any size, as its SQL does."""
    for name in ("customer", "nation", "orders"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        if name == "orders":
            rows = rows.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000)
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = catalog.queries()["rolling_window_pick"](spark, str(tmp_path)).collect()
    jobs = {r.o_orderkey: r for r in spark.read.parquet(str(tmp_path / "orders.parquet")).collect()}
    segments = {r.c_custkey: r.c_mktsegment for r in spark.read.parquet(str(tmp_path / "customer.parquet")).collect()}
    for r in got:
        words = f"{segments[jobs[r.id].o_custkey]} engineer {r.id % 97}".split(" ")
        assert r.value == f"{words[r.id % 3]},{words[(r.id + 1) % 3]}"


def test_unions_are_dealt_again(spark):
    """A union isn't taken as dealt because its sides are: they may be read in other numbers of parts, at which a join stops."""
    session = spark.newSession()
    cut_lineage(session.range(1))
    counts = session.range(100).repartition(8).groupBy("id").count()
    assert plan(counts.union(counts).groupBy("id").count()).count("Exchange hashpartitioning") == 3


def test_names_and_words_of_fuzzy_matches_are_not_broadcast(spark):
    names = spark.sql("SELECT * FROM VALUES ('steel lace'), ('a rose') AS t(normalized)")  # of known size, unlike rows from Python
    catalog_ = spark.sql("SELECT * FROM VALUES ('lace steel'), ('rose') AS t(skill_name)")
    for found in (fuzzy.by_words(names, catalog_, 90.0), fuzzy.by_containment(names, catalog_)):
        assert "Broadcast" not in plan(found)
        assert found.count() == 1


def test_stored_tables_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    spark.range(300_000).write.parquet(str(tmp_path / "part.parquet"))
    session = spark.newSession()
    part = Domain(session, str(tmp_path)).part
    assert "Broadcast" not in plan(part.join(session.range(10**7), "id"))


def test_names_of_a_taxonomy_are_not_broadcast(spark):
    """Sizes guessed from compressed files are far too small, so a broadcast of skills doesn't fit the driver."""
    skills = spark.createDataFrame([(1, "steel lace", ["alias 1"]), (2, "rose", [])], "id long, name string, aliases array<string>")
    patterns = spark.createDataFrame([("Metals", 0, " Steel "), ("Plants", 0, "rose")], "category string, ord int, pattern string")
    names = spark.createDataFrame([("Plants", "ROSE")], "category string, name string")
    found = X.pattern_matches(skills, patterns)
    assert "SortMergeJoin [s#" in plan(found)
    none = spark.createDataFrame([], "category string, skill_id long")
    assert "SortMergeJoin [n#" in plan(X.suggestions(skills, names, patterns, none))
    assert sorted((r.category, r.skill_id) for r in found.collect()) == [("Metals", 1), ("Plants", 2)]


def test_candidates_by_classes_equal_all_pairs(spark):
    """A keyword that is an alias too counts once; classes of frequent words lose nothing, ties go by name."""
    rng = random.Random(5)
    words = ["steel", "lace", "rose", "data", "ring"]
    rows = [(i, f"{rng.choice(words)} {rng.choice(words)} {i}", rng.random() < 0.9, [f"also {rng.choice(words)}"] if i % 3 == 0 else []) for i in range(1, 121)]
    kept = [(i, rows[i - 1][3][0] if i % 6 == 0 else f"kw {rng.choice(words)}") for i in range(1, 121) if i % 2 == 0]
    asked = [(i, f"{rng.choice(words)} {rng.choice(['tools', 'x', str(i), rng.choice(words)])}") for i in range(1, 31)] + [(40, "steel"), (41, "ring 11"), (42, "ml etl")]
    skills = spark.createDataFrame(rows, "id long, name string, is_active boolean, aliases array<string>")
    got = resolution.catalog_candidates(spark.createDataFrame(asked, "query_id long, query string"), skills, spark.createDataFrame(kept, "skill_set_id long, raw_text string"), 4, frequent=6)

    def tokens(x):
        return {w for w in re.split("[^a-z0-9+#.]+", x) if len(w) > 1} - {"tools"}

    want = set()
    for q, text in asked:
        mine = tokens(text) | ({"machine", "learning"} if "ml" in tokens(text) else set()) | ({"extract", "transform", "load", "data"} if "etl" in tokens(text) else set())
        scores = []
        for i, name, active, aliases in rows:
            terms = {(name, True)} | {(a, False) for a in aliases} | {(k, False) for j, k in kept if j == i}
            score = 0
            for t, own in terms if active and mine else ():
                n = len(mine & tokens(t))
                score += (8 if own else 6) * (t in text or text in t) + n * (4 if own else 3) + 2 * (own and 0 < n == len(tokens(t)))
            if score:
                scores.append((-score, name, i))
        want |= {(q, i, -s, k + 1) for k, (s, _, i) in enumerate(sorted(scores)[:4])}
    assert {(r.query_id, r.skill_id, r.score, r["rank"]) for r in got.collect()} == want


def test_long_texts_are_looked_up_by_long_runs(spark):
    """Of many texts that share short runs, those that hold a long one are found, and no others are compared."""
    longs = [f"steel lace {i} xx" for i in range(100, 400)]
    shorts = ["lace 123 xx", "steel lac", "lace 1234", "ace 39", "e"]
    got = fuzzy.containing(spark.createDataFrame([(x,) for x in longs], "long string"), spark.createDataFrame([(x,) for x in shorts], "short string"))
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in longs for y in shorts if y in x}
    assert fuzzy.RUNS == (3, 9)


def test_nearest_by_blocks(spark, monkeypatch):
    """Blocks of queries and vectors meet as products; equals, zero vectors, other sizes and a null element go as by all pairs."""
    monkeypatch.setattr(matching, "BLOCK", 16)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)], f"n{i % 10}") for i in range(1, 81)]
    rows += [(i, rows[3][1], f"n{i % 3}") for i in range(90, 96)] + [(100, [0.0] * 5, "zero"), (101, [1.0, 2.0], "short"), (102, [1.0, None, 0.0, 0.0, 0.0], "hole"), (103, None, "none")]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>, name string")
    queries = vectors.where("id % 4 = 0 OR id > 99").selectExpr("id AS query_id", "embedding AS query")
    found = matching.top_k(vectors, queries, 3)
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)
    e = {r.id: r.embedding for r in vectors.collect()}
    names = {i: n for i, _, n in rows}
    usable = lambda x: x is not None and None not in x and any(x)
    size = lambda x: sum(v * v for v in x) ** 0.5
    want = set()
    for q in [r.query_id for r in queries.collect()]:
        best = sorted((-sum(map(float.__mul__, e[q], e[i])) / (size(e[q]) * size(e[i])), names[i], i) for i in e if i != q and usable(e[q]) and usable(e[i]) and len(e[q]) == len(e[i]))
        want |= {(q, i, k + 1) for k, (_, _, i) in enumerate(best[:3])}
    assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == want


def test_answers_are_read_once(spark):
    """Filters on what was parsed aren't pushed below the parser, and one exchange serves groups and ranks."""
    from demandlens.operators import answers

    rows = spark.createDataFrame([(1, '{"skills": ["a", "A", {"name": "b c", "confidence": "high"}]}'), (2, "x"), (3, '{"skills": []}'), (4, '{"skills": ["a", " "]}')], "id long, payload string")
    found = answers.parse_extracted(rows, 2)
    assert {(r.id, r.at, r.name, r.confidence, r.error) for r in found.collect()} == {(1, 1, "A", None, None), (1, 2, "B C", 0.9, None), (2, 0, None, None, "malformed"), (3, 0, None, None, "no skills"), (4, 0, None, None, "empty name")}
    text = plan(found)
    text = text[text.index("Initial Plan") :] if "Initial Plan" in text else text
    assert text.count("get_json_object(payload") <= 2 and text.count("Exchange hashpartitioning") == 1


def test_blank_ids_are_dealt_out(spark):
    """Listings without an id or URL don't meet in one task, and find their job by the other field."""
    from demandlens.sinks import sync

    stored = spark.createDataFrame([("k1", "x1", "u1", "2001-01-01"), ("k2", "", "u2", "2001-01-02"), ("k0", "", "", "2001-01-03")], "job_key string, external_id string, source_url string, created_at string")
    rows = [(i, "", f"u{i}") for i in range(1, 4000)] + [(4000, "x1", "u2"), (4001, None, None), (4002, "x9", "")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = sync.matched(spark.createDataFrame(rows, "ord long, external_id string, source_url string"), stored, "now")
        by_url = [r["count"] for r in found.where("source_url <> ''").groupBy(F.spark_partition_id()).count().collect()]
        keys = {r.ord: r.job_key for r in found.collect()}
        no_url = sync.matched(spark.createDataFrame([(i, f"x{i}", "") for i in range(4000)], "ord long, external_id string, source_url string"), stored, "now")
        most = max(r["count"] for r in no_url.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(by_url) < 1000 and most < 1000
    assert (keys[1], keys[2], keys[3], keys[4000], keys[4001], keys[4002]) == ("k1", "k2", "source_url u3 now", "k2", None, "external_id x9 now")


def test_logs_of_one_company_are_dealt_out(spark):
    from demandlens.operators import monitoring

    logs = spark.range(4000).select("id", F.expr("CASE WHEN id % 4 > 0 THEN id % 2 END").alias("company_id"))
    names = spark.createDataFrame([(0, "none"), (5, "far")], "company_id long, company_name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = monitoring.with_names(logs, names, "company_id", "company_name")
        most = max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
        rows = {r.id: (r.company_id, r.company_name) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 1000 and len(rows) == 4000
    assert (rows[1], rows[2], rows[4]) == ((1, None), (0, "none"), (None, None))


def test_companies_are_counted_by_ids(spark):
    """Names come after the counts, so that tables of a task hold numbers alone."""
    found = catalog.queries()["company_breakdown"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["company_id", "company_name", "skill_set_id", "skill_name", "job_count", "links", "rank", "avg_score"]
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan(found))
    assert keys and not any("name" in k for k in keys)


def test_links_are_dealt_by_the_size_of_their_files(spark, monkeypatch, tmp_path):
    """More files ask for more parts, whatever the session's number, in every step that groups links; paths are taken as they are named."""
    import math
    import os
    import shutil

    from demandlens import session
    from demandlens.operators import demand, merges
    from demandlens.sources.binding import Domain

    folder = str(tmp_path / "a b %20c")
    shutil.copytree("/root/testdata/sf0.001", folder)
    d = Domain(spark, folder)
    assert session.parts_for(d.lineitem) == 0 and session.parts_for(spark.range(3)) == 0
    size = os.path.getsize(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(session, "PART_BYTES", 2000)
    n = session.parts_for(d.lineitem)
    assert n == math.ceil(size / 2000) > 8
    links = Domain(spark, folder).d_link
    assert len(re.findall(rf"hashpartitioning\([^)]*, {n}\), REPARTITION_BY_NUM", plan(links))) == 1
    merged = merges.attach_merge(links, links.selectExpr("job_post_id", "skill_set_id", "score + 1 AS score", "0 AS ord"))
    assert {x for x in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan(merged))} == {str(n)}
    counts = demand.category_counts(links.selectExpr("job_post_id", "skill_set_id % 3 AS category"), "category")
    assert re.search(rf"hashpartitioning\(category[^)]*, {n}\), REPARTITION_BY_NUM", plan(counts))
    assert {(r.category, r.job_count) for r in counts.collect()} == {(r.c, r.n) for r in links.groupBy(F.expr("string(skill_set_id % 3)").alias("c")).agg(F.countDistinct("job_post_id").alias("n")).collect()}
    mine = Domain(spark, folder).d_application_skill
    assert re.search(rf"hashpartitioning\(job_post_id[^)]*, {n}\), REPARTITION_BY_NUM", plan(mine))


def test_gaps_are_ranked_without_windows_over_owners(spark):
    from demandlens.operators import resumes

    owned = spark.createDataFrame([(1, 1), (1, 9), (2, 2)], "owner long, skill_set_id long")
    demands = spark.createDataFrame([(1, 9.0, "stable"), (2, 8.0, "stable"), (3, 7.0, "rising"), (4, 6.0, "stable")], "skill_set_id long, demand_score double, trend_type string")
    skills = spark.createDataFrame([(i, f"s{i}") for i in range(1, 10)], "id long, name string")
    found = resumes.gap_skills(owned, demands, skills, 2)
    assert "Window" not in plan(found)
    assert {(r.owner, r.skill_set_id, r.missing_rank, r["rank"]) for r in found.collect()} == {(1, 2, 1, 2), (1, 3, 2, 1), (2, 1, 1, 2), (2, 3, 2, 1)}
    members = spark.createDataFrame([(1, "a"), (2, "b")], "skill_set_id long, category string")
    lacks = resumes.gap_categories(owned, members, spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "category string, job_count long"), 3)
    assert "Window" not in plan(lacks)
    assert {(r.owner, r.category, r["rank"]) for r in lacks.collect()} == {(1, "b", 1), (1, "c", 2), (2, "a", 1), (2, "c", 2)}


def test_pairs_of_owner_and_job_are_numbers(spark):
    """No name is shuffled with a pair, and equals go by company, title and id."""
    from demandlens.operators import resumes

    links = spark.createDataFrame([(j, s) for j in range(1, 7) for s in (1, 2)], "job_post_id long, skill_set_id long")
    jobs = spark.createDataFrame([(1, "B", 1), (2, "a", 1), (3, "z", 2), (4, "A", 1), (5, "q", None), (6, "c", 1)], "id long, title string, company_id long")
    companies = spark.createDataFrame([(1, "Zed"), (2, "acme")], "id long, name string")
    found = resumes.job_matches(spark.createDataFrame([(7, 1), (7, 2), (8, 1)], "owner long, skill_set_id long"), links, jobs, companies, 5)
    windows = [x for x in plan(found).splitlines() if "Window [" in x]
    assert windows and not any("title" in x or "company" in x for x in windows)
    assert [(r.owner, r.job_post_id) for r in sorted(found.collect(), key=lambda r: (r.owner, r["rank"]))] == [(o, j) for o in (7, 8) for j in (5, 3, 2, 4, 1)]


def test_trends_look_at_the_top_skills_alone(spark):
    from demandlens.operators import skills as S

    rows = spark.createDataFrame([(s, f"n{s}", j, 5) for s in range(1, 5) for j in range(s)], "skill_set_id long, skill_name string, job_post_id long, score int").withColumn("created_at", F.expr("TIMESTAMP_NTZ'2001-01-05 00:00:00'"))
    found = S.skill_trends(rows, 2)
    text = plan(found)
    assert text.index("LeftSemi") > text.rindex("HashAggregate(keys=[period") if "HashAggregate(keys=[period" in text else text.index("LeftSemi") > 0
    assert {(r.skill_set_id, r.job_count) for r in found.collect()} == {(3, 3), (4, 4)}
