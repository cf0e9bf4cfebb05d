"""Analyses of resumes on small inputs: every source of a resolution, steps that fail, ties, blanks and nothing at all."""

from demandlens.operators import resumes as Z

SKILLS = [(1, "Machine Learning", True, []), (2, "Data Modeling", True, ["Modeling of data"]), (3, "Cobol", False, []), (4, "Rust", True, [])]
ANSWERS = "id string, payload string"
MAPPED = "owner long, normalized string, name string, skill_id long, outcome string"


def tables(spark):
    skills = spark.createDataFrame(SKILLS, "id long, name string, is_active boolean, aliases array<string>")
    return skills, spark.createDataFrame([(4, "oxide")], "skill_set_id long, raw_text string"), spark.createDataFrame([("Ferris", 4)], "alias string, skill_id long")


def test_resolved_names(spark):
    skills, keywords, alias_rows = tables(spark)
    names = spark.createDataFrame([("ferris.",), ("Ferris.",), ("COBOL",), (None,), (" ",), ("ml models",), ("learning machine",), ("data lakes",), ("modeling",), ("knitting",), ("ml models",)], "name string")
    picks = [("ml models", '{"canonical": "machine learning.", "confidence": 0.8}'), ("learning machine", '{"canonical": "Machine Learning", "confidence": 0.79}'), ("data lakes", '{"canonical": "Rust", "confidence": 1}'),
             ("modeling", '{"canonical": "Data Modeling", "confidence": "high"}'), ("knitting", '{"canonical": "Rust", "confidence": 1}')]
    got = {(r.name or "").strip(): (r.skill_id, r.confidence, r.source) for r in Z.resolved_names(names, skills, keywords, alias_rows, spark.createDataFrame(picks, ANSWERS)).collect()}
    assert got == {
        "ferris.": (4, 1.0, "alias"), "Ferris.": (4, 1.0, "alias"), "COBOL": (3, 1.0, "exact"), "": (None, 0.0, "empty"), "ml models": (1, 0.8, "rag"), "learning machine": (None, 0.79, "low_confidence"),
        "data lakes": (None, 1.0, "invalid_canonical"), "modeling": (None, 0.0, "ollama_error"), "knitting": (None, 0.0, "unresolved"),
    }
    near = spark.createDataFrame([("knitting", 4, 1)], "query_id string, skill_id long, rank long")
    by_vector = Z.resolved_names(names.where("name = 'knitting'"), skills, keywords, alias_rows, spark.createDataFrame(picks, ANSWERS), near).collect()
    assert [(r.skill_id, r.source) for r in by_vector] == [(4, "rag")]
    none = Z.resolved_names(names.where("name = 'modeling'"), skills, keywords, alias_rows, spark.createDataFrame([], ANSWERS)).collect()
    assert [(r.source, r.reason) for r in none] == [("ollama_error", "no answer")]
    assert Z.resolved_names(names.limit(0), skills, keywords, alias_rows, spark.createDataFrame(picks, ANSWERS)).count() == 0


def test_augmented_gives_a_skill_once(spark):
    rows = [
        (1, "ml", "ML", 1, "matched"), (1, "ai models", "AI models", None, Z.NO_SKILL), (1, "b rust", "B rust", None, Z.NO_SKILL), (1, "a rust", "A rust", None, Z.NO_SKILL), (1, "x", "X", None, "rejected during verification"),
        (2, "a rust", "A rust", None, Z.NO_SKILL), (2, "new", "New", None, Z.NO_SKILL),
    ]
    resolved = spark.createDataFrame([("AI models", 1, "rag"), ("A rust", 4, "exact"), ("B rust", 4, "rag"), ("X", 4, "rag"), ("New", None, "unresolved")], "name string, skill_id long, source string")
    got = {(r.owner, r.name): (r.skill_id, r.outcome, r.source) for r in Z.augmented(spark.createDataFrame(rows, MAPPED), resolved).collect()}
    assert got == {
        (1, "ML"): (1, "matched", "index"), (1, "AI models"): (None, "already matched", "rag"), (1, "A rust"): (4, "matched", "exact"), (1, "B rust"): (None, "already matched", "rag"),
        (1, "X"): (None, "rejected during verification", None), (2, "A rust"): (4, "matched", "exact"), (2, "New"): (None, Z.NO_SKILL, None),
    }


def test_auto_created(spark):
    skills = tables(spark)[0]
    rows = [(2, "new thing", "new THING", None, Z.NO_SKILL), (1, "new thing", "new thing", None, Z.NO_SKILL), (1, "cobol", "Cobol", None, Z.NO_SKILL), (1, "bad", "bad", None, "rejected during verification"), (1, "rust", "Rust", 4, "matched")]
    out, new = Z.auto_created(spark.createDataFrame(rows, MAPPED), skills)
    assert {(r.owner, r.normalized): (r.skill_id, r.outcome) for r in out.collect()} == {
        (2, "new thing"): (None, "created"), (1, "new thing"): (None, "created"), (1, "cobol"): (3, "matched"), (1, "bad"): (None, "rejected during verification"), (1, "rust"): (4, "matched"),
    }
    assert [tuple(r) for r in new.collect()] == [("new thing", "New Thing")]


def test_gaps_stop_at_their_limit(spark):
    owned = spark.createDataFrame([(1, 10), (1, 11), (2, 99), (3, 13), (1, 10)], "owner long, skill_set_id long")
    demands = spark.createDataFrame([(10, 9.0, "stable"), (11, 8.0, "stable"), (12, 7.0, "stable"), (13, 7.0, "rising"), (14, 1.0, "rising")], "skill_set_id long, demand_score double, trend_type string")
    skills = spark.createDataFrame([(i, f"s{i}") for i in range(10, 15)], "id long, name string")
    got = sorted((r.owner, r.missing_rank, r.rank, r.skill_set_id) for r in Z.gap_skills(owned, demands, skills, 2).collect())
    assert got == [(1, 1, 2, 12), (1, 2, 1, 13), (2, 1, 1, 10), (2, 2, 2, 11), (3, 1, 1, 10), (3, 2, 2, 11)]
    members = spark.createDataFrame([(10, "A"), (10, "B"), (13, "C")], "skill_set_id long, category string")
    counts = spark.createDataFrame([("A", 5), ("b", 3), ("C", 3), ("D", 0), ("E", 1)], "category string, job_count long")
    lacks = sorted((r.owner, r.rank, r.category) for r in Z.gap_categories(owned, members, counts, 3).collect())
    assert lacks == [(1, 1, "b"), (1, 2, "C"), (2, 1, "A"), (2, 2, "b"), (2, 3, "C"), (3, 1, "A"), (3, 2, "b")]
    shares = sorted((r.owner, r.category, r.percent) for r in Z.profiles(owned, members).collect())
    assert shares == [(1, "A", 50), (1, "B", 50), (3, "C", 100)]
    assert Z.gap_skills(owned.limit(0), demands, skills, 2).count() == 0 and Z.gap_skills(owned, demands.limit(0), skills, 2).count() == 0


def test_analysis_ends_where_a_step_fails(spark):
    skills, keywords, alias_rows = tables(spark)
    resumes = spark.createDataFrame([(1, " Rust \r\n\n cobol"), (2, None), (3, "text"), (4, "text"), (5, " \t\n")], "id long, text string")
    extracted = spark.createDataFrame([(1, '{"candidate_skills": ["rust", "COBOL", "Go (Rust)"]}'), (3, "broken"), (4, '{"skills": ["rust"]}'), (5, '{"skills": ["rust"]}')], "id long, payload string")
    verified = spark.createDataFrame([(1, '{"verified_skills": ["Rust", "cobol", "go (rust)"]}'), (4, '{"verified_skills": ["cobol"], "rejected_skills": ["rust"]}'), (5, '{"verified_skills": ["rust"]}')], "id long, payload string")
    links = spark.createDataFrame([(7, 4), (7, 1), (8, 3), (9, 2)], "job_post_id long, skill_set_id long")
    jobs = spark.createDataFrame([(7, "b", 1), (8, "a", 1), (9, "a", 1)], "id long, title string, company_id long")
    companies = spark.createDataFrame([(1, "Acme")], "id long, name string")
    vectors = spark.createDataFrame([(4, [1.0, 0.0])], "id long, embedding array<double>")
    demands = spark.createDataFrame([(4, 5)], "skill_set_id long, demand long")
    done = Z.analyze(resumes, extracted, verified, spark.createDataFrame([], ANSWERS), skills, keywords, alias_rows, links, jobs, companies, vectors, demands)
    steps = {}
    for r in done["steps"].collect():
        steps.setdefault(r.owner, []).append((r.step, r.status, r.n))
    assert sorted(steps[1]) == [("job_match", "success", 2), ("market_fit", "success", 1), ("ollama_extract", "success", 3), ("ollama_verify", "success", 3), ("skillset_mapping", "success", 2), ("text_extraction", "success", 10)]
    assert steps[2] == steps[5] == [("text_extraction", "failed", None)]
    assert sorted(steps[3]) == [("ollama_extract", "failed", None), ("text_extraction", "success", 4)]
    assert sorted(steps[4]) == [("ollama_extract", "success", 1), ("ollama_verify", "failed", None), ("text_extraction", "success", 4)]
    assert sorted((r.owner, r.job_post_id, r.match_percent, r.rank) for r in done["job_matches"].collect()) == [(1, 7, 50.0, 2), (1, 8, 100.0, 1)]
    assert [(r.owner, r.fit_percent, r.matched, r.skills) for r in done["market_fit"].collect()] == [(1, 100.0, 1, 1)]
