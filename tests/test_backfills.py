"""Backfills run twice, filters of logs one by one, and rows of logs that lack everything."""

import pytest

from demandlens.operators import backfills as B
from demandlens.operators import monitoring as M
from demandlens.plans import catalog


def test_backfills_settle(spark):
    jobs = spark.createDataFrame([(1, "ACTIVE"), (2, None), (3, "ARCHIVED"), (4, "CLOSED")], "id long, status string")
    applications = spark.createDataFrame([(1,), (3,), (None,), (1,), (9,)], "job_post_id long")
    first = B.mark_applied(jobs, applications)
    assert sorted(map(tuple, first.collect())) == [(1, "APPLIED", "update"), (2, None, "keep"), (3, "ARCHIVED", "keep"), (4, "CLOSED", "keep")]
    assert B.mark_applied(first, applications).where("action <> 'keep'").count() == 0
    assert sorted(map(tuple, B.reset_status(jobs).collect())) == [(1, "ACTIVE", "keep"), (2, "ACTIVE", "update"), (3, "ACTIVE", "update"), (4, "ACTIVE", "update")]
    links = spark.createDataFrame([(1, 5, 40, "PIPELINE", "{}")], "job long, skill_set_id long, score int, source_type string, metadata string")
    legacy = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (None, 6)], "job long, skill_set_id long")
    moved = B.migrate_links(links, legacy, "job", "old")
    assert sorted(map(tuple, moved.collect())) == [(1, 5, 40, "PIPELINE", "{}", "keep"), (1, 6, 0, "MANUAL", '{"migrated_from":"old"}', "insert")]
    assert B.migrate_links(moved, legacy, "job", "old").where("action = 'insert'").count() == 0
    skills = spark.createDataFrame([(1, " Go; ", ["go", "GoLang", None, " ", "golang."]), (2, None, None)], "id long, name string, aliases array<string>")
    none = spark.createDataFrame([], "skill_set_id long, normalized string")
    words = B.keyword_backfill(skills, none)
    assert sorted(map(tuple, words.collect())) == [(1, "go", "Go", "CANONICAL", True), (1, "golang", "GoLang", "ALIAS", False)]
    assert B.keyword_backfill(skills, words).count() == 0


def test_migrated_links_come_once(spark):
    """Sides of a union that are read in parts of different numbers, as with tables beyond the size of a broadcast."""
    session = spark.newSession()
    sizes = {"autoBroadcastJoinThreshold": "2k", "shuffle.partitions": "12", "adaptive.enabled": "true", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.coalescePartitions.minPartitionSize": "1k"}
    for key, size in sizes.items():
        session.conf.set(f"spark.sql.{key}", size)
    rows = catalog.queries()["migrate_links"](session, "/root/testdata/sf0.001")
    assert rows.groupBy("job_post_id", "skill_set_id").count().where("count > 1").count() == 0 and rows.count() == 3344


def test_listing_pages(spark):
    rows = [(1, "A", "https://jobs.lever.co/x", "https://other", None), (2, None, "", "https://x.example", "RSS"), (3, "C", None, "", "API"), (4, "D", None, None, "API")]
    got = B.listing_pages(spark.createDataFrame(rows, "id long, name string, base_url string, url string, resource string"))
    assert sorted(map(tuple, got.collect())) == [(1, "https://jobs.lever.co/x", "LEVER", "A"), (2, "https://x.example", "RSS", "")]




def test_filters_and_rows_of_logs(spark):
    sql = """SELECT CAST(id AS LONG) AS id, CAST(at AS TIMESTAMP_NTZ) AS created_at, 's' AS service_name, step AS step_name, status, severity, run AS crawl_run_id, src AS source_id, job AS job_id, co AS company_id, 'm' AS message, meta AS metadata, err AS error_text, ms AS duration_ms
        FROM VALUES (1, '2024-01-05 13:07:09.000120', 'a', 'FAILED', 'ERROR', 1L, 1L, 1L, 1L, NULL, 'x\\n y ', 61500L), (2, NULL, 'b', 'SUCCESS', 'INFO', 2L, NULL, NULL, 9L, '{"errors": 0}', NULL, NULL), (3, '2024-01-05 00:00:00', 'a', NULL, 'INFO', 2L, 2L, 2L, NULL, '[1]', '', 0L)
        AS t(id, at, step, status, severity, run, src, job, co, meta, err, ms)"""
    logs = spark.sql(sql)
    ids = lambda **k: [r.id for r in M.filtered_logs(logs, 50, **k).collect()]
    assert ids() == ids(status="", job_id=0, source_id=None) == [1, 3, 2]
    assert (ids(status="FAILED"), ids(severity="INFO"), ids(step_name="a"), ids(source_id=2), ids(crawl_run_id=2), ids(job_id=1), ids(company_id=9)) == ([1], [3, 2], [1, 3], [3], [3, 2], [1], [2])
    assert [r.id for r in M.filtered_logs(logs, 1).collect()] == [1]
    with pytest.raises(ValueError):
        M.filtered_logs(logs, 1, user=3)
    names = spark.createDataFrame([(1, "One")], "id long, name string")
    rows = {r.id: r for r in M.log_rows(logs, names, names).collect()}
    assert len(rows[1]) == 26
    one, two, three = rows[1], rows[2], rows[3]
    assert (one.created_at, one.created_at_display, one.created_at_title) == ("2024-01-05T13:07:09.000120+00:00", "Jan 5, 1:07 PM", "2024-01-05 13:07:09 UTC")
    assert (one.source_name, one.company_name, one.error_reason, one.duration_display, one.flow_duration_label) == ("One", "One", "y", "1:02", "Duration")
    assert [tuple(m) for m in one.metric_summary] == [("jobs_created", "Created", "0"), ("jobs_updated", "Updated", "0"), ("jobs_closed", "Closed", "0"), ("errors", "Errors", "1")]
    assert (two.created_at, two.created_at_datetime, two.created_at_display, two.created_at_title, two.duration_display, two.flow_duration_label) == (None, "", "-", "", "", "")
    assert two.metric_summary_text == "Created: 0, Updated: 0, Closed: 0, Errors: 0" and two.company_name == ""
    assert three.metric_summary == [] and three.metric_summary_text == "" and three.duration_display == "0:00"
