"""Versioned tables: failures between stage and swap, batches sent twice, keys of all kinds, and what synchronisation decides."""

import random

import pytest

from demandlens.sinks import sync
from demandlens.sinks.versioned import VersionedTable
from demandlens.streaming import incremental

AT = "2024-01-02 00:00:00"
LISTED = "ord long, external_id string, source_url string, company string, title string, location string, job_type string, description string, closed boolean"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ["k"], 4)


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_a_failed_batch_leaves_nothing_and_can_be_sent_again(spark, table, monkeypatch):
    frame = lambda data: spark.createDataFrame(data, "k long, v string")
    assert table.read() is None and table.state().version == -1
    assert table.upsert("w", 0, frame([(1, "a"), (2, "b"), (None, "n")]), counters={"put": 3})
    before = rows(table)
    with monkeypatch.context() as broken:
        broken.setattr(VersionedTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.upsert("w", 1, frame([(1, "z"), (3, "c")]), counters={"put": 2})
    assert rows(table) == before and table.state().counters == {"put": 3}
    for _ in range(2):
        table.upsert("w", 1, frame([(1, "z"), (3, "c")]), deleted=frame([(2, ""), (99, "")]), counters={"put": 2}, carried={"at": "7"})
    assert rows(table) == [(1, "z"), (3, "c"), (None, "n")]
    state = table.state()
    assert (state.version, state.batches, state.counters, state.carried) == (1, {"w": 1}, {"put": 5}, {"at": "7"})
    assert table.upsert("other", 0, frame([])) and table.state().version == 2 and rows(table) == [(1, "z"), (3, "c"), (None, "n")]


def test_only_touched_buckets_are_written_anew(spark, table):
    table.upsert("w", 0, spark.range(200).selectExpr("id AS k", "'a' AS v"))
    before = table.state().folders
    table.upsert("w", 1, spark.createDataFrame([(5, "b")], "k long, v string"))
    after = table.state().folders
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 200 and table.read().where("v = 'b'").count() == 1
    every = spark.range(200).selectExpr("id AS k")
    table.upsert("w", 2, spark.createDataFrame([], "k long, v string"), deleted=every)
    assert table.read().count() == 0 and table.state().folders == {}


def listing(ord_, ident, url="", company="c", title="Job", location="", job_type="", description="", closed=False):
    return (ord_, ident, url, company, title, location, job_type, description, closed)


def test_sync_in_order_blanks_missing_and_closed(spark, tmp_path):
    frame = lambda data: spark.createDataFrame(data, LISTED)
    jobs = VersionedTable(spark, f"file://{tmp_path}/jobs", ["job_key"], 4)
    first = [listing(1, "a", "u1", location="X"), listing(2, "b", "u2"), listing(3, "c", "u3", company="other"), listing(4, "", ""), listing(5, "d", title=None), listing(6, None, "u6")]
    assert sync.sync_jobs(jobs, "w", 0, frame(first), "2024-01-01 00:00:00")
    assert jobs.state().counters == {"jobs_insert": 4, "jobs_update": 0, "jobs_keep": 0, "jobs_closed": 0, "jobs_missing": 0}
    again = [listing(1, "a", location=""), listing(2, "new", "u1", title="Lead"), listing(3, "", "u6", closed=True), listing(4, "e"), listing(5, "e", "u9", title="Both")]
    for _ in range(2):
        sync.sync_jobs(jobs, "w", 1, frame(again), AT)
    assert jobs.state().counters == {"jobs_insert": 5, "jobs_update": 1, "jobs_keep": 1, "jobs_closed": 0, "jobs_missing": 1}
    got = {r["source_url"]: (r["external_id"], r["title"], r["location"], r["status"]) for r in jobs.read().collect()}
    assert got == {"u1": ("new", "Lead", "X", "ACTIVE"), "u2": ("b", "Job", "", "ACTIVE"), "u3": ("c", "Job", "", "ACTIVE"), "u6": ("", "Job", "", "ACTIVE"), "u9": ("e", "Both", "", "ACTIVE")}
    sync.sync_jobs(jobs, "w", 2, frame([listing(1, "", "u6", closed=True)]), AT, apply_signals=True)
    assert jobs.state().counters["jobs_closed"] == 1 and jobs.read().where("status = 'CLOSED'").count() == 1


def test_two_batches_are_one(spark, tmp_path):
    rng = random.Random(2)
    data = [listing(i, rng.choice(["", f"x{rng.randrange(20)}"]), f"u{i % 15}", title=f"T{i}", location=rng.choice(["", "L1", "L2"])) for i in range(60)]
    whole, parts = (VersionedTable(spark, f"file://{tmp_path}/{n}", ["job_key"], 4) for n in ("whole", "parts"))
    unique = [r for r in data if r[1] == ""]
    sync.sync_jobs(whole, "w", 0, spark.createDataFrame(unique, LISTED), AT)
    for k, half in enumerate((unique[: len(unique) // 2], unique[len(unique) // 2 :])):
        sync.sync_jobs(parts, "w", k, spark.createDataFrame(half, LISTED), AT)
    columns = ["source_url", "title", "location", "status"]
    assert sorted(map(tuple, whole.read().select(columns).collect())) == sorted(map(tuple, parts.read().select(columns).collect()))


def test_streams_carry_counts_and_offsets(spark, tmp_path):
    names = ["sql", "spark", "sql", "", "known", "sql", "spark", "sql", "sql"]
    for k in range(3):
        spark.createDataFrame([(n,) for n in names[k::3]], "normalized string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    table = VersionedTable(spark, f"file://{tmp_path}/names", ["normalized"], 2)
    catalog = spark.createDataFrame([("known",)], "normalized string")
    stream = spark.readStream.schema("normalized string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    step = incremental.record_candidates(table, "names", catalog)
    incremental.apply_stream(stream, lambda rows, batch: (step(rows, batch), step(rows, batch)), f"file://{tmp_path}/state")
    assert sorted(map(tuple, table.read().collect())) == [("spark", 2, False), ("sql", 5, True)]

    jobs = VersionedTable(spark, f"file://{tmp_path}/jobs", ["job_key"], 2)
    listings = lambda taken: spark.createDataFrame([listing(i, s) for i, s in enumerate(taken)], LISTED)
    taken = [incremental.sync_window(jobs, "w", ["a", "b", "c"], 2, listings, AT, run) for run in (0, 0, 1, 2)]
    assert taken == [["a", "b"], [], ["c", "a"], ["b", "c"]]
