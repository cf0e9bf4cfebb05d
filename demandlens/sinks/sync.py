"""Synchronisation of stored jobs with what a source lists, and write-back of skill demand, as changes for a versioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.session import cut_lineage
from demandlens.sinks.versioned import VersionedTable

#: Fields in which a blank that comes in keeps what is there.
KEPT = ("source_url", "external_id", "location", "job_type", "description")
JOB = "job_key string, external_id string, source_url string, company string, title string, location string, job_type string, description string, status string, created_at timestamp_ntz, last_synced_at timestamp_ntz"


def _said(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def matched(incoming: DataFrame, stored: DataFrame, at: str) -> DataFrame:
    """incoming with ``job_key``: of the newest stored job of its external id or URL, else a new one of its id or URL and the moment.

    Jobs of one id or URL are one row before the join. A row with neither has no key. Rows that leave a field blank meet nothing by it, but would all
    be dealt to one task; they are dealt by their ``ord`` instead.
    """
    own = F.coalesce(*(F.concat(F.lit(f"{c} "), _said(c), F.lit(f" {at}")) for c in ("external_id", "source_url")))
    out = incoming
    for c in ("external_id", "source_url"):
        newest = stored.where(_said(c).isNotNull()).groupBy(F.col(c).alias("k")).agg(F.max(F.struct("created_at", "job_key")).alias(f"by_{c}")).withColumn("deal", F.lit(0).cast("long"))
        dealt = F.when(_said(c).isNull(), F.col("ord")).otherwise(0).cast("long")
        out = out.withColumns({"asked_k": _said(c), "asked_deal": dealt}).join(newest, (F.col("asked_k") == F.col("k")) & (F.col("asked_deal") == F.col("deal")), "left").drop("k", "deal", "asked_k", "asked_deal")
    found = F.greatest("by_external_id", "by_source_url")
    return out.withColumn("job_key", F.coalesce(found["job_key"], own)).drop("by_external_id", "by_source_url")


def sync_plan(stored: DataFrame, incoming: DataFrame, at: str, apply_signals: bool = False) -> DataFrame:
    """The next row of every job that the batch touches or misses, with ``action``.

    incoming: ord, external_id, source_url, company, title, location, job_type, description, closed. Rows that lead to one job are applied in order
    of ``ord``: the last title, company and non-blank value of each kept field win. Rows without id and URL, or without title, are no jobs
    and left out. A job's status stays, as it is set by hand, unless ``apply_signals`` is set and the source says that it is closed. Actions:
    ``insert``; ``update`` of a changed field; ``keep``; ``closed``; ``missing``: active jobs with an id or URL, of a company
    that the batch lists, of which it says nothing. They stay as they are.
    """
    moment = F.expr(f"TIMESTAMP_NTZ'{at}'")
    rows = matched(incoming.where(F.coalesce(F.trim("title"), F.lit("")) != ""), stored, at).where("job_key IS NOT NULL")
    last = lambda c: F.max_by(_said(c), F.when(_said(c).isNotNull(), F.col("ord"))).alias(c)
    merged = rows.groupBy("job_key").agg(*[last(c) for c in (*KEPT, "title", "company")], F.max_by("closed", "ord").alias("closed"))
    asked = rows.select("company").where("company IS NOT NULL").distinct().withColumnRenamed("company", "asked")
    both = stored.alias("o").join(merged.alias("n"), F.col("o.job_key") == F.col("n.job_key"), "full").join(asked, F.col("o.company") == F.col("asked"), "left")

    new, seen = F.col("o.job_key").isNull(), F.col("n.job_key").isNotNull()
    value = {c: F.when(seen, F.coalesce(_said(f"n.{c}"), F.col(f"o.{c}"), F.lit(""))).otherwise(F.col(f"o.{c}")) for c in (*KEPT, "title", "company")}
    status = F.coalesce("o.status", F.lit("ACTIVE"))
    if apply_signals:
        status = F.when(F.coalesce("n.closed", F.lit(False)), "CLOSED").otherwise(status)
    changed = F.lit(False)
    for c, v in value.items():
        changed = changed | ~v.eqNullSafe(F.col(f"o.{c}"))
    missing = ~seen & F.col("asked").isNotNull() & (F.col("o.status") == "ACTIVE") & (_said("o.external_id").isNotNull() | _said("o.source_url").isNotNull())
    closes = ~new & (status == "CLOSED") & (F.col("o.status") != "CLOSED")
    action = F.when(new, "insert").when(closes, "closed").when(seen & changed, "update").when(seen, "keep").when(missing, "missing")
    out = both.select(
        F.coalesce("o.job_key", "n.job_key").alias("job_key"), value["external_id"].alias("external_id"), value["source_url"].alias("source_url"), value["company"].alias("company"),
        value["title"].alias("title"), value["location"].alias("location"), value["job_type"].alias("job_type"), value["description"].alias("description"), status.alias("status"),
        F.coalesce("o.created_at", moment).alias("created_at"), F.when(seen, moment).otherwise(F.col("o.last_synced_at")).alias("last_synced_at"), action.alias("action"),
    )
    return out.where("action IS NOT NULL")


def sync_jobs(table: VersionedTable, writer: str, batch: int, incoming: DataFrame, at: str, apply_signals: bool = False, carried: dict[str, str] | None = None) -> bool:
    """Apply a batch of listings to a table of jobs (JOB, by job_key) and add its counts; False if the batch is there already.

    The plan is worked out once and kept; counts and rows come from it.
    """
    if table.holds(writer, batch):
        return False
    now = table.read()
    stored = now if now is not None else incoming.sparkSession.createDataFrame([], JOB)
    plan = cut_lineage(sync_plan(stored, incoming, at, apply_signals))
    counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    changes = plan.where("action <> 'missing'").drop("action")
    return table.upsert(writer, batch, changes, counters={f"jobs_{a}": counts.get(a, 0) for a in ("insert", "update", "keep", "closed", "missing")}, carried=carried)


def write_demand(table: VersionedTable, writer: str, batch: int, demand: DataFrame) -> bool:
    """Make a table of demand (skill_set_id, ...) that of ``demand``: changed and new skills are put, vanished ones deleted."""
    if table.holds(writer, batch):
        return False
    now = table.read()
    if now is None:
        return table.upsert(writer, batch, demand)
    demand = cut_lineage(demand.select(*now.columns))
    gone = now.select("skill_set_id").join(demand.select("skill_set_id"), "skill_set_id", "left_anti")
    return table.upsert(writer, batch, demand.exceptAll(now), deleted=gone)
