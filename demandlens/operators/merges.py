"""Merges as plans: each gives the next state of a table with the action taken on every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions.text import collapse
from demandlens.session import cut_lineage, dealt, parts_for


def _filled(c: str):
    return F.nullif(F.col(c), F.lit(""))


def merge_preserve(existing: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A blank that comes in keeps what is there; status is never changed; rows of one side only are kept or inserted."""
    old, new = existing.alias("o"), incoming.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    values = {f: F.coalesce(_filled(f"n.{f}"), F.col(f"o.{f}")) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~values[f].eqNullSafe(F.col(f"o.{f}"))
    action = F.when(F.col(f"o.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull() | ~changed, "keep").otherwise("update")
    status = F.when(F.col(f"o.{key}").isNull(), F.coalesce("n.status", F.lit("ACTIVE"))).otherwise(F.col("o.status"))
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[v.alias(f) for f, v in values.items()], status.alias("status"), action.alias("action"))


def sync_metrics(plan: DataFrame, group: list[str]) -> DataFrame:
    return plan.groupBy(*group).agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("insert", "update", "keep")])


def match_existing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """The newest stored job of the same external id or the same url: two equal joins instead of one with OR.

    Stored jobs of one key are one row before the join, so a row that comes in meets two at most, whatever a key holds.
    """
    out = incoming.select("row_id", "external_id", "source_url")
    for k in ("external_id", "source_url"):
        newest = existing.where(F.col(k) != "").groupBy(F.col(k).alias("k")).agg(F.max(F.struct("created_at", "id")).alias(f"by_{k}"))
        out = out.join(newest, F.col(k) == F.col("k"), "left").drop("k")
    found = F.greatest("by_external_id", "by_source_url")
    return out.select("row_id", found["id"].alias("existing_id"))


def attach_merge(existing: DataFrame, scored: DataFrame) -> DataFrame:
    """Upsert of links (owner, skill): scores within 0 and 100, the first of repeated skills by ``ord`` wins."""
    keys, parts = ["job_post_id", "skill_set_id"], max(parts_for(existing), parts_for(scored))
    first = dealt(scored.select(*keys, "ord", "score"), parts, *keys).groupBy(*keys).agg(F.min(F.struct("ord", "score")).alias("x"))
    new = first.select("job_post_id", "skill_set_id", F.least(F.greatest("x.score", F.lit(0)), F.lit(100)).alias("new_score"))
    both = dealt(existing.select(*keys, "score"), parts, *keys).join(new, keys, "full")
    action = F.when(F.col("score").isNull(), "insert").when(F.col("new_score").isNull() | (F.col("score") == F.col("new_score")), "keep").otherwise("update")
    return both.select("job_post_id", "skill_set_id", F.coalesce("new_score", "score").alias("score"), action.alias("action"))


def archive(jobs: DataFrame, cutoff: str) -> DataFrame:
    """Jobs created before the cutoff, unless archived or applied for, become archived."""
    due = (F.col("created_at") < F.expr(f"TIMESTAMP_NTZ'{cutoff}'")) & ~F.col("status").isin("ARCHIVED", "APPLIED")
    return jobs.select("id", F.when(due, "ARCHIVED").otherwise(F.col("status")).alias("status"), due.alias("archived"))


def archive_payload(jobs: DataFrame, links: DataFrame) -> DataFrame:
    """One nested JSON text for each job with its links."""
    skill = F.struct(F.col("skill_set_id").alias("id"), F.col("score"))
    listed = links.groupBy("job_post_id").agg(F.array_sort(F.collect_list(skill)).alias("skill_sets")).withColumnRenamed("job_post_id", "id")
    rows = jobs.join(listed, "id", "left")
    return rows.select("id", F.to_json(F.struct("id", "title", "status", F.coalesce("skill_sets", F.array().cast("array<struct<id:bigint,score:int>>")).alias("skill_sets"))).alias("payload"))


def restore(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the listed ids: archived jobs become active, others are skipped."""
    return ids.select("id").join(jobs.select("id", "status"), "id", "left").select("id", F.when(F.col("status") == "ARCHIVED", "restored").otherwise("skipped").alias("outcome"))


def job_status_sync(jobs: DataFrame, applications: DataFrame) -> DataFrame:
    """Archived stays; any application makes a job applied; without one an applied job is active again."""
    has = applications.select(F.col("job_post_id").alias("id")).distinct().withColumn("has", F.lit(True))
    status = F.when(F.col("status") == "ARCHIVED", F.col("status")).when(F.col("has"), "APPLIED").when(F.col("status") == "APPLIED", "ACTIVE").otherwise(F.col("status"))
    return jobs.select("id", "status").join(has, "id", "left").select("id", status.alias("status"))


def copy_missing_links(applications: DataFrame, links: DataFrame, application_skills: DataFrame) -> DataFrame:
    """Skills of the job that the application lacks."""
    asked = applications.selectExpr("id AS application_id", "job_post_id").join(links.select("job_post_id", "skill_set_id", "score"), "job_post_id")
    return asked.select("application_id", "skill_set_id", "score").join(application_skills, ["application_id", "skill_set_id"], "left_anti")


def apply_transition(applications: DataFrame, as_of: str) -> DataFrame:
    """Saved applications become applied, at the given time unless they have one."""
    saved = F.col("status") == "SAVED"
    return applications.select(
        "id", F.when(saved, "APPLIED").otherwise(F.col("status")).alias("status"),
        F.when(saved, F.coalesce("applied_at", F.expr(f"TIMESTAMP_NTZ'{as_of}'"))).otherwise(F.col("applied_at")).alias("applied_at"), saved.alias("changed"),
    )


def candidate_merge(known: DataFrame, names: DataFrame, catalog: DataFrame, flag_at: int = 5) -> DataFrame:
    """Counts of names that no skill has, added to those known; flagged for review from ``flag_at`` on. Columns: normalized, n."""
    new = names.groupBy("normalized").agg(F.count("*").alias("more")).join(catalog.select("normalized").distinct(), "normalized", "left_anti")
    both = known.select("normalized", "n").join(new, "normalized", "full")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))
    return both.select("normalized", n.cast("long").alias("n"), (n >= flag_at).alias("flagged"))


def dedupe_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; a key's rows meet as a pre-aggregated min."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in (*order, *rest)])


def job_keys(jobs: DataFrame) -> DataFrame:
    """jobs with ``exact``, the external id or else the URL, and ``finger``, of title, company, location and type; null where they say nothing."""
    clean = lambda c: F.lower(collapse(F.coalesce(F.col(c), F.lit(""))))
    ident, url = (F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in ("external_id", "source_url"))
    exact = F.when(ident != "", F.concat(F.lit("external_id "), ident)).when(url != "", F.concat(F.lit("source_url "), url))
    finger = F.when((clean("title") != "") & (clean("company_name") != ""), F.concat_ws("\n", *map(clean, ("title", "company_name", "location", "job_type"))))
    return jobs.withColumns({"exact": exact, "finger": finger})


def _predecessors(rows: DataFrame, key: str) -> DataFrame:
    """rows (rid, source, ord, ...) with ``n_<key>``, 0, 1 or 2 (or more) rows of the key before, and ``p_<key>``, the only one.

    The two first rows of a key are pre-aggregated minima, so a key of any number of rows is split.
    """
    known = rows.where(F.col(key).isNotNull()).select(F.col("source").alias("s"), F.col(key).alias("k"), F.struct("ord", "rid").alias("at"))
    first = known.groupBy("s", "k").agg(F.min("at").alias("one"))
    later = known.withColumnsRenamed({"s": "s2", "k": "k2"}).join(first, F.col("s2").eqNullSafe(F.col("s")) & (F.col("k2") == F.col("k"))).where("at > one")
    second = later.groupBy("s", "k").agg(F.min("at").alias("two")).withColumnsRenamed({"s": "s2", "k": "k2"})
    ends = first.join(second, F.col("s2").eqNullSafe(F.col("s")) & (F.col("k2") == F.col("k")), "left").select("s", "k", "one", "two")
    out = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col(key) == F.col("k")), "left")
    n = F.when(F.col("one.rid").isNull() | (F.col("one.rid") == F.col("rid")), 0).when(F.col("two.rid") == F.col("rid"), 1).otherwise(2)
    return out.withColumns({f"n_{key}": n, f"p_{key}": F.when(n == 1, F.col("one.rid"))}).drop("s", "k", "one", "two")


def greedy_dedupe(rows: DataFrame) -> DataFrame:
    """Rows (source, ord, exact, finger, ...) in order: dropped if a kept row of the source has the exact key or the fingerprint.

    A null key equals no other. A dropped row registers neither key. ``ord`` is distinct within a source. In every round, an open row without open rows
    of its keys before it is kept, and one with a single such row is kept if that one isn't. Along chains of the latter, fates are
    composed by doubling, so a chain of n rows takes log n joins; then all rows that share a key with a kept one are dropped and the
    others wait. A row behind several open ones waits for a round in which they are decided: this choice by order is a greedy matching
    of keys and fingerprints, for which no method of few rounds is known, so rows that wait for one another in many levels take as many rounds.
    """
    shape = rows.columns
    open_ = cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()))
    kept: list[DataFrame] = []
    while not open_.isEmpty():
        marked = _predecessors(_predecessors(open_, "exact"), "finger")
        before = F.array_distinct(F.array_compact(F.array("p_exact", "p_finger")))
        several = (F.greatest("n_exact", "n_finger") > 1) | (F.size(before) > 1)
        free = F.greatest("n_exact", "n_finger") == 0
        to = F.when(free | several, F.col("rid")).otherwise(F.element_at(before, 1))
        fates = cut_lineage(marked.select("rid", to.alias("to"), (to != F.col("rid")).alias("flip"), free.alias("free")))
        while True:
            next_ = fates.select(F.col("rid").alias("mid"), F.col("to").alias("to2"), F.col("flip").alias("flip2"), F.col("free").alias("free2"))
            fates = cut_lineage(fates.join(next_, F.col("to") == F.col("mid")).select("rid", F.col("to2").alias("to"), (F.col("flip") != F.col("flip2")).alias("flip"), F.col("free2").alias("free"), (F.col("to") != F.col("to2")).alias("moved")))
            if fates.where("moved").isEmpty():
                break
        decided = open_.join(fates.where("free").select("rid", "flip"), "rid", "left")
        kept.append(cut_lineage(decided.where("NOT flip").select(*shape)))
        rest = decided.where("flip IS NULL").select("rid", *shape)
        for key in ("exact", "finger"):
            taken = kept[-1].where(F.col(key).isNotNull()).select(F.col("source").alias("s"), F.col(key).alias("k")).distinct()
            rest = rest.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col(key) == F.col("k")), "left_anti")
        open_ = cut_lineage(rest)
    out = kept[0] if kept else rows.limit(0)
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def keyword_sync(skills: DataFrame, existing: DataFrame) -> DataFrame:
    """Desired keywords of each skill (canonical before aliases, first of each text) against those stored: insert, keep or delete."""
    desired = skills.groupBy("skill_set_id", "normalized").agg(F.min(F.struct("ord", "raw")).alias("x")).select("skill_set_id", "normalized", F.lit(True).alias("wanted"))
    both = desired.join(existing.select("skill_set_id", "normalized", F.lit(True).alias("there")), ["skill_set_id", "normalized"], "full")
    action = F.when(F.col("wanted") & F.col("there"), "keep").when(F.col("wanted"), "insert").otherwise("delete")
    return both.select("skill_set_id", "normalized", action.alias("action"))


def ensure_keywords(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """The next state of keywords (skill_set_id, normalized, status): wanted ones are added, or take the wanted status."""
    both = existing.join(wanted.select("skill_set_id", "normalized", F.col("status").alias("new_status")), ["skill_set_id", "normalized"], "full")
    action = F.when(F.col("status").isNull(), "insert").when(F.col("new_status").isNull() | (F.col("new_status") == F.col("status")), "keep").otherwise("update")
    return both.select("skill_set_id", "normalized", F.coalesce("new_status", "status").alias("status"), action.alias("action"))


def manual_link_sync(links: DataFrame, desired: DataFrame) -> DataFrame:
    """Links (job_post_id, skill_set_id, source, score) after the manual ones of the jobs in ``desired`` (job_post_id, skill_set_id) are
    replaced; a null skill stands for none. Links of the pipeline stay, and new manual ones have score 0."""
    jobs = desired.select("job_post_id").distinct().withColumn("asked", F.lit(True))
    want = desired.where("skill_set_id IS NOT NULL").select("job_post_id", "skill_set_id").distinct().withColumn("want", F.lit(True))
    both = links.join(want, ["job_post_id", "skill_set_id"], "full").join(jobs, "job_post_id", "left")
    manual = F.col("source") == "MANUAL"
    action = F.when(F.col("source").isNull(), "insert").when(manual & F.coalesce("asked", F.lit(False)) & F.col("want").isNull(), "delete").otherwise("keep")
    return both.select("job_post_id", "skill_set_id", F.coalesce("source", F.lit("MANUAL")).alias("source"), F.coalesce("score", F.lit(0)).alias("score"), action.alias("action"))


def status_history(before: DataFrame, after: DataFrame, as_of: str) -> DataFrame:
    """One row (id, from_status, to_status, changed_at) for every application whose status changed or that is new."""
    both = after.select("id", F.col("status").alias("to_status")).join(before.select("id", F.col("status").alias("from_status")), "id", "left")
    return both.where("NOT (from_status <=> to_status)").select("id", "from_status", "to_status", F.expr(f"TIMESTAMP_NTZ'{as_of}'").alias("changed_at"))


def approve(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Mappings (id, source, is_approved) after the listed ones are approved by hand."""
    both = links.join(ids.select("id").distinct().withColumn("chosen", F.lit(True)), "id", "left")
    chosen = F.coalesce("chosen", F.lit(False))
    return both.select("id", F.when(chosen, "MANUAL").otherwise(F.col("source")).alias("source"), (chosen | F.col("is_approved")).alias("is_approved"))


def embedding_backfill(skills: DataFrame, limit: int) -> DataFrame:
    """(id, remaining) of the first skills without a vector, and how many are left after them."""
    open_ = skills.where("embedding IS NULL").select("id")
    left = open_.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))
    return open_.orderBy("id").limit(limit).crossJoin(left)


def backfill_job_type(jobs: DataFrame) -> DataFrame:
    """A blank job type becomes the employment type."""
    return jobs.select("id", F.coalesce(F.nullif("job_type", F.lit("")), F.nullif("employment_type", F.lit("")), F.lit("")).alias("job_type"))


def detail_gate(cards: DataFrame, stored: DataFrame, strategy: str = "new_or_missing", budget: int = 10) -> DataFrame:
    """(row_id, fetch) of cards (row_id, external_id, source_url): which pages to fetch, at most ``budget``, in order of row_id.

    ``all`` fetches every card, ``new_only`` those without a stored job, ``new_or_missing`` also those whose job has no description.
    """
    found = match_existing(cards, stored)
    both = found.join(stored.select(F.col("id").alias("existing_id"), "description"), "existing_id", "left")
    new = F.col("existing_id").isNull()
    wanted = {"all": F.lit(True), "new_only": new}.get(strategy, new | (F.coalesce(F.trim("description"), F.lit("")) == ""))
    marked = both.withColumn("wanted", wanted)
    first = marked.where("wanted").select("row_id").orderBy("row_id").limit(budget).withColumn("fetch", F.lit(True))
    return marked.select("row_id").join(first, "row_id", "left").select("row_id", F.coalesce("fetch", F.lit(False)).alias("fetch"))
