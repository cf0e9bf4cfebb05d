"""Analyses of many resumes at once: names that no index knows, jobs, market fit, gaps and profiles, each a plan over all of them.

A resume is an ``owner``. Names are worked out once over all owners, skills once over all who have them, and only then joined to owners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.functions.numbers import percentage
from demandlens.operators import answers, matching, resolution
from demandlens.session import cut_lineage, dealt, parts_for

NO_SKILL = "no matching SkillSet"
#: Pairs of owner and job need so many parts for each one of the links.
PAIRS = 4


def resolved_names(names: DataFrame, skills: DataFrame, keywords: DataFrame, alias_rows: DataFrame, picks: DataFrame, nearest: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """(name, normalized, skill_id, confidence, source, reason) of the distinct names: an alias, a name, else the model's pick among candidates.

    picks: answers (id, payload) by normalised name; of several for one name the least text counts. nearest: candidates by vectors
    (query_id: normalised name, skill_id, rank), which come before those of like words. A pick counts from the confidence ``least``
    on and only if it names a candidate. Sources: empty, alias, exact, unresolved (no candidates), ollama_error (no or a
    broken answer), low_confidence, invalid_canonical, rag. Null and blank names are ``empty``.
    """
    first = cut_lineage(resolution.alias_resolve(names.select("name").distinct(), skills, alias_rows))
    open_ = first.where("source IS NULL").select("name", "normalized")
    asked = cut_lineage(open_.select(F.col("normalized").alias("query_id"), F.col("normalized").alias("query")).distinct())
    meant = skills.select(F.col("id").alias("skill_id"), T.normalize_name(F.col("name")).alias("normalized"))
    found = resolution.catalog_candidates(asked, skills, keywords).select("query_id", "skill_id", "rank")
    if nearest is None:
        offered = found.join(meant, "skill_id").select("query_id", "skill_id", "normalized", "rank")
    else:
        near = nearest.join(asked, "query_id", "left_semi").select("query_id", "skill_id", F.col("rank").cast("long").alias("rank"))
        offered = resolution.merged_candidates(near.join(meant, "skill_id"), found.join(meant, "skill_id"))
    offered = cut_lineage(offered.groupBy(F.col("query_id").alias("normalized"), F.col("normalized").alias("offer")).agg(F.min_by("skill_id", F.struct("rank", "skill_id")).alias("offer_id")))
    one = answers.parse_mapped(picks.groupBy("id").agg(F.min("payload").alias("payload")))
    picked = one.select(F.col("id").alias("normalized"), T.normalize_name(F.col("canonical")).alias("offer"), F.col("confidence").alias("sure"), "reason", "error", F.lit(True).alias("answered"))
    rows = open_.join(offered.select("normalized").distinct().withColumn("offers", F.lit(True)), "normalized", "left").join(picked, "normalized", "left").join(offered, ["normalized", "offer"], "left")
    broken = F.col("answered").isNull() | F.col("error").isNotNull()
    kind = F.when(F.col("offers").isNull(), "unresolved").when(broken, "ollama_error").when(F.col("sure") < least, "low_confidence").when(F.col("offer_id").isNull(), "invalid_canonical").otherwise("rag")
    rows = rows.withColumn("source", kind)
    judged = rows.select(
        "name", "normalized", F.when(F.col("source") == "rag", F.col("offer_id")).alias("skill_id"), F.when(F.col("source").isin("unresolved", "ollama_error"), 0.0).otherwise(F.col("sure")).alias("confidence"), "source",
        F.when(F.col("source") == "unresolved", "no candidates").when(F.col("source") == "ollama_error", F.coalesce("error", F.lit("no answer"))).when(F.col("source") == "invalid_canonical", "not a candidate").otherwise(F.coalesce("reason", F.lit(""))).alias("reason"),
    )
    known = first.where("source IS NOT NULL").select("name", "normalized", "skill_id", F.when(F.col("source") == "empty", 0.0).otherwise(1.0).alias("confidence"), "source", F.lit("").alias("reason"))
    return known.unionByName(judged)


def augmented(mapped: DataFrame, resolved: DataFrame) -> DataFrame:
    """mapped (of ``map_skills``) in which names without a skill take the one they were resolved to, with ``source`` (index or the resolution's).

    Only names with the outcome ``no matching SkillSet`` change, never rejected ones. A skill that its owner has already, by the index or by a
    name that comes first in the alphabet, isn't given again: outcome ``already matched``. Nothing is created.
    """
    found = resolved.where("skill_id IS NOT NULL").select("name", F.col("skill_id").alias("found"), F.col("source").alias("by"))
    open_ = F.col("outcome") == NO_SKILL
    rows = mapped.withColumn("asked", F.when(open_, F.col("name"))).join(found.withColumnRenamed("name", "asked"), "asked", "left")
    own = mapped.where("outcome = 'matched'").select("owner", F.col("skill_id").alias("found")).distinct()
    first = rows.where("found IS NOT NULL").groupBy("owner", "found").agg(F.min("normalized").alias("normalized")).join(own, ["owner", "found"], "left_anti").withColumn("first", F.lit(True))
    both = rows.join(first, ["owner", "found", "normalized"], "left")
    hit = F.col("found").isNotNull()
    return both.select(
        "owner", "normalized", "name", F.when(hit & F.col("first"), F.col("found")).otherwise(F.col("skill_id")).alias("skill_id"),
        F.when(~hit, F.col("outcome")).when(F.col("first"), "matched").otherwise("already matched").alias("outcome"), F.when(hit, F.col("by")).when(F.col("outcome") == "matched", "index").alias("source"),
    )


def auto_created(mapped: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mapped with names without a skill created, and the new skills (normalized, name): each name once, spelt as the least owner spells it.

    A name that a skill outside the index has (an inactive one) is matched to it instead. New skills have no id until they are stored; their
    rows say ``created``.
    """
    have = skills.groupBy(T.normalize_name(F.col("name")).alias("normalized")).agg(F.min("id").alias("have"))
    rows = mapped.join(have, "normalized", "left")
    open_ = F.col("outcome") == NO_SKILL
    out = rows.select(
        "owner", "normalized", "name", F.when(open_, F.col("have")).otherwise(F.col("skill_id")).alias("skill_id"),
        F.when(open_ & F.col("have").isNull(), "created").when(open_, "matched").otherwise(F.col("outcome")).alias("outcome"),
    )
    new = out.where("outcome = 'created'").groupBy("normalized").agg(F.min_by("name", F.struct("owner", "name")).alias("name"))
    return out, new.select("normalized", T.display_name(F.col("name")).alias("name"))


def job_matches(owned: DataFrame, links: DataFrame, jobs: DataFrame, companies: DataFrame, limit: int = 20) -> DataFrame:
    """(owner, job_post_id, matched, required, match_percent, rank): for each owner (owner, skill_set_id) the jobs that share most of their skills.

    Best share first, then most skills, company and title, case ignored, then the job's id; archived jobs included. Jobs get their number of skills
    and their place by names before they meet owners, so pairs of owner and job are numbers alone and are shuffled once, to their owner.
    """
    asked = links.select("job_post_id", "skill_set_id").distinct()
    required = asked.groupBy("job_post_id").agg(F.count("*").alias("required"))
    about = jobs.select(F.col("id").alias("job_post_id"), F.lower("title").alias("title"), "company_id").join(companies.select(F.col("id").alias("company_id"), F.lower("name").alias("company")), "company_id", "left")
    # sorted by range, so that these numbers rise with company, title and id
    placed = about.orderBy("company", "title", "job_post_id").select("job_post_id", F.monotonically_increasing_id().alias("place"))
    pairs = asked.join(required.join(placed, "job_post_id"), "job_post_id").join(owned.select("owner", "skill_set_id").distinct(), "skill_set_id").drop("skill_set_id")
    met = dealt(pairs, PAIRS * parts_for(links), "owner").groupBy("owner", "job_post_id", "required", "place").agg(F.count("*").alias("matched"))
    rows = met.withColumn("match_percent", percentage(F.col("matched"), F.col("required")))
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("match_percent"), F.desc("matched"), "place"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).select("owner", "job_post_id", "matched", "required", "match_percent", F.col("rank").cast("long").alias("rank"))


def market_fits(owned: DataFrame, vectors: DataFrame, skills: DataFrame, demands: DataFrame) -> DataFrame:
    """(owner, fit_percent, matched, skills) of each owner with an active skill: the best match of a skill is found once, whoever has it."""
    mine = owned.select("owner", "skill_set_id").distinct()
    best = matching.market_matches(mine.select("skill_set_id").distinct(), vectors, skills, demands)
    return matching.market_fit(mine.join(best.withColumnRenamed("query_id", "skill_set_id"), "skill_set_id"), "owner")


def _lacking(owned: DataFrame, ranked: DataFrame, key: str, first: int) -> DataFrame:
    """(owner, places): for each owner the first places of a short list (place, key, ...) whose keys it doesn't have, in order; owners meet places, not each other."""
    every = ranked.agg(F.sort_array(F.collect_list("place")).alias("every"))
    held = owned.join(F.broadcast(ranked.select(key, "place")), key, "left").groupBy("owner").agg(F.collect_set("place").alias("held"))
    return held.crossJoin(F.broadcast(every)).select("owner", F.slice(F.array_except("every", "held"), 1, first).alias("places"))


def gap_skills(owned: DataFrame, demands: DataFrame, skills: DataFrame, limit: int = 15) -> DataFrame:
    """(owner, skill_set_id, demand_score, priority, missing_rank, rank): of the ``2 * limit`` skills in most demand the first ``limit`` that an owner lacks.

    ``missing_rank`` goes by demand, then name; ``rank`` by priority, which adds 25 for rising skills, then name, case ignored.
    """
    top = demands.join(skills.select(F.col("id").alias("skill_set_id"), "name"), "skill_set_id").orderBy(F.desc("demand_score"), "name", "skill_set_id").limit(2 * limit)
    place = F.row_number().over(Window.orderBy(F.desc("demand_score"), "name", "skill_set_id"))  # over the list only
    ranked = top.select("skill_set_id", "name", "demand_score", F.round(F.col("demand_score") + F.when(F.col("trend_type") == "rising", 25).otherwise(0), 2).alias("priority"), place.alias("place"))
    turn = F.row_number().over(Window.orderBy(F.desc("priority"), F.lower("name"), "place"))  # over the list only
    ranked = cut_lineage(ranked.withColumn("turn", turn).drop("name"))
    turns = ranked.agg(F.map_from_entries(F.collect_list(F.struct("place", "turn"))).alias("turns"))
    lacks = _lacking(owned.select("owner", "skill_set_id"), ranked, "skill_set_id", limit).crossJoin(F.broadcast(turns))
    by_turn = F.transform(F.array_sort(F.transform("places", lambda p: F.struct(F.col("turns")[p].alias("turn"), p.alias("place")))), lambda x: x["place"])
    rows = lacks.select("owner", "places", F.posexplode(by_turn).alias("at", "place")).join(F.broadcast(ranked), "place")
    return rows.select("owner", "skill_set_id", "demand_score", "priority", F.array_position("places", F.col("place")).alias("missing_rank"), (F.col("at") + 1).cast("long").alias("rank"))


def gap_categories(owned: DataFrame, members: DataFrame, counts: DataFrame, limit: int = 15) -> DataFrame:
    """(owner, category, job_count, rank): of the ``limit`` largest categories (category, job_count) those in which an owner has no skill.

    members: (skill_set_id, category), a skill in as many as it likes. Larger ones first, then by name, case ignored.
    """
    order = [F.desc("job_count"), F.lower("category"), F.col("category")]
    top = counts.where("job_count > 0").orderBy(*order).limit(limit)
    ranked = cut_lineage(top.select("category", "job_count", F.row_number().over(Window.orderBy(*order)).alias("place")))  # over the list only
    within = owned.select("owner", "skill_set_id").join(members.select("skill_set_id", "category"), "skill_set_id", "left").select("owner", "category").distinct()
    rows = _lacking(within, ranked, "category", limit).select("owner", F.posexplode("places").alias("at", "place")).join(F.broadcast(ranked), "place")
    return rows.select("owner", "category", "job_count", (F.col("at") + 1).cast("long").alias("rank"))


def profiles(owned: DataFrame, members: DataFrame) -> DataFrame:
    """(owner, category, n, percent): skills of each owner in each category, in whole percents that add up to 100."""
    counts = owned.select("owner", "skill_set_id").distinct().join(members.select("skill_set_id", "category").distinct(), "skill_set_id").groupBy("owner", "category").agg(F.count("*").alias("n"))
    return matching.whole_percentages(counts, "n", ["category"], ["owner"])


def verified_rows(resumes: DataFrame, extracted: DataFrame, verified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resumes with the step that they fail at, verified names, rejected names) from resumes (id, text) and answers (id, payload).

    Names are (owner, ord, name), compound ones taken apart. A verified name counts if it was extracted. Resumes fail without text,
    extracted names or verified names; ``failed`` is null for the others, ``chars``, ``candidates`` and ``verified`` count what the steps gave.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    texts = resumes.select(F.col("id").alias("owner"), F.length(F.array_join(kept, "\n")).cast("long").alias("chars"))
    named = answers.parse_extracted(extracted).where("error IS NULL").select(F.col("id").alias("owner"), F.lower("name").alias("key")).join(texts.where("chars > 0").select("owner"), "owner", "left_semi")
    checked = cut_lineage(answers.parse_verified(verified).select(F.col("id").alias("owner"), "verified", "at", "name", F.lower("name").alias("key")).join(named, ["owner", "key"], "left_semi"))
    n_named, n_checked = named.groupBy("owner").agg(F.count("*").alias("candidates")), checked.where("verified").groupBy("owner").agg(F.count("*").alias("verified"))
    state = texts.join(n_named, "owner", "left").join(n_checked, "owner", "left").fillna(0, ["candidates", "verified"])
    failed = F.when(F.col("chars") == 0, "text_extraction").when(F.col("candidates") == 0, "ollama_extract").when(F.col("verified") == 0, "ollama_verify")
    state = cut_lineage(state.withColumn("failed", failed))
    parts = checked.join(state.where("failed IS NULL").select("owner"), "owner", "left_semi").select("owner", "verified", "at", F.posexplode(T.compound_names(F.col("name"))).alias("part", "name"))
    rows = parts.select("owner", "verified", F.struct("at", "part").alias("ord"), "name")
    return state, rows.where("verified").drop("verified"), rows.where("NOT verified").drop("verified")


def analyze(resumes: DataFrame, extracted: DataFrame, verified: DataFrame, picks: DataFrame, skills: DataFrame, keywords: DataFrame, alias_rows: DataFrame, links: DataFrame, jobs: DataFrame, companies: DataFrame,
            vectors: DataFrame, demands: DataFrame, limit: int = 20) -> dict[str, DataFrame]:
    """All results of resumes: ``steps`` (owner, step, status, n), ``mapped``, ``owned``, ``job_matches`` and ``market_fit``.

    A resume that fails at a step has rows up to it, the last with the status failed and no count; others have all six. Counts: characters,
    candidates, verified names, mapped skills, jobs found, skills that meet the market. demands: (skill_set_id, demand) of active jobs.
    """
    state, good, bad = verified_rows(resumes, extracted, verified)
    index = resolution.skill_index(skills.where("is_active"), keywords, alias_rows)
    first = cut_lineage(resolution.map_skills(good, bad, index))
    mapped = cut_lineage(augmented(first, resolved_names(first.where(F.col("outcome") == NO_SKILL), skills, keywords, alias_rows, picks)))
    owned = mapped.where("skill_id IS NOT NULL").select("owner", F.col("skill_id").alias("skill_set_id")).distinct()
    found = cut_lineage(job_matches(owned, links, jobs, companies, limit))
    fits = cut_lineage(market_fits(owned, vectors, skills, demands))
    per = state.join(mapped.where("outcome = 'matched'").groupBy("owner").agg(F.count("*").alias("n_mapped")), "owner", "left").join(found.groupBy("owner").agg(F.count("*").alias("n_jobs")), "owner", "left")
    per = per.join(fits.select("owner", F.col("matched").alias("n_fit")), "owner", "left").fillna(0, ["n_mapped", "n_jobs", "n_fit"])
    counts = dict(zip(answers.STEPS, ["chars", "candidates", "verified", "n_mapped", "n_jobs", "n_fit"], strict=True))
    steps = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(s).alias("step"), F.col(c).alias("n")) for k, (s, c) in enumerate(counts.items())])
    rows = per.select("owner", "failed", F.explode(steps).alias("x")).withColumn("last", F.array_position(F.array(*map(F.lit, answers.STEPS)), F.col("failed")))
    rows = rows.where(F.col("failed").isNull() | (F.col("x.at") < F.col("last")))
    fails = F.col("failed").eqNullSafe(F.col("x.step"))
    shown = rows.select("owner", "x.step", F.when(fails, "failed").otherwise("success").alias("status"), F.when(~fails, F.col("x.n")).alias("n"))
    return {"steps": shown, "mapped": mapped, "owned": owned, "job_matches": found, "market_fit": fits}
