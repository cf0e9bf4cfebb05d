"""Answers of language models as rows, resume sections, evaluation of runs, and the state of a resume's pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.session import parts_for

ITEM = "array<struct<name: string, skill: string, source: string, confidence: string, source_fragment: string, reason: string>>"
# Fixed values.
SECTIONS = {
    "summary": ["summary", "profile", "objective"], "skills": ["skills", "technical skills", "technologies"], "experience": ["experience", "work experience", "employment"],
    "projects": ["projects", "project experience"], "education": ["education"], "certifications": ["certifications", "certificates"],
}
STEPS = ["text_extraction", "ollama_extract", "ollama_verify", "skillset_mapping", "job_match", "market_fit"]


def _listed(payload: Column, key: str) -> Column:
    return F.from_json(F.get_json_object(payload, f"$.{key}"), "array<string>")


def _by_answer(answers: DataFrame) -> DataFrame:
    """Answers dealt by id, into as many parts as their files ask for, before they are read: a file of a few megabytes is one task."""
    parts = parts_for(answers)
    return answers.select("id", "payload").repartition(*([parts] if parts else []), "id")


def _items(listed: Column, details: bool = True) -> Column:
    """The entries of a list, each an object or a plain name, as structs in order; every field is read once, without ``details`` the name alone."""

    def item(x: Column, i: Column) -> Column:
        field = lambda k: F.when(x.rlike(r"^\s*\{"), F.get_json_object(x, f"$.{k}"))
        name = F.when(x.rlike(r"^\s*\{"), F.coalesce(F.nullif(field("name"), F.lit("")), field("skill"), F.lit(""))).otherwise(x)
        if not details:
            return F.struct(i.alias("at"), T.display_name(name).alias("name"))
        return F.struct(i.alias("at"), T.display_name(name).alias("name"), T.let(field("confidence"), T.confidence).alias("confidence"),
                        F.substring(T.collapse(F.coalesce(field("source_fragment"), F.lit(""))), 1, 240).alias("fragment"),
                        F.substring(T.collapse(F.coalesce(field("reason"), F.lit(""))), 1, 300).alias("reason"))

    return F.transform(listed, item)


def parse_extracted(answers: DataFrame, most: int = 20, details: bool = True) -> DataFrame:
    """(id, at, name, confidence, fragment, error) of answers (id, payload): the first ``most`` distinct names, case ignored; an answer without any gives one row with an error.

    Without ``details`` confidence and fragment are neither read nor returned.

    An answer is read once, in the one expression that is exploded; a filter on its parts would be pushed below and read it again.
    """
    ok = F.try_parse_json("payload").isNotNull() & F.col("payload").rlike(r"^\s*\{")
    listed = T.let(_listed(F.col("payload"), "candidate_skills"), lambda first: F.when(F.size(F.coalesce(first, F.array())) > 0, first).otherwise(_listed(F.col("payload"), "skills")))
    fields = {"at": F.lit(0), "name": F.lit(None).cast("string")} | ({"confidence": F.lit(None).cast("double"), "fragment": F.lit(None).cast("string")} if details else {})
    row = lambda x, error: F.struct(*[x[c].alias(c) for c in fields], error.cast("string").alias("error"))
    bad = lambda error: F.array(row(fields, F.lit(error)))
    good = lambda l: F.transform(l, lambda x: row(x, F.lit(None)))
    rows = lambda l: (
        F.when(~F.coalesce(ok, F.lit(False)), bad("malformed")).when(F.size(F.coalesce(l, F.array())) == 0, bad("no skills")).when(F.exists(l, lambda x: x["name"] == ""), bad("empty name")).otherwise(good(l))
    )
    # dealt by id once, which serves the groups and the ranks
    each = _by_answer(answers).select("id", F.explode(T.let(_items(listed, details), rows)).alias("x"))
    one = each.groupBy("id", F.lower("x.name").alias("key")).agg(F.min("x").alias("x"))
    failed = F.col("x.error").isNotNull()
    rank = F.row_number().over(Window.partitionBy("id").orderBy("x.at"))
    kept = one.withColumn("at", F.when(failed, 0).otherwise(rank).cast("long")).where(F.col("at") <= most)
    return kept.select("id", "at", *[f"x.{c}" for c in fields if c != "at"], "x.error")


def parse_verified(answers: DataFrame, most: int = 20) -> DataFrame:
    """(id, verified, at, name) of answers: distinct verified names up to ``most``, then distinct rejected ones that aren't among them, up to what is left."""
    rows = _by_answer(answers).select("id", F.explode(F.array(*[F.struct(F.lit(good).alias("verified"), _items(_listed(F.col("payload"), key), details=False).alias("l")) for good, key in ((True, "verified_skills"), (False, "rejected_skills"))])).alias("s"))
    each = rows.select("id", "s.verified", F.explode("s.l").alias("x")).where("x.name <> ''")
    # a name's first place in both lists is one row, so it is known there whether a rejected name was taken
    one = each.groupBy("id", F.lower("x.name").alias("key")).agg(F.min(F.when(F.col("verified"), F.col("x"))).alias("v"), F.min(F.when(~F.col("verified"), F.col("x"))).alias("r"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("v.at").asc_nulls_last()))
    ranked = one.withColumn("place", place).withColumn("good", F.col("v").isNotNull() & (F.col("place") <= most)).where("good OR r IS NOT NULL")
    placed = ranked.withColumn("spot", F.row_number().over(Window.partitionBy("id", "good").orderBy("r.at"))).withColumn("taken", F.count_if("good").over(Window.partitionBy("id")))
    good = F.col("good")
    kept = placed.where(good | (F.col("spot") <= F.lit(most) - F.col("taken")))
    return kept.select("id", good.alias("verified"), F.when(good, F.col("place")).otherwise(F.col("spot")).cast("long").alias("at"), F.when(good, F.col("v.name")).otherwise(F.col("r.name")).alias("name"))


def parse_mapped(answers: DataFrame) -> DataFrame:
    """(id, canonical, confidence, reason, error): what a name was mapped to; a confidence that is no number is an error."""
    field = lambda k: T.collapse(F.get_json_object("payload", f"$.{k}"))
    ok = F.try_parse_json("payload").isNotNull() & F.col("payload").rlike(r"^\s*\{")
    number = F.coalesce(F.get_json_object("payload", "$.confidence"), F.lit("0")).try_cast("double")
    error = F.when(~F.coalesce(ok, F.lit(False)), "malformed").when(number.isNull(), "confidence")
    good = error.isNull()
    return answers.select(
        "id", F.when(good, F.nullif(field("canonical"), F.lit(""))).alias("canonical"), F.when(good, F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))).alias("confidence"),
        F.when(good, F.coalesce(field("reason"), F.lit(""))).alias("reason"), error.alias("error"),
    )


def section_fragments(jobs: DataFrame) -> DataFrame:
    """(id, label, text) of the sections (map) of jobs that aren't blank."""
    return jobs.select("id", F.explode("sections").alias("label", "text")).where(F.trim("text") != "")


def resume_sections(resumes: DataFrame) -> DataFrame:
    """(id, section, text) of resumes (id, text): a line that is a known heading begins a section, which may go on later; before any it is ``resume``.

    Lines of a text are folded in its row, so a section that appears twice is joined in order.
    """
    lines = F.transform(F.split("text", r"\r\n|[\r\n]"), lambda x: F.trim(x))
    heading = lambda x: F.lower(F.btrim(x, F.lit(":")))
    table = F.create_map(*[F.lit(x) for name, all_ in SECTIONS.items() for a in all_ for x in (a, name)])
    rows = resumes.select("id", F.posexplode(F.transform(lines, lambda x: F.struct(x.alias("line"), F.try_element_at(table, heading(x)).alias("starts")))).alias("at", "x"))
    current = F.last("x.starts", ignorenulls=True).over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = rows.withColumn("section", F.coalesce(current, F.lit("resume"))).where("x.starts IS NULL AND x.line <> ''")
    joined = kept.groupBy("id", "section").agg(F.array_sort(F.collect_list(F.struct("at", "x.line"))).alias("l"))
    return joined.select("id", "section", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def stability(runs: DataFrame, n_runs: int) -> DataFrame:
    """(normalized, n, stable) of names (run, name) that runs gave: stable if all runs did."""
    counted = runs.select(T.normalize_name(F.col("name")).alias("normalized")).groupBy("normalized").agg(F.count("*").alias("n"))
    return counted.select("normalized", "n", (F.col("n") == n_runs).alias("stable"))


def evaluate(runs: DataFrame) -> DataFrame:
    """runs (run, verified, mapped: arrays of names; expected, expected_mapped, reject, any_of: arrays; minimum_verified) with what fails.

    ``accepted`` are the verified and mapped names. A run passes if nothing expected is missing, nothing rejected is there, one of ``any_of``
    is accepted (if any is asked for) and enough names are verified. Names are compared in their normalised form.
    """
    n = {c: F.array_distinct(F.filter(F.transform(c, T.normalize_name), lambda x: x != "")) for c in ("verified", "mapped", "expected", "expected_mapped", "reject", "any_of")}
    rows = runs.withColumns(n).withColumn("accepted", F.array_sort(F.array_union("verified", "mapped")))
    sets = {
        "missing_expected": F.array_sort(F.array_except("expected", "verified")), "missing_mapped": F.array_sort(F.array_except("expected_mapped", "mapped")),
        "rejected_present": F.array_sort(F.array_intersect("reject", "accepted")),
    }
    rows = rows.withColumns(sets)
    any_fails = (F.size("any_of") > 0) & ~F.arrays_overlap("any_of", "accepted")
    few = F.size("verified") < F.coalesce("minimum_verified", F.lit(0))
    passed = (F.size("missing_expected") == 0) & (F.size("missing_mapped") == 0) & (F.size("rejected_present") == 0) & ~any_fails & ~few
    return rows.select("run", "accepted", *sets, any_fails.alias("any_of_fails"), few.alias("minimum_fails"), passed.alias("passed"))


def pipeline_status(logs: DataFrame, fallback: DataFrame) -> DataFrame:
    """(resume_id, finished, progress, statuses): six ordered steps; the newest log row wins over the stored state, else a step is pending."""
    newest = logs.where(F.col("step_name").isin(STEPS)).groupBy("resume_id", "step_name").agg(F.max_by("status", F.struct("created_at", "id")).alias("logged"))
    ids = logs.select("resume_id").union(fallback.select("resume_id")).distinct()
    rows = ids.select("resume_id", F.posexplode(F.array(*map(F.lit, STEPS))).alias("at", "step_name"))
    rows = rows.join(newest, ["resume_id", "step_name"], "left").join(fallback.select("resume_id", "step_name", "status"), ["resume_id", "step_name"], "left")
    state = F.coalesce("logged", "status", F.lit("PENDING"))
    done = state.isin("SUCCESS", "FAILED", "SKIPPED")
    per = rows.groupBy("resume_id").agg(F.count_if(done).alias("finished"), F.array_sort(F.collect_list(F.struct("at", state.alias("s")))).alias("l"))
    return per.select("resume_id", "finished", F.round(F.col("finished") * 100 / len(STEPS), 2).alias("progress"), F.array_join(F.transform("l", lambda x: x["s"]), ",").alias("statuses"))
