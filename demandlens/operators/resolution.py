"""Resolution of skill names: index, aliases, ladder, lexical candidates, mapping, evidence scores.

skills: id, name, aliases (array), is_active. keywords: skill_set_id, raw_text, of those in use. alias_rows: alias, skill_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.operators.fuzzy import by_deletions, containing, weighted_matches
from demandlens.session import cut_lineage


def skill_terms(skills: DataFrame, keywords: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """(normalized, skill_id, kind, rank) of every name of a skill: its own, keywords, aliases, alias rows, in this order of rank."""
    own = skills.select(T.normalize_name(F.col("name")).alias("normalized"), F.col("id").alias("skill_id"), F.lit("normalized_name").alias("kind"), F.lit(1).alias("rank"))
    words = keywords.select(T.normalize_name(F.col("raw_text")).alias("normalized"), F.col("skill_set_id").alias("skill_id"), F.lit("keyword").alias("kind"), F.lit(2).alias("rank"))
    listed = skills.select(F.explode("aliases").alias("a"), F.col("id").alias("skill_id")).select(T.normalize_name(F.col("a")).alias("normalized"), "skill_id", F.lit("alias").alias("kind"), F.lit(3).alias("rank"))
    rows = alias_rows.select(T.normalize_name(F.col("alias")).alias("normalized"), "skill_id", F.lit("skill_alias").alias("kind"), F.lit(4).alias("rank"))
    return own.unionByName(words).unionByName(listed).unionByName(rows).where("normalized <> ''")


def skill_index(skills: DataFrame, keywords: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """(normalized, skill_id, kind): one skill for each name; the kind of least rank wins, then the least skill id."""
    best = skill_terms(skills, keywords, alias_rows).groupBy("normalized").agg(F.min(F.struct("rank", "skill_id", "kind")).alias("x"))
    return best.select("normalized", "x.skill_id", "x.kind")


def alias_resolve(names: DataFrame, skills: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """names (name, ...) with skill_id: of an alias of the same text, case ignored, else of a skill of the same normalised name."""
    alias = alias_rows.groupBy(F.lower("alias").alias("a_key")).agg(F.min("skill_id").alias("by_alias"))
    exact = skills.groupBy(T.normalize_name(F.col("name")).alias("n_key")).agg(F.min("id").alias("by_name"))
    rows = names.withColumns({"a": F.lower(T.clean_keyword(F.col("name"))), "n": T.normalize_name(T.clean_keyword(F.col("name")))})
    rows = rows.join(alias.hint("merge"), rows["a"] == alias["a_key"], "left").join(exact.hint("merge"), rows["n"] == exact["n_key"], "left")
    kind = F.when(F.coalesce("a", F.lit("")) == "", "empty").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_name").isNotNull(), "exact")
    found = F.when(kind == "empty", F.lit(None)).otherwise(F.coalesce("by_alias", "by_name"))
    return rows.select(*names.columns, F.col("n").alias("normalized"), found.cast("long").alias("skill_id"), kind.alias("source"))


def edit_ratio(a: Column, b: Column) -> Column:
    """100 less the share of edits in the longer text."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, F.round((1 - F.levenshtein(a, b) / longer) * 100, 4)).otherwise(100.0)


def fuzzy_matches(names: DataFrame, skills: DataFrame, threshold: float = 90.0) -> DataFrame:
    """(normalized, skill_id, score): for each distinct name the most similar skill name by edits, from the threshold on.

    A name of n characters within a ratio r differs in at most d = n' (1 - r) edits of the longer length n', so of d + 1 pieces of
    the shorter name one stands in the other at its place, give or take d. Names are joined on such pieces and on their
    lengths, which loses none; only these pairs are compared. Names within one edit of a skill are found first, by what is left of both texts
    without one character, so that the pieces of a catalog of many names alike are asked for the others only.
    """
    slack = 1 - threshold / 100
    least = 1.0 - slack

    def pieces(size: Column) -> Column:
        """One more than the edits that a name of ``size`` characters allows."""
        return F.floor(F.ceil(size / F.lit(least)) * slack + 1e-9).cast("int") + 1

    def cut(rows: DataFrame) -> DataFrame:
        """Rows (size, ...) once for each piece of a name of that size, with its place and width."""
        out = rows.withColumn("parts", pieces(F.col("size"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        begin, end = (F.floor(F.col("size") * (F.col("k") + i) / F.col("parts")).cast("int") for i in (0, 1))
        return out.withColumns({"at": begin, "width": end - begin})

    own = cut_lineage(skills.groupBy(T.normalize_name(F.col("name")).alias("skill_name")).agg(F.min("id").alias("skill_id")).where("skill_name <> ''"))
    whole = cut_lineage(names.select("normalized").where("normalized <> ''").distinct())

    def best(pairs: DataFrame) -> DataFrame:
        scored = pairs.distinct().withColumn("score", edit_ratio(F.col("normalized"), F.col("skill_name"))).where(F.col("score") >= threshold)
        return scored.groupBy("normalized").agg(F.min(F.struct((-F.col("score")).alias("s"), "skill_name")).alias("x"))

    # what one edit leaves is in both texts; a name with such a match can't do better or as well with more edits
    one = cut_lineage(best(by_deletions(whole, own.select("skill_name")).where(F.levenshtein("normalized", "skill_name") <= 1)))
    rest = cut_lineage(whole.join(one.hint("merge"), "normalized", "left_anti"))
    filed = cut(own.withColumn("size", F.length("skill_name"))).withColumn("piece", F.substring("skill_name", F.col("at") + 1, F.col("width")))
    n = F.length("normalized")
    sizes = F.sequence(F.floor(n * F.lit(least)).cast("int"), F.ceil(n / F.lit(least)).cast("int"))
    asked = rest.select("normalized", F.explode(sizes).alias("size")).where("size > 0")
    wide = cut(asked).withColumn("shift", F.explode(F.sequence(-F.col("parts") + 1, F.col("parts") - 1))).where("at + shift >= 0")
    probe = wide.select("normalized", "size", "at", F.substring("normalized", F.col("at") + F.col("shift") + 1, F.col("width")).alias("piece")).where("piece <> ''").distinct()
    pairs = probe.join(filed.select("skill_name", "size", "at", "piece").hint("merge"), ["size", "at", "piece"]).select("normalized", "skill_name")
    found = one.unionByName(best(pairs)).select("normalized", "x.skill_name", (-F.col("x.s")).alias("score"))
    return found.join(own.hint("merge"), "skill_name").select("normalized", "skill_id", "score")


def resolve(names: DataFrame, skills: DataFrame, alias_rows: DataFrame, threshold: float = 90.0) -> DataFrame:
    """names with skill_id, confidence and source: alias, exact, fuzzy (the weighted ratio), else unmapped; ``empty`` for a name without text."""
    first = cut_lineage(alias_resolve(names, skills, alias_rows))
    fuzzy = weighted_matches(first.where("source IS NULL"), skills, threshold).withColumnsRenamed({"normalized": "f_key", "skill_id": "f_id"})
    both = first.join(fuzzy.hint("merge"), first["normalized"] == fuzzy["f_key"], "left")
    open_ = F.col("source").isNull()
    return both.select(
        *names.columns, F.coalesce("skill_id", F.when(open_, F.col("f_id"))).alias("skill_id"),
        F.when(F.col("source").isin("alias", "exact"), 1.0).when(open_ & F.col("f_id").isNotNull(), F.round(F.col("score") / 100, 4)).otherwise(0.0).alias("confidence"),
        F.coalesce("source", F.when(F.col("f_id").isNotNull(), "fuzzy"), F.lit("unmapped")).alias("source"),
    )


#: Words of more terms than this are frequent: skills that share no others with a query are scored by classes.
FREQUENT = 100


def catalog_candidates(queries: DataFrame, skills: DataFrame, keywords: DataFrame, limit: int = 10, frequent: int = FREQUENT) -> DataFrame:
    """(query_id, skill_id, score, confidence, rank): the skills that share most words or phrases with a query (query_id, query).

    A name scores 8 for standing in the query or the reverse, 4 for each shared word, 2 if all its words are there; an alias or
    keyword 6 and 3. Skills that share a word of few terms or a phrase with a query are scored one by one. The others can't be told apart by
    more than their frequent words: those of the same ones in all terms are a class, scored once for all queries of the same frequent words, of
    which only the first by name can be among the best. A skill's score by its class is at most its own, so none is lost.
    """
    active = skills.where("is_active").select(F.col("id").alias("skill_id"), F.lower("name").alias("folded"))
    terms = skill_terms(skills.where("is_active"), keywords, skills.sparkSession.createDataFrame([], "alias string, skill_id long"))
    terms = terms.join(active.select("skill_id").hint("merge"), "skill_id", "left_semi").select("skill_id", "normalized", (F.col("rank") == 1).alias("own")).distinct()
    # both are read several times below: stored once, so that names aren't taken apart again
    terms = cut_lineage(terms.withColumn("words", T.tokens(F.col("normalized"))))
    asked = queries.select("query_id", T.normalize_name(F.col("query")).alias("q"), T.expanded_tokens(T.normalize_name(F.col("query"))).alias("tokens")).where("q <> '' AND size(tokens) > 0")
    asked = cut_lineage(asked)
    by_text = asked.groupBy("q").agg(F.first("tokens").alias("tokens"))
    wanted = by_text.select("q", F.explode("tokens").alias("w"))
    listed = terms.select("skill_id", "normalized", "own", F.size("words").alias("n_words"), F.explode("words").alias("w"))
    counts = listed.groupBy("w").agg(F.count("*").alias("n")).join(wanted.select("w").distinct(), "w", "left_semi")
    counts = cut_lineage(counts.select("w", (F.col("n") > frequent).alias("common")))
    rare, common = counts.where("NOT common").select("w"), counts.where("common").select("w")

    # one by one: a rare word or a phrase in common
    texts, names = by_text.select("q"), terms.select("normalized").distinct()
    held = containing(texts.withColumnRenamed("q", "long"), names.withColumnRenamed("normalized", "short")).selectExpr("long AS q", "short AS normalized")
    holds = containing(names.withColumnRenamed("normalized", "long"), texts.withColumnRenamed("q", "short")).selectExpr("short AS q", "long AS normalized")
    phrase = held.unionByName(holds).join(terms.select("skill_id", "normalized").hint("merge"), "normalized").select("q", "skill_id")
    by_word = wanted.join(rare, "w").join(listed.select("w", "skill_id").hint("merge"), "w").select("q", "skill_id")
    met = by_word.unionByName(phrase).distinct().join(by_text, "q").join(terms.hint("merge"), "skill_id")
    own, n = F.col("own"), F.size(F.array_intersect("tokens", "words"))
    points = F.when(F.col("q").contains(F.col("normalized")) | F.col("normalized").contains(F.col("q")), F.when(own, 8).otherwise(6)).otherwise(0) + n * F.when(own, 4).otherwise(3)
    points = points + F.when(own & (n > 0) & (n == F.size("words")), 2).otherwise(0)
    single = met.withColumn("points", points).groupBy("q", "skill_id").agg(F.sum("points").alias("score"))
    single = single.join(active.hint("merge"), "skill_id").select("q", F.struct("folded", "skill_id").alias("place"), "score")

    # by classes
    of_term = listed.join(common, "w").groupBy("skill_id", "normalized", "own", "n_words").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    of_term = of_term.select("skill_id", F.struct("own", "ws", (F.col("own") & (F.size("ws") == F.col("n_words"))).alias("whole")).alias("term"))
    classes = of_term.groupBy("skill_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).join(active.hint("merge"), "skill_id")
    classes = classes.select("terms", F.struct("folded", "skill_id").alias("place"))
    by_place = F.row_number().over(Window.partitionBy("terms").orderBy("place"))
    members = cut_lineage(classes.withColumn("k", by_place).where(F.col("k") <= limit))
    kinds = members.where("k = 1").select("terms", F.col("place").alias("first"))
    of_text = cut_lineage(wanted.join(common, "w").groupBy("q").agg(F.sort_array(F.collect_list("w")).alias("shared")))
    words = of_text.select("shared").distinct()
    in_class = kinds.select("terms", "first", F.explode(F.array_distinct(F.flatten("terms.ws"))).alias("w"))
    pairs = words.select("shared", F.explode("shared").alias("w")).join(in_class, "w").select("shared", "terms", "first").distinct()
    common_words = lambda t: F.size(F.array_intersect(t["ws"], F.col("shared")))
    worth = lambda t: common_words(t) * F.when(t["own"], 4).otherwise(3) + F.when(t["whole"] & (common_words(t) == F.size(t["ws"])), 2).otherwise(0)
    pairs = pairs.withColumn("score", F.aggregate("terms", F.lit(0), lambda s, t: s + worth(t)))
    best = F.row_number().over(Window.partitionBy("shared").orderBy(F.desc("score"), "first"))
    kept = pairs.withColumn("k", best).where(F.col("k") <= limit).select("shared", "terms", "score").join(members.select("terms", "place"), "terms")
    first = F.row_number().over(Window.partitionBy("shared").orderBy(F.desc("score"), "place"))
    kept = kept.withColumn("k", first).where(F.col("k") <= limit).select("shared", "place", "score")
    several = of_text.join(kept, "shared").select("q", "place", F.col("score").cast("long").alias("score"))

    both = single.unionByName(several).groupBy("q", "place").agg(F.max("score").alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "place"))
    top = both.withColumn("rank", rank).where(F.col("rank") <= limit)
    out = asked.select("query_id", "q").join(top, "q")
    return out.select("query_id", "place.skill_id", "score", F.least(F.lit(0.79), F.round(F.col("score") / 20, 4)).alias("confidence"), F.col("rank").cast("long").alias("rank"))


def merged_candidates(vector: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates of both kinds (query_id, skill_id, normalized, rank): vector ones first, the first of each normalised name."""
    both = vector.select("query_id", "skill_id", "normalized", F.struct(F.lit(0).alias("kind"), "rank", "skill_id").alias("place")).unionByName(
        catalog.select("query_id", "skill_id", "normalized", F.struct(F.lit(1).alias("kind"), "rank", "skill_id").alias("place"))
    )
    first = both.groupBy("query_id", "normalized").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return first.select("query_id", F.col("place.skill_id").alias("skill_id"), "normalized", F.when(F.col("place.kind") == 0, "vector").otherwise("catalog").alias("source"), rank.cast("long").alias("rank"))


def map_skills(verified: DataFrame, rejected: DataFrame, index: DataFrame) -> DataFrame:
    """(owner, normalized, name, skill_id, outcome) of names (owner, ord, name): matched or unmapped, each name of an owner once.

    Verified names come before rejected ones; a rejected name is never matched.
    """
    told = lambda rows, good: rows.select("owner", "ord", "name", F.lit(good).alias("verified"))
    return map_told(told(verified, True).unionByName(told(rejected, False)), index)


def map_told(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The same of names (owner, ord, name, verified) that are one table, which is read once."""
    cleaned = rows.select("owner", T.normalize_name(F.col("name")).alias("normalized"), F.struct((~F.col("verified")).alias("bad"), "ord", "name").alias("x"))
    first = cleaned.where("x.bad OR normalized <> ''").groupBy("owner", "normalized").agg(F.min("x").alias("x")).join(index.select("normalized", F.col("skill_id").alias("found")), "normalized", "left")
    bad = F.col("x.bad")
    return first.select(
        "owner", "normalized", F.col("x.name").alias("name"), F.when(~bad, F.col("found")).alias("skill_id"),
        F.when(bad, "rejected during verification").when(F.col("found").isNull(), "no matching SkillSet").otherwise("matched").alias("outcome"),
    )


def evidence_texts(jobs: DataFrame) -> DataFrame:
    """jobs with the texts that ``evidence_score`` looks into; made before jobs are joined to skills, they are made once for each job."""
    label = lambda x: T.evidence_text(x["label"])
    asks = F.filter("fragments", lambda x: x["label"].isNull() | label(x).contains("requirement") | label(x).contains("qualification") | label(x).contains("preferred") | label(x).contains("minimum"))
    return jobs.withColumns({
        "_title": T.evidence_text(F.col("title")), "_description": T.evidence_text(F.col("description")), "_normal": T.evidence_text(F.col("normalized_text")),
        "_asked": T.evidence_text(F.array_join(F.transform(asks, lambda x: F.coalesce(x["text"], F.lit(""))), " ")),
        "_all": T.evidence_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("normalized_text", F.lit("")),
                                            F.array_join(F.transform("fragments", lambda x: F.coalesce(x["text"], F.lit(""))), " "))),
    })


def evidence_score(jobs: DataFrame) -> DataFrame:
    """jobs with score and reasons, by where the terms of a skill stand.

    Columns: terms (array), title, description, normalized_text (strings), fragments (array of label and text), or those of ``evidence_texts`` in
    their place; verified (boolean), verified_reason (string), created (boolean).
    """
    terms = F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), T.normalize_name), lambda t: t != "")
    rows = (jobs if "_all" in jobs.columns else evidence_texts(jobs)).withColumn("_terms", F.array_distinct(terms))
    holds = lambda c: F.exists("_terms", lambda t: F.col(c).contains(t))
    times = F.aggregate(F.transform("_terms", lambda t: T.occurrences(F.col("_all"), t)), F.lit(0).cast("long"), lambda a, b: a + b)
    reason = F.substring(T.collapse(F.coalesce("verified_reason", F.lit(""))), 1, 160)
    parts = [
        (holds("_title"), F.lit(30), F.lit("title match")), (holds("_asked"), F.lit(25), F.lit("requirements match")), (holds("_description"), F.lit(20), F.lit("description match")),
        (holds("_normal"), F.lit(15), F.lit("normalized text match")),
        (F.col("verified"), F.lit(20), F.when(reason != "", F.concat(F.lit("verification support: "), reason)).otherwise("verification support")),
        (F.col("created"), F.lit(5), F.lit("auto-created SkillSet")), (~F.col("created"), F.lit(10), F.lit("canonical SkillSet match")),
        (F.col("_times") > 1, F.least(F.lit(10), (F.col("_times") - 1) * 2), F.lit("repeated evidence")),
    ]
    scored = rows.withColumn("_times", times)
    score = F.lit(0)
    for holds_, points, _ in parts:
        score = score + F.when(holds_, points).otherwise(0)
    reasons = F.filter(F.array(*[F.when(h, why) for h, _, why in parts]), lambda x: x.isNotNull())
    return scored.withColumns({"score": F.least(score, F.lit(100)).cast("int"), "reasons": reasons}).drop("_terms", "_title", "_description", "_normal", "_asked", "_all", "_times")


def score_links(rows: DataFrame, skills: DataFrame, keywords: DataFrame) -> DataFrame:
    """rows (job_post_id, skill_set_id, name and the texts of ``evidence_score``) with score, reasons and ``rank`` within the job.

    The terms of a row are its mapped name and its skill's name, keywords in use and aliases, each normalised name once. Skills of a job rank by score,
    then by their skill's name, case ignored, then by id; a row whose skill isn't there goes by its mapped name.
    """
    words = keywords.groupBy(F.col("skill_set_id").alias("id")).agg(F.sort_array(F.collect_list("raw_text")).alias("_words"))
    none = F.array().cast("array<string>")
    known = skills.select("id", F.col("name").alias("_skill_name"), "aliases").join(words, "id", "left")
    known = known.select(F.col("id").alias("skill_set_id"), "_skill_name", F.concat(F.array("_skill_name"), F.coalesce("_words", none), F.coalesce("aliases", none)).alias("_names"))
    named = rows.join(known, "skill_set_id", "left").withColumn("terms", F.concat(F.array("name"), F.coalesce("_names", none)))
    scored = evidence_score(named).withColumn("name", F.coalesce("_skill_name", "name"))
    rank = F.row_number().over(Window.partitionBy("job_post_id").orderBy(F.desc("score"), F.lower("name"), "skill_set_id"))
    return scored.withColumn("rank", rank.cast("long")).drop("_skill_name", "_names", "terms")


def embedding_text(skills: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, text): name, description, aliases and keywords of each skill, joined by ". "; blank parts are left out."""
    words = keywords.groupBy(F.col("skill_set_id").alias("id")).agg(F.sort_array(F.collect_list("raw_text")).alias("words"))
    parts = F.concat(F.array("name", "description"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("words", F.array().cast("array<string>")))
    return skills.join(words, "id", "left").select("id", F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), ". ").alias("text"))
