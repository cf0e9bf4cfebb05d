"""Imports of skill taxonomies as merges, their checks, and category suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.functions import text as T
from demandlens.operators.fuzzy import containing
from demandlens.session import cut_lineage


def skill_import(skills: DataFrame, rows: DataFrame) -> DataFrame:
    """The next state of skills (id, name, esco_uri, description) with the action on each: insert, update or keep.

    rows (ord, concept_uri, preferred_label, concept_type, description): groups and rows without a label are left out. A row
    means the skill of its uri, else that of its normalised name; of rows that mean the same one, the last that says something wins
    field by field. A blank description or uri changes nothing. New skills have no id.
    """
    used = rows.where(~F.coalesce(F.lower("concept_type").contains("group"), F.lit(False))).withColumn("label", T.truncated(F.col("preferred_label"))).where("label <> ''")
    used = used.withColumns({"normalized": T.normalize_name(F.col("label")), "uri": F.nullif(F.trim("concept_uri"), F.lit("")), "about": F.nullif(F.trim("description"), F.lit(""))})
    have = skills.select(F.col("id").alias("have"), T.normalize_name(F.col("name")).alias("have_name"), F.col("esco_uri").alias("have_uri"))
    by_uri = used.join(have.select(F.col("have").alias("u_id"), "have_uri"), F.col("uri") == F.col("have_uri"), "left")
    both = by_uri.join(have.groupBy("have_name").agg(F.min("have").alias("n_id")), F.col("normalized") == F.col("have_name"), "left").withColumn("id", F.coalesce("u_id", "n_id"))
    key = F.coalesce(F.concat(F.lit("#"), F.col("id").cast("string")), F.col("normalized"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    new = both.withColumn("key", key).groupBy("key").agg(F.max("id").alias("new_id"), F.min_by("label", "ord").alias("label"), latest("uri").alias("new_uri"), latest("about").alias("new_about"))
    out = skills.join(new, skills["id"] == new["new_id"], "full")
    uri, about = F.coalesce("new_uri", "esco_uri"), F.coalesce("new_about", "description")
    same = uri.eqNullSafe(F.col("esco_uri")) & about.eqNullSafe(F.col("description"))
    action = F.when(F.col("id").isNull(), "insert").when(F.col("key").isNull() | same, "keep").otherwise("update")
    return out.select("id", F.coalesce("name", "label").alias("name"), uri.alias("esco_uri"), F.coalesce(about, F.lit("")).alias("description"), action.alias("action"))


def alias_import(skills: DataFrame, existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The next state of aliases (alias, skill_id) with the action: insert, update or keep.

    rows (ord, concept_uri, preferred_label, alt_labels): each label of a row's skill but its own name becomes an alias; the last row
    that names a text, case ignored, has it.
    """
    have = skills.select(F.col("id").alias("skill"), T.normalize_name(F.col("name")).alias("own"), "esco_uri")
    named = rows.where(T.collapse(F.col("preferred_label")) != "")
    by_uri = named.join(have.select(F.col("skill").alias("u_id"), F.col("own").alias("u_own"), "esco_uri"), F.col("concept_uri") == F.col("esco_uri"), "left").drop("esco_uri")
    names = have.groupBy("own").agg(F.min("skill").alias("n_id"))
    both = by_uri.join(names, T.normalize_name(F.col("preferred_label")) == F.col("own"), "left")
    both = both.select("ord", F.coalesce("u_id", "n_id").alias("new_skill"), F.coalesce("u_own", "own").alias("skill_name"), F.posexplode(T.split_labels(F.col("alt_labels"))).alias("at", "label")).where("new_skill IS NOT NULL")
    texts = both.withColumn("label", T.truncated(F.col("label"))).where((F.col("label") != "") & (T.normalize_name(F.col("label")) != F.col("skill_name")))
    place = F.struct("ord", "at")
    last = texts.groupBy(F.lower("label").alias("key")).agg(F.max_by("new_skill", place).alias("new_skill"), F.min_by("label", place).alias("label"))
    out = existing.withColumn("e_key", F.lower("alias")).join(last, F.col("e_key") == F.col("key"), "full")
    action = F.when(F.col("alias").isNull(), "insert").when(F.col("new_skill").isNull() | (F.col("new_skill") == F.col("skill_id")), "keep").otherwise("update")
    return out.select(F.coalesce("alias", "label").alias("alias"), F.coalesce("new_skill", "skill_id").alias("skill_id"), action.alias("action"))


def taxonomy_links(broader: DataFrame, skills: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows (ord, concept_uri, broader_uri): links (skill_id, category_id) and parents (category_id, parent_id).

    The narrower concept is a skill before it is a category; a category's last parent wins.
    """
    s = skills.where("esco_uri IS NOT NULL").select(F.col("id").alias("skill_id"), F.col("esco_uri").alias("s_uri"))
    c = categories.where("esco_uri IS NOT NULL")
    narrow, wide = c.select(F.col("id").alias("category_id"), F.col("esco_uri").alias("n_uri")), c.select(F.col("id").alias("parent_id"), F.col("esco_uri").alias("b_uri"))
    rows = broader.join(wide, F.col("broader_uri") == F.col("b_uri")).join(s, F.col("concept_uri") == F.col("s_uri"), "left").join(narrow, F.col("concept_uri") == F.col("n_uri"), "left")
    links = rows.where("skill_id IS NOT NULL").select("skill_id", F.col("parent_id").alias("category_id")).distinct()
    parents = rows.where("skill_id IS NULL AND category_id IS NOT NULL").groupBy("category_id").agg(F.max_by("parent_id", "ord").alias("parent_id"))
    return links, parents


def relationship_import(related: DataFrame, broader: DataFrame, skills: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows (source_id, target_id, kind): related pairs as typed, broader pairs both ways, without self and existing ones."""
    ids = skills.where("esco_uri IS NOT NULL").select("id", "esco_uri")
    ends = lambda rows, a, b: rows.join(ids.select(F.col("id").alias("source_id"), F.col("esco_uri").alias(f"{a}_")), F.col(a) == F.col(f"{a}_")).join(
        ids.select(F.col("id").alias("target_id"), F.col("esco_uri").alias(f"{b}_")), F.col(b) == F.col(f"{b}_"))
    typed = ends(related, "source_uri", "target_uri").select("source_id", "target_id", T.relation_type(F.coalesce("relation_type", F.lit("related"))).alias("kind"))
    pairs = ends(broader, "concept_uri", "broader_uri")
    up = pairs.select("source_id", "target_id", F.lit("narrower").alias("kind"))
    down = pairs.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.lit("broader").alias("kind"))
    return typed.unionByName(up).unionByName(down).where("source_id <> target_id").distinct().join(existing, ["source_id", "target_id", "kind"], "left_anti")


def duplicate_aliases(alias_rows: DataFrame) -> DataFrame:
    """(normalized, texts): alias texts that differ but mean the same name."""
    per = alias_rows.groupBy(T.normalize_name(F.col("alias")).alias("normalized")).agg(F.sort_array(F.collect_set("alias")).alias("texts"))
    return per.where(F.size("texts") > 1).select("normalized", F.array_join("texts", ", ").alias("texts"))


def duplicate_canonical(skills: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """(normalized, names): names, aliases or alias rows that several skills claim."""
    own = skills.select(T.normalize_name(F.col("name")).alias("normalized"), "name")
    listed = skills.select("name", F.explode("aliases").alias("a")).select(T.normalize_name(F.col("a")).alias("normalized"), "name")
    rows = alias_rows.join(skills.selectExpr("id AS skill_id", "name"), "skill_id").select(T.normalize_name(F.col("alias")).alias("normalized"), "name")
    per = own.unionByName(listed).unionByName(rows).where("normalized <> ''").groupBy("normalized").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return per.where(F.size("names") > 1).select("normalized", F.array_join("names", ", ").alias("names"))


def unresolved_aliases(skills: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """(alias, skill_id, canonical): aliases that are another skill's name; ``canonical`` is null for an alias without text."""
    names = skills.select(F.col("id").alias("skill_id"), T.normalize_name(F.col("name")).alias("own"))
    canonical = skills.groupBy(T.normalize_name(F.col("name")).alias("normalized")).agg(F.min("name").alias("canonical"))
    rows = alias_rows.withColumn("normalized", T.normalize_name(F.col("alias"))).join(names, "skill_id").join(canonical, "normalized", "left")
    return rows.where("normalized = '' OR (canonical IS NOT NULL AND normalized <> own)").select("alias", "skill_id", F.when(F.col("normalized") != "", F.col("canonical")).alias("canonical"))


def orphan_relationships(edges: DataFrame, skills: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, kind) of which an end is no active skill: the two roles are joined apart."""
    on = skills.select("id", "is_active")
    source = on.select(F.col("id").alias("source_id"), F.col("is_active").alias("source_active"))
    target = on.select(F.col("id").alias("target_id"), F.col("is_active").alias("target_active"))
    both = edges.join(source, "source_id", "left").join(target, "target_id", "left")
    return both.where("NOT coalesce(source_active, false) OR NOT coalesce(target_active, false)").select("source_id", "target_id", "kind")


def pattern_matches(skills: DataFrame, patterns: DataFrame) -> DataFrame:
    """(category, skill_id, pattern, confidence): skills whose names or aliases hold a pattern (category, ord, pattern) of a seed table."""
    searchable = F.lower(F.concat_ws(" ", "name", T.normalize_name(F.col("name")), F.array_join("aliases", " ")))
    cleaned = patterns.select("category", "ord", F.lower(F.trim("pattern")).alias("pattern")).where("pattern <> ''")
    texts = skills.select(F.col("id").alias("skill_id"), searchable.alias("s"))
    pairs = containing(texts.select(F.col("s").alias("long")), cleaned.select(F.col("pattern").alias("short")))
    # sizes guessed from compressed files would send all names through the driver
    found = texts.join(pairs.hint("merge"), F.col("s") == F.col("long")).join(cleaned, F.col("short") == F.col("pattern"))
    return found.select("category", "skill_id", "ord", "pattern", F.when(F.length("pattern") >= 8, 0.85).otherwise(0.7).alias("confidence"))


def suggestions(skills: DataFrame, names: DataFrame, patterns: DataFrame, assigned: DataFrame) -> DataFrame:
    """(category, skill_id, confidence, reason): skills of a category's seed that it lacks; an exact name before patterns, those in order."""
    named = skills.select(F.col("id").alias("skill_id"), F.col("name").alias("skill_name"), T.normalize_name(F.col("name")).alias("n"))
    exact = names.withColumn("n", T.normalize_name(F.col("name"))).join(named.hint("merge"), "n").select(
        "category", "skill_id", F.struct(F.lit(-1).alias("ord"), F.lit(0.95).alias("confidence"), F.concat(F.lit("exact skill match: "), F.col("skill_name")).alias("reason")).alias("x"))
    held = pattern_matches(skills, patterns).select("category", "skill_id", F.struct("ord", "confidence", F.concat(F.lit("pattern match: "), F.col("pattern")).alias("reason")).alias("x"))
    first = exact.unionByName(held).groupBy("category", "skill_id").agg(F.min("x").alias("x")).join(assigned.hint("merge"), ["category", "skill_id"], "left_anti")
    return first.select("category", "skill_id", F.col("x.confidence").alias("confidence"), F.col("x.reason").alias("reason"))


def assign(skills: DataFrame, names: DataFrame, patterns: DataFrame, existing: DataFrame) -> DataFrame:
    """The next state of links (category, skill_id, confidence, source, is_approved): matched ones have 0.9, SEED and approval; others stay."""
    matched = suggestions(skills, names, patterns, existing.limit(0).select("category", "skill_id")).select("category", "skill_id", F.lit(True).alias("seeded"))
    both = existing.join(matched, ["category", "skill_id"], "full")
    seeded = F.col("seeded").isNotNull()
    return both.select(
        "category", "skill_id", F.when(seeded, 0.9).otherwise(F.col("confidence")).alias("confidence"),
        F.when(seeded & (F.coalesce("source", F.lit("")) != "MANUAL"), "SEED").otherwise(F.col("source")).alias("source"), (seeded | F.coalesce("is_approved", F.lit(False))).alias("is_approved"),
    )


def hierarchy(items: DataFrame, known: DataFrame, most: int = 64) -> DataFrame:
    """(uri, parent, root, depth, outcome) of items (uri, broader) that may come before their parents; known: uri, parent, of those that are there.

    Parents are linked when all items are in: an item's new parent is the last broader term by text that exists and isn't the item itself, as the terms are
    taken in order, else what it was. Roots and depths come from pointers that double each round, so a chain of 5,000 takes 13 rounds; what never
    reaches a root lies on a cycle or behind one, and has neither. ``outcome``: linked (a new parent), kept, root, missing (its broader terms aren't
    there), cycle.
    """
    every = known.select("uri").unionByName(items.select("uri")).where("uri <> ''").distinct()
    asked = items.where("uri <> '' AND broader <> '' AND broader <> uri").select("uri", "broader").distinct()
    there = asked.join(every.select(F.col("uri").alias("broader"), F.lit(True).alias("there")), "broader", "left")
    chosen = there.groupBy("uri").agg(F.max(F.when(F.col("there"), F.col("broader"))).alias("new_parent"))
    old = known.groupBy("uri").agg(F.max("parent").alias("old_parent"))
    linked = every.join(chosen.withColumn("asked", F.lit(True)), "uri", "left").join(old, "uri", "left").withColumn("parent", F.coalesce("new_parent", "old_parent"))
    linked = cut_lineage(linked)
    state = linked.select("uri", F.coalesce("parent", "uri").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNull().alias("at_root"))
    # a pointer to a term that isn't there ends at itself
    here = every.select(F.col("uri").alias("to"), F.lit(True).alias("here"))
    state = cut_lineage(state.join(here, "to", "left").select("uri", F.when(F.col("here"), F.col("to")).otherwise(F.col("uri")).alias("to"), F.when(F.col("here"), F.col("depth")).otherwise(0).cast("long").alias("depth"), (F.col("at_root") | F.col("here").isNull()).alias("at_root")))
    left = state.count()
    for _ in range(most):
        onward = state.select(F.col("uri").alias("mid"), F.col("to").alias("to2"), F.col("depth").alias("more"), F.col("at_root").alias("root2"))
        moved = state.join(onward, F.col("to") == F.col("mid")).select("uri", F.col("to2").alias("to"), F.when(F.col("at_root"), F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth"), (F.col("at_root") | F.col("root2")).alias("at_root"))
        state = cut_lineage(moved)
        left = (left + 1) // 2
        if left <= 1 or state.where("NOT at_root").isEmpty():
            break
    out = linked.join(state.select("uri", "to", "depth", "at_root"), "uri")
    found = F.col("at_root")
    outcome = F.when(~found, "cycle").when(F.col("new_parent").isNotNull() & ~F.col("new_parent").eqNullSafe(F.col("old_parent")), "linked").when(F.col("asked") & F.col("new_parent").isNull(), "missing").when(F.col("parent").isNull(), "root").otherwise("kept")
    return out.select("uri", "parent", F.when(found, F.col("to")).alias("root"), F.when(found, F.col("depth")).alias("depth"), outcome.alias("outcome"))


def company_import(companies: DataFrame, incoming: DataFrame) -> DataFrame:
    """The next state of companies (id, name, website): matched by name without case and spare blanks; the last row of each name wins."""
    key = lambda c: F.lower(T.collapse(F.col(c)))
    new = incoming.withColumn("key", key("name")).where("key <> ''")
    site = F.max_by(F.trim("website"), F.when(F.trim("website") != "", F.col("ord")))
    new = new.groupBy("key").agg(F.max_by(T.collapse(F.col("name")), "ord").alias("new_name"), site.alias("new_site"))
    first = Window.partitionBy(key("name")).orderBy("id")
    old = companies.withColumn("o_key", F.when(F.row_number().over(first) == 1, key("name")))
    out = old.join(new, F.col("o_key") == F.col("key"), "full")
    name, website = F.coalesce("new_name", "name"), F.coalesce("new_site", "website", F.lit(""))
    action = F.when(F.col("id").isNull(), "insert").when((name == F.col("name")) & (website == F.coalesce("website", F.lit(""))), "keep").otherwise("update")
    return out.select("id", name.alias("name"), website.alias("website"), action.alias("action"))


def emerging_seed(skills: DataFrame, seed: DataFrame) -> DataFrame:
    """The next state of skills (id, name, aliases): seed rows (name, aliases) are added or their aliases joined, the first of each name."""
    new = seed.withColumn("key", T.normalize_name(F.col("name"))).select("key", F.col("name").alias("s_name"), F.col("aliases").alias("s_aliases"))
    both = skills.join(new, T.normalize_name(F.col("name")) == F.col("key"), "full")
    none = F.array().cast("array<string>")
    joined = T.clean_aliases(F.concat(F.coalesce("aliases", none), F.coalesce("s_aliases", none)))
    action = F.when(F.col("id").isNull(), "insert").when(F.col("key").isNull() | (joined == F.coalesce("aliases", none)), "keep").otherwise("update")
    return both.select("id", F.coalesce("name", "s_name").alias("name"), F.when(F.col("key").isNull(), F.col("aliases")).otherwise(joined).alias("aliases"), action.alias("action"))
