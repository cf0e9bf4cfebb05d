"""Chat formatting by quotation linking (operator 7); DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from demandlens.llm.util import doc_columns, in_order, stored

_QUOTED = r"^(?:[ \t]*>)+[ \t]?"


def normal(text: Column) -> Column:
    """A passage without differences of case and white space."""
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def own_text(text: Column) -> Column:
    """A message without its quoted lines."""
    return F.when(text.contains(">"), F.rtrim(F.regexp_replace(text, r"(?m)^[ \t]*>[^\n]*(?:\n|\z)", ""))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """(mid, first, level, unit): quoted passages of messages (mid, text), of one row for each mid.

    A passage is a run of lines of one level, the number of > before them; ``first`` is its first line. Units are
    the normalised whole passage and, if it has several lines, each line that isn't blank.
    """
    line = F.posexplode(F.split("text", "\n")).alias("at", "line")
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("mid", "text").dropDuplicates(["mid"])
    lines = quoting.select("mid", line)
    lines = lines.withColumn("level", F.length(F.regexp_replace(F.regexp_extract("line", _QUOTED, 0), r"[ \t]", "")))
    in_message = Window.partitionBy("mid").orderBy("at")
    change = F.when(F.col("level") == F.lag("level").over(in_message), 0).otherwise(1)
    runs = lines.withColumn("change", change).withColumn("run", F.sum("change").over(in_message)).where("level > 0")
    runs = runs.withColumn("line", F.regexp_replace("line", _QUOTED, ""))
    whole = runs.groupBy("mid", "run", "level").agg(F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    units = F.array_union(F.array(normal(joined)), F.transform("x", lambda r: normal(r["line"])))
    return whole.select("mid", "first", "level", F.explode(units).alias("unit")).where("unit <> ''")


def replies(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and roots of messages (mid, conv_id, turn, text, own), both with one row for each mid at most.

    Links (mid, p, n_linked, levels): the original that a message answers. A quoted unit means the first earlier
    message of the same conversation whose own text, as a whole or in one line, has the same hash; else the first such
    message of all, by conversation and turn, if it lies before. Of a message's originals the one quoted at the
    lowest level wins, then the one with most units, then the latest. Originals come before replies, so there is no
    cycle. Hashes are looked up in one row for each hash, so a phrase that many messages share joins one row.
    Roots (mid, root): the message at the end of the links.
    """
    spark = messages.sparkSession
    quoted = stored(passages(messages.select("mid", "text")).withColumn("h", F.xxhash64("unit")).groupBy("mid", "level", "h").agg(F.count("*").alias("n")), "quoted")
    place = messages.select("mid", "conv_id", "turn").distinct()
    none = spark.createDataFrame([], "mid long, p long, n_linked long, levels int"), spark.createDataFrame([], "mid long, root long")
    if not quoted.limit(1).count():
        return none
    units = F.array_union(F.array(normal(F.col("own"))), F.transform(F.split("own", "\n"), normal))
    filed = messages.where("own IS NOT NULL").select("mid", "conv_id", "turn", F.explode(units).alias("unit")).where("unit <> ''").withColumn("h", F.xxhash64("unit"))
    filed = filed.join(quoted.select("h").distinct(), "h", "left_semi")
    at = F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("mid").alias("p"))
    local = stored(filed.groupBy("h", "conv_id").agg(F.min(at).alias("near")), "originals")
    anywhere = local.groupBy("h").agg(F.min("near").alias("far"))
    asked = quoted.join(place, "mid").withColumn("me", F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("mid").alias("p")))
    met = asked.alias("a").join(anywhere.alias("f"), "h").join(local.alias("l"), F.expr("a.h = l.h AND a.conv_id <=> l.conv_id"), "left")
    earlier = lambda x: F.col(x) < F.col("a.me")
    same = F.when(earlier("l.near") & ~F.col("l.near.t").eqNullSafe(F.col("a.turn")), F.col("l.near"))
    other = F.when(earlier("f.far") & ~F.col("f.far.c").eqNullSafe(F.col("a.conv_id")), F.col("f.far"))
    found = met.select("a.mid", "a.level", "a.n", F.coalesce(same, other).alias("o")).where("o IS NOT NULL")
    counted = found.groupBy("mid", "o").agg(F.min("level").alias("level"), F.sum("n").alias("n"))
    best = counted.groupBy("mid").agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "o")).alias("x"), F.sum("n").alias("n_linked"), F.max("level").alias("levels"))
    links = stored(best.select("mid", F.col("x.o.p").alias("p"), "n_linked", "levels"), "replies")
    roots = links.select("mid", F.col("p").alias("root"))
    while True:  # every round doubles the links that a step follows
        step = roots.selectExpr("mid AS root", "root AS further")
        after = roots.join(step, "root", "left").select("mid", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = stored(after, "roots")
        roots = after.select("mid", "root")
        if not after.where("moved").limit(1).count():
            return links, roots


def threads(conversations: DataFrame) -> DataFrame:
    """(conversation, position, conv_id, turn, role, text, reply_conv, reply_turn, n_quotes, n_linked, levels) for every row.

    ``text`` is the message without quotes. A message goes to the conversation of its root, and stands there after it,
    before the root's next turn; messages without a linked quote keep their turns. Positions count from 0 in each
    conversation. They come from one range sort over all rows, so a conversation of any size is split.

    Null conv_ids are one conversation, null turns come first, ties are ordered by role and text; rows that repeat
    are all kept, and only the first of them is quoted. Null texts stay null. Other columns are not read.
    """
    rows = doc_columns(conversations, "conv_id", "turn", "role", "text")
    rows = rows.withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text", F.col("conv_id").isNull(), F.col("turn").isNull())).withColumn("own", own_text(F.col("text")))
    links, roots = replies(rows)
    place = rows.select(F.col("mid").alias("root"), F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn")).distinct()
    n_quotes = F.when(F.col("text").contains(">"), F.regexp_count("text", F.lit(r"(?m)^[ \t]*>"))).otherwise(0)
    moved = roots.join(place, "root").join(links, "mid", "full").join(place.selectExpr("root AS p", "root_conv AS reply_conv", "root_turn AS reply_turn"), "p", "left")
    all_ = rows.withColumn("n_quotes", n_quotes.cast("long")).join(moved, "mid", "left")
    linked = F.col("root").isNotNull()
    all_ = all_.select(
        F.when(linked, F.col("root_conv")).otherwise(F.col("conv_id")).alias("conversation"),
        F.when(linked, F.col("root_turn")).otherwise(F.col("turn")).alias("anchor"),
        "conv_id", "turn", "role", F.col("own").alias("text"), "reply_conv", "reply_turn", "n_quotes",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("levels", F.lit(0)).alias("levels"), linked.alias("reply"), F.lit(1).alias("one"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conversation", "anchor", "reply", "conv_id", "turn", "role", "text")]
    placed = in_order(all_, order, "one", "threads")
    first = placed.groupBy("conversation").agg(F.min("start").alias("first"))
    out = placed.alias("r").join(first.alias("f"), F.expr("r.conversation <=> f.conversation"))
    return out.select(
        "r.conversation", (F.col("start") - F.col("first")).cast("long").alias("position"), "conv_id", "turn", "role", "text",
        "reply_conv", "reply_turn", "n_quotes", F.col("n_linked").cast("long").alias("n_linked"), F.col("levels").cast("long").alias("levels"),
    )


def formatted(threaded: DataFrame) -> DataFrame:
    """Each message as a marked-up turn, ready to be joined in order of position."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    return threaded.withColumn("formatted", F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n")))


def op7_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(threads(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
