"""Corpora of dated sessions as histories, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that count as a token in estimates.
CHARS_PER_TOKEN = 4.84


def session_time(label: Column) -> Column:
    """The time of a label such as ``2023/05/20 (Sat) 02:21``."""
    return F.to_timestamp(F.regexp_replace(label, r" \(\w+\)", ""), "yyyy/MM/dd HH:mm")


def messages(corpora: DataFrame) -> DataFrame:
    """Messages of corpora (question_id, haystack_dates, haystack_sessions: array of arrays of (role, content)).

    Sessions come in the order of their dates (of equal dates as they stood), empty
    ones not at all.  Each is marked with its date: in front of a user's first
    message, else in a message of its own before it.  Ids count from 1 in eight
    hexadecimal digits; times go on by a second for each message.
    """
    pairs = F.arrays_zip(F.col("haystack_dates").alias("label"), F.col("haystack_sessions").alias("turns"))
    sessions = corpora.select("question_id", F.posexplode(pairs).alias("at", "s")).select(
        "question_id", "at", F.col("s.label").alias("label"), F.col("s.turns").alias("turns"), session_time(F.col("s.label")).alias("time")
    )
    mark = F.concat(F.lit("[Session Date: "), F.col("label"), F.lit("]"))
    first, rest = F.element_at("turns", 1), F.slice("turns", 2, 1 << 30)
    one = lambda role, content: F.array(F.struct(role.alias("role"), content.alias("content")))
    marked = F.when(first["role"] == "user", F.concat(one(first["role"], F.concat(mark, F.lit("\n"), first["content"])), rest)).otherwise(
        F.concat(one(F.lit("user"), mark), F.col("turns"))
    )
    turns = sessions.where(F.size("turns") > 0).select("question_id", "time", "at", F.posexplode(marked).alias("turn", "m"))
    # A question's history is the unit of everything that follows, so a window of it is no larger than what a branch needs.
    order = Window.partitionBy("question_id").orderBy("time", "at", "turn")
    numbered = turns.withColumn("n", F.row_number().over(order))
    return numbered.select(
        "question_id",
        F.format_string("%08x", F.col("n").cast("long")).alias("id"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("text"),
        (F.unix_timestamp("time") * 1000 + (F.col("n") - 1) * 1000).cast("long").alias("timestamp"),
        F.col("n").cast("long").alias("pos"),
    )


def estimated_tokens(found: DataFrame, by: str = "question_id", order: str = "pos", text: str = "text") -> DataFrame:
    """Messages with the tokens, by characters, of all of the branch up to and with them."""
    running = F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("tokens", F.floor(running / CHARS_PER_TOKEN).cast("long"))


def context_tokens(found: DataFrame, by: str = "branch_id", text: str = "text") -> DataFrame:
    """A rough number of tokens by branch: a token for each four characters of a message, rounded up."""
    return found.groupBy(by).agg(F.sum(F.ceil(F.length(text) / 4)).cast("long").alias("tokens"))


def invalid_cuts(cuts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Branches (branch_id) whose cuts (branch_id, n, cut) aren't strictly increasing, or outside 1 to their messages (branch_id, size)."""
    before = F.coalesce(F.lag("cut").over(Window.partitionBy("branch_id").orderBy("n")), F.lit(0))
    checked = cuts.withColumn("before", before).join(sizes, "branch_id", "left")
    return checked.where("cut IS NULL OR cut <= before OR cut > coalesce(size, 0)").select("branch_id").distinct()


def identities(found: DataFrame) -> DataFrame:
    """Messages with a hash of role and content, by which the same turn is known in several histories."""
    return found.withColumn("key", F.sha2(F.to_json(F.array("role", "text")), 256))
