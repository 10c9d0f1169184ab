"""The effective history of branches: edits applied, cut at the latest compaction.

Entries are rows of :data:`ENTRY`, ordered in each branch by ``pos``.  Other types
of entries than ``message``, ``context_edit`` and ``compaction`` are ignored.  All
operators work on many branches at once; what they shuffle by is the branch with
an entry's id, and edits and boundaries are aggregated before they join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.canonical import canonical_udf

BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "text", "name", "arguments")])
#: An entry: content is an array of blocks (a string becomes one text block; ``content_is_string`` tells), arguments are JSON text.
ENTRY = T.StructType(
    [
        T.StructField("branch_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("ts", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.ArrayType(BLOCK)),
        T.StructField("target_id", T.StringType()),
        T.StructField("replacement", T.ArrayType(BLOCK)),
        T.StructField("omit", T.BooleanType()),
        T.StructField("first_kept_id", T.StringType()),
    ]
)
#: Roles whose content an edit may replace, and roles that searches see.
EDITABLE = ("user", "assistant", "toolResult")
SEARCHABLE = ("user", "assistant")


def message_text(role: Column, content: Column) -> Column:
    """Text blocks joined by line ends; an assistant's tool calls by name and arguments.  Other blocks say nothing."""
    quoted = lambda b: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(b["name"], F.lit("(unnamed)")), r'(["\\])', r"\\$1"), F.lit('"'))
    call = lambda b: F.concat(F.lit("Tool call "), quoted(b), F.lit("\nArguments "), F.coalesce(b["arguments"], F.lit("null")))
    said = F.transform(
        content,
        lambda b: F.when((b["type"] == "text") & b["text"].isNotNull(), b["text"]).when((role == "assistant") & (b["type"] == "toolCall"), call(b)),
    )
    return F.coalesce(F.array_join(F.array_compact(said), "\n"), F.lit(""))


def searchable_text(role: Column, content: Column) -> Column:
    """The text of a user's or an assistant's message; null, which isn't empty, for others."""
    return F.when(role.isin(*SEARCHABLE), message_text(role, content))


def with_canonical_arguments(entries: DataFrame) -> DataFrame:
    """Entries whose tool arguments are canonical JSON: compact, with sorted keys.

    Only entries with a tool call go through Python.
    """
    has_call = F.exists(F.coalesce("content", F.array()), lambda b: b["type"] == "toolCall")
    calls = entries.where(has_call).withColumn("_at", F.monotonically_increasing_id())
    blocks = calls.select("branch_id", "pos", F.posexplode("content").alias("_n", "_b"))
    read = blocks.withColumn("_args", F.when(F.col("_b.type") == "toolCall", canonical_udf(F.col("_b.arguments"))))
    block = F.struct("_n", F.when(F.col("_b").isNotNull(), F.struct("_b.type", "_b.text", "_b.name", F.coalesce("_args", "_b.arguments").alias("arguments"))).alias("b"))
    again = read.groupBy("branch_id", "pos").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("_content"))
    changed = calls.drop("_at").join(again, ["branch_id", "pos"]).withColumn("content", F.col("_content").cast(ENTRY["content"].dataType)).drop("_content")
    return entries.where(~has_call).unionByName(changed.select(*entries.columns))


def boundaries(entries: DataFrame) -> DataFrame:
    """Branches that were compacted, with ``end``: where the kept tail of the latest compaction begins.

    That is the first entry with the kept id, whatever became of it, or else the
    compaction itself.
    """
    latest = (
        entries.where("type = 'compaction'")
        .groupBy("branch_id")
        .agg(F.max(F.struct("pos", "first_kept_id")).alias("c"))
        .select("branch_id", F.col("c.pos").alias("own"), F.col("c.first_kept_id").alias("id"))
    )
    kept = entries.select("branch_id", "id", "pos").join(latest.select("branch_id", "id"), ["branch_id", "id"]).groupBy("branch_id").agg(F.min("pos").alias("kept"))
    return latest.join(kept, "branch_id", "left").select("branch_id", F.coalesce("kept", "own").alias("end"))


def edited(entries: DataFrame) -> DataFrame:
    """Message entries with the last edit of each applied, wherever in the branch the edit stands; omitted ones are gone."""
    edits = (
        entries.where("type = 'context_edit'")
        .groupBy("branch_id", F.col("target_id").alias("id"))
        .agg(F.max(F.struct("pos", F.coalesce("omit", F.lit(False)).alias("omit"), "replacement")).alias("e"))
    )
    messages = entries.where("type = 'message'").join(edits, ["branch_id", "id"], "left").where("e IS NULL OR NOT e.omit")
    replaced = F.col("e").isNotNull() & F.col("role").isin(*EDITABLE)
    return messages.withColumn("content", F.when(replaced, F.col("e.replacement")).otherwise(F.col("content"))).select(*entries.columns)


def compacted(entries: DataFrame) -> DataFrame:
    """What was moved out of the live context: edited messages before the boundary.  Branches without compaction have none.

    ``readable`` is the text for reading, ``searchable`` (null for other roles) that
    for searches, and ``recency`` counts the rows that are left from 0.
    """
    before = edited(entries).join(boundaries(entries), "branch_id").where("pos < end").drop("end")
    return projected(before)


def projected(messages: DataFrame) -> DataFrame:
    """Messages with their texts.  Their order within the branch is ``pos``."""
    return messages.withColumns({"readable": message_text(F.col("role"), F.col("content")), "searchable": searchable_text(F.col("role"), F.col("content"))})


def documents(messages: DataFrame) -> DataFrame:
    """Rows for the index, from messages with a searchable text."""
    return messages.where("searchable IS NOT NULL").select("branch_id", "pos", "id", "role", "ts", F.col("searchable").alias("text"))


def recent_user_texts(messages: DataFrame, most: int = 2) -> DataFrame:
    """Of each branch the last user message's ``text`` and, nearest first, up to ``most`` earlier ones."""
    said = messages.where("role = 'user'").select("branch_id", F.struct("pos", F.coalesce("searchable", F.lit("")).alias("t")).alias("u"))
    # The few latest are kept as the rows of a branch come in: an array of n + 1 at most for each partial aggregate would
    # need a custom aggregate, so the window's built-in group limit does it.
    from pyspark.sql import Window

    ranked = said.withColumn("r", F.row_number().over(Window.partitionBy("branch_id").orderBy(F.col("u.pos").desc()))).where(F.col("r") <= most + 1)
    listed = ranked.groupBy("branch_id").agg(F.transform(F.sort_array(F.collect_list("u"), False), lambda u: u["t"]).alias("l"))
    return listed.select("branch_id", F.element_at("l", 1).alias("text"), F.slice("l", 2, most).alias("recent"))


def conversation_entries(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Entries of a table of conversations: a branch for each, ids ``conversation:turn``, no compaction."""
    return conversations.select(
        F.col(id_col).cast("string").alias("branch_id"),
        F.col(turn_col).cast("long").alias("pos"),
        F.lit("message").alias("type"),
        F.concat_ws(":", F.col(id_col).cast("string"), F.col(turn_col).cast("string")).alias("id"),
        F.lit(None).cast("string").alias("ts"),
        "role",
        F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"))).alias("content"),
        F.lit(None).cast("string").alias("target_id"),
        F.lit(None).cast(ENTRY["replacement"].dataType).alias("replacement"),
        F.lit(None).cast("boolean").alias("omit"),
        F.lit(None).cast("string").alias("first_kept_id"),
    )
