"""Session logs as tables of entries.

A log is a file with a JSON object on each line.  Lines differ by type and content
is text or an array of blocks, so a line is read as a variant and taken apart by
paths; nothing is inferred from the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.canonical import canonical_json
from strandline.operators.branch import ENTRY

def _string(value: str, path: str) -> str:
    """SQL: the string at a path of a variant; null for what is no string."""
    at = f"try_variant_get({value}, '{path}', 'variant')"
    return f"IF(schema_of_variant({at}) = 'STRING', try_variant_get({value}, '{path}', 'string'), NULL)"


def _blocks(path: str) -> str:
    """SQL: content at a path of the variant ``v`` as an array of blocks; text is one block, what isn't an object is left out."""
    at = f"try_variant_get(v, '{path}', 'variant')"
    one = f"array(named_struct('type', 'text', 'text', {_string('v', path)}, 'name', CAST(NULL AS STRING), 'arguments', CAST(NULL AS STRING)))"
    fields = ", ".join(f"'{n}', {_string('b', f'$.{n}')}" for n in ("type", "text", "name"))
    block = f"named_struct({fields}, 'arguments', to_json(try_variant_get(b, '$.arguments', 'variant')))"
    many = f"transform(filter(try_variant_get(v, '{path}', 'array<variant>'), b -> schema_of_variant(b) LIKE 'OBJECT%'), b -> {block})"
    return f"CASE WHEN schema_of_variant({at}) = 'STRING' THEN {one} WHEN schema_of_variant({at}) LIKE 'ARRAY%' THEN {many} END"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the logs under ``path``: a branch for each file, in the order of its lines.

    A log is read in as many parts as its size makes.  Lines are numbered in their
    part, and what the parts before it hold is added; blank lines count as lines.
    Tool arguments are compact JSON; see
    :func:`strandline.operators.branch.with_canonical_arguments` for the canonical form.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("branch_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("line"))
    parts = lines.groupBy("branch_id", "block").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("branch_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = lines.join(ahead, ["branch_id", "block"]).select("branch_id", (F.col("ahead") + F.col("m") - F.col("first")).alias("pos"), "line")
    return parse(numbered.where(F.trim("line") != ""))


def parse(lines: DataFrame) -> DataFrame:
    """Entries of rows (branch_id, pos, line).  A line that isn't JSON is an entry without a type."""
    read_lines = lines.selectExpr("branch_id", "cast(pos AS long) AS pos", "try_parse_json(line) AS v")
    gone = "schema_of_variant(try_variant_get(v, '$.replacement', 'variant')) LIKE 'OBJECT%'"
    return read_lines.selectExpr(
        "branch_id",
        "pos",
        f"{_string('v', '$.type')} AS type",
        f"{_string('v', '$.id')} AS id",
        f"{_string('v', '$.timestamp')} AS ts",
        f"{_string('v', '$.message.role')} AS role",
        f"{_blocks('$.message.content')} AS content",
        f"{_string('v', '$.targetId')} AS target_id",
        f"{_blocks('$.replacement.content')} AS replacement",
        f"IF({_string('v', '$.type')} = 'context_edit', NOT coalesce({gone}, false), NULL) AS omit",
        f"{_string('v', '$.firstKeptEntryId')} AS first_kept_id",
    )


def entries(spark: SparkSession, branches: dict[str, Iterable[dict]]) -> DataFrame:
    """Entries of logs in memory, for tests and small histories: branch ids with parsed lines."""
    rows = []
    for branch, some in branches.items():
        for pos, e in enumerate(some):
            message, replacement = e.get("message") or {}, e.get("replacement")
            rows.append(
                (branch, pos, e.get("type"), e.get("id"), e.get("timestamp"), message.get("role"), _plain(message.get("content")),
                 e.get("targetId"), _plain((replacement or {}).get("content")), replacement is None if e.get("type") == "context_edit" else None,
                 e.get("firstKeptEntryId"))
            )
    return spark.createDataFrame(rows, ENTRY)


def _plain(content: object) -> list | None:
    """Blocks of content; their tool arguments are canonical JSON already."""
    if isinstance(content, str):
        return [("text", content, None, None)]
    if not isinstance(content, list):
        return None
    out = []
    for b in content:
        if isinstance(b, dict):
            text = b.get("text") if isinstance(b.get("text"), str) else None
            name = b.get("name") if isinstance(b.get("name"), str) else None
            out.append((b.get("type"), text, name, canonical_json(b.get("arguments")) if b.get("type") == "toolCall" else None))
    return out


def write(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to what is there."""
    df.write.mode("append").json(path)


def lines_of(rows: Iterable[dict]) -> str:
    """Entries as the text of a log."""
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
