"""Reports of runs: what judges say, distributions, gauges."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.canonical import DuplicateKey, strict_json

UNRECORDED = "not recorded"


def judged(rows: DataFrame, by: Sequence[str] = (), at_least: int = 8) -> DataFrame:
    """Counts by status, accuracy and mean score of rows (status, correct, score).

    Only graded rows are scored: failed and pending ones are no zeros, and without
    any graded row accuracy and mean are null.
    """
    graded, pending = F.col("status") == "graded", F.col("status") == "pending"
    return rows.groupBy(*by).agg(
        F.count("*").alias("selected"),
        F.count_if(graded).alias("scored"),
        F.count_if(~graded & ~pending).alias("failed"),
        F.count_if(pending).alias("pending"),
        F.count_if(graded & F.col("correct")).alias("correct"),
        F.avg(F.when(graded, F.col("correct").cast("double"))).alias("accuracy"),
        F.avg(F.when(graded, F.col("score"))).alias("mean_score"),
        F.count_if(graded & (F.col("score") >= at_least)).alias("at_least"),
    )


def distribution(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, median and largest of a number by groups; what is absent isn't zero."""
    return rows.groupBy(*by).agg(F.count(value).alias("count"), F.median(value).alias("median"), F.max(value).alias("max"))


def nearest_rank(value: str, share: float) -> Column:
    """The percentile that is one of the values: that at place ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def upper_median(value: str) -> Column:
    """The median that is one of the values, of two the upper one: by nearest rank from above."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def cells(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Over repetitions the upper median, and the range."""
    return rows.groupBy(*by).agg(upper_median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def paired(base: DataFrame, variant: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A variant's cells beside the base's of the same key, and their quotient."""
    left = base.select(*key, F.col(value).alias("base"))
    right = variant.select(*key, F.col(value).alias("variant"))
    return left.join(right, list(key)).withColumn("ratio", F.col("variant") / F.col("base"))


def peak(intervals: DataFrame, begin: str = "begin", end: str = "end", by: Sequence[str] = (), slots: int = 1_024) -> DataFrame:
    """The most intervals open at one time; one that ends when another begins isn't open with it.

    Equal times are summed first.  A group's time is cut into ``slots`` parts, each a
    window of its own, so that a group with most of the rows isn't one task; the parts'
    sums, of which there are few, carry the count over.
    """
    steps = intervals.select(*by, F.col(begin).alias("at"), F.lit(1).alias("d")).union(intervals.select(*by, F.col(end).alias("at"), F.lit(-1).alias("d")))
    changes = steps.where("at IS NOT NULL").groupBy(*by, "at").agg(F.sum("d").alias("d"))
    range_of = changes.groupBy(*by).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    numbered = changes.join(range_of, list(by)) if by else changes.crossJoin(range_of)  # one row
    span = F.greatest((F.col("high") - F.col("low")).cast("double"), F.lit(1e-9))
    slot = F.least(F.floor((F.col("at") - F.col("low")).cast("double") / span * slots), F.lit(slots - 1)).cast("int")
    inside = Window.partitionBy(*by, "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = numbered.withColumn("slot", slot).withColumn("open", F.sum("d").over(inside))
    parts = running.groupBy(*by, "slot").agg(F.sum("d").alias("d"), F.max("open").alias("most"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum("d").over(before), F.lit(0))).groupBy(*by).agg(F.max(F.col("before") + F.col("most")).alias("peak"))


def attempts(rows: DataFrame, by: Sequence[str] = ("question_id",)) -> DataFrame:
    """Wall time and tokens of all attempts; tokens are null if any attempt has none."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        F.sum("wall_ms").alias("wall_ms"),
        F.when(F.count("tokens") == F.count("*"), F.sum("tokens")).alias("tokens"),
        F.count_if(F.coalesce("timeout", F.lit(False))).alias("timeouts"),
    )


def answer_tokens(messages: DataFrame) -> DataFrame:
    """Tokens by kind and model calls of each answer, over messages (question_id, role, usage struct)."""
    kinds = ("input", "output", "cache_read", "cache_write")
    said = messages.where("role = 'assistant'")
    return said.groupBy("question_id").agg(F.count("*").alias("model_calls"), *[F.sum(F.coalesce(F.col(f"usage.{k}"), F.when(F.col("usage").isNotNull(), 0))).alias(k) for k in kinds])


def observed(events: DataFrame) -> DataFrame:
    """By session the first time of each kind of output, and how many messages, turns, tool batches and calls there were."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at_ms")))
    return events.groupBy("session_id").agg(
        first("text").alias("first_text_ms"),
        first("thinking").alias("first_thinking_ms"),
        first("tool").alias("first_tool_ms"),
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in (("user", "user_messages"), ("turn", "turns"), ("batch", "tool_batches"), ("call", "tool_calls"))],
    )


#: What a provider says when it has no room.
CAPACITY = r"(?i)capacity|overloaded|rate.?limit|too many requests|\b429\b|\b529\b|quota"


def capacity_errors(rows: DataFrame, message: str = "error") -> DataFrame:
    """Rows that failed because the provider had no room."""
    return rows.where(F.col(message).rlike(CAPACITY))


def verdict(text: str, least: int = 1, most: int = 10) -> dict:
    """A judge's verdict: an object with either ``correct`` (true or false) or ``score`` (a whole number in a range), and a reason."""
    try:
        found = strict_json(text)
    except DuplicateKey as error:
        raise ValueError(f"a key stands twice: {error}") from error
    if not isinstance(found, dict) or not set(found) <= {"correct", "score", "reason"}:
        raise ValueError("expected an object with correct or score, and reason")
    if ("correct" in found) == ("score" in found):
        raise ValueError("expected one of correct and score")
    if "correct" in found and type(found["correct"]) is not bool:
        raise ValueError("correct must be true or false")
    if "score" in found and (type(found["score"]) is not int or not least <= found["score"] <= most):
        raise ValueError(f"score must be a whole number from {least} to {most}")
    if not isinstance(found.get("reason", ""), str):
        raise ValueError("reason must be text")
    return found


def write(root: str | Path, summary: dict, judges: dict[str, dict], measured: dict[str, dict]) -> str:
    """``aggregate.json``, ``FINAL.json`` and ``REPORT.md`` in a folder; the text of the last."""
    root = Path(root)
    root.mkdir(parents=True, exist_ok=True)
    for name, value in (("aggregate.json", summary | {"judges": judges, "performance": measured}), ("FINAL.json", summary | {"judges": judges})):
        replace(root / name, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    lines = ["# Report", "", f"State: {summary.get('state', 'unknown')}", "", "| judge | scored | failed | pending | accuracy | mean |", "|-|-|-|-|-|-|"]
    show = lambda v: UNRECORDED if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines += [f"| {name} | " + " | ".join(show(j.get(k)) for k in ("scored", "failed", "pending", "accuracy", "mean_score")) + " |" for name, j in judges.items()]
    lines += ["", "| measure | median | largest | count |", "|-|-|-|-|"]
    lines += [f"| {name} | {show(m['median'])} | {show(m['max'])} | {m['count']} |" for name, m in measured.items()]
    text = "\n".join(lines) + "\n"
    replace(root / "REPORT.md", text)
    return text


def replace(path: Path, text: str) -> None:
    """Write a file whole: beside, to the disk, then under its name; a reader sees the old one or the new one."""
    part = path.with_name(f".{path.name}.part")
    with open(part, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    part.replace(path)
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def file_hash(path: str | Path) -> str:
    """SHA-256, in hexadecimal, of a file, read in parts."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()
