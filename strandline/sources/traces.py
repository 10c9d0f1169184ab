"""Diagnostics as tables: spans with parents, and searches with the messages that asked for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.metrics.reports import upper_median

#: Labels that a mark may carry besides numbers; others are left out.
LABELS = ("stage", "kind", "mode", "outcome", "execution")
EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "id", "parentId", "traceId", *LABELS)]
    + [T.StructField(n, T.DoubleType()) for n in ("startMs", "durationMs", "clockOriginMs", "value")]
)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Timing events of JSON lines; fields that aren't known are left out."""
    return spark.read.schema(EVENT).json(path)


def write_events(events: DataFrame, path: str, most: int = 10_000) -> DataFrame:
    """Append events as JSON lines, ``most`` of each trace in the order of their start; how many were ``dropped`` by trace."""
    numbered = events.withColumn("n", F.row_number().over(Window.partitionBy("traceId").orderBy("startMs", "id")))
    numbered.where(F.col("n") <= most).drop("n").write.mode("append").json(path)
    return events.groupBy("traceId").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))


def with_parents(events: DataFrame) -> DataFrame:
    """Spans with the stage of their parent and their start on a common clock."""
    parents = events.select("traceId", F.col("id").alias("parentId"), F.col("stage").alias("parentStage"))
    at = F.coalesce("clockOriginMs", F.lit(0.0)) + F.col("startMs")
    return events.join(parents, ["traceId", "parentId"], "left").withColumn("atMs", at)


def in_phases(events: DataFrame, phases: DataFrame) -> DataFrame:
    """Spans joined to the phases (phase, startMs, endMs) that they begin in.

    A phase's bounds belong to it; a span in two phases counts in both.  Time is cut
    into slots as long as the mean phase, which spans and phases join by, so that
    neither side has to be small.
    """
    at = F.coalesce(events["clockOriginMs"], F.lit(0.0)) + events["startMs"]
    width = phases.agg(F.avg(F.col("endMs") - F.col("startMs")).alias("w")).first()["w"] or 1.0
    slot = lambda moment: F.floor(moment / F.lit(max(width, 1e-6))).cast("long")
    named = phases.where("endMs >= startMs").select("phase", F.col("startMs").alias("from"), F.col("endMs").alias("to"))
    named = named.withColumn("slot", F.explode(F.sequence(slot(F.col("from")), slot(F.col("to")))))
    spans = events.where("durationMs IS NOT NULL").withColumn("slot", slot(at)).withColumn("_at", at)
    return spans.join(named, "slot").where(F.col("_at").between(F.col("from"), F.col("to"))).drop("slot", "_at")


def stage_times(found: DataFrame) -> DataFrame:
    """Count, sum, mean and median (the upper of two) of durations by phase and stage."""
    return found.groupBy("phase", "stage").agg(
        F.count("*").alias("count"),
        F.sum("durationMs").alias("total_ms"),
        F.avg("durationMs").alias("mean_ms"),
        upper_median("durationMs").alias("p50_ms"),
    )


def correlated(calls: DataFrame, models: DataFrame, parents: DataFrame) -> DataFrame:
    """Searches (session_id, call_id, input) with what the model had asked for (session_id, call_id, arguments).

    A call made inside another (parents: session_id, call_id, parent_id; else by an
    id that ends in ``/number``) has no model message of its own.  ``identical`` is
    null where there is none.
    """
    key = ["session_id", "call_id"]
    by_name = F.nullif(F.regexp_extract("call_id", r"^(.*)/\d+$", 1), F.lit(""))
    inside = calls.join(parents.select(*key, "parent_id"), key, "left").withColumn("parent_id", F.coalesce("parent_id", by_name))
    asked = inside.join(models.select(*key, "arguments"), key, "left")
    own = F.when(F.col("parent_id").isNull(), F.col("arguments"))
    return asked.withColumn("arguments", own).withColumn("identical", F.when(own.isNotNull(), own == F.col("input")))


def unmatched_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool results (session_id, call_id, name) without a call of that id and name."""
    key = ["session_id", "call_id", "name"]
    return results.join(calls.select(*key), key, "left_anti")
