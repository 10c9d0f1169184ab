"""One branch, type or case with most of the rows: the same results, and no window or list over all of it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.metrics import reports, retrieval
from strandline.operators import expand
from strandline.sources import sessions, traces


def slow_peak(intervals):
    changes = {}
    for begin, end in intervals:
        changes[begin] = changes.get(begin, 0) + 1
        changes[end] = changes.get(end, 0) - 1
    now = most = None
    for at in sorted(changes):
        now = (now or 0) + changes[at]
        most = now if most is None else max(most, now)
    return most


@pytest.mark.parametrize("slots", [1, 7, 1_024])
def test_peaks_of_a_hot_type(spark, slots):
    pick = random.Random(3)
    rows = [("hot", b, b + pick.randrange(1, 60)) for b in (pick.randrange(3_000) for _ in range(1_500))] + [("one", 5, 5), ("two", 0, 9), ("two", 9, 12)]
    table = spark.createDataFrame(rows, "kind string, begin long, end long")
    found = {r["kind"]: r["peak"] for r in reports.peak(table, by=["kind"], slots=slots).collect()}
    assert found == {k: slow_peak([(b, e) for x, b, e in rows if x == k]) for k in ("hot", "one", "two")}
    assert reports.peak(table, slots=slots).first()["peak"] == slow_peak([(b, e) for _, b, e in rows])
    # The running sums are by type and part of time: no part has most of the rows.
    plan = reports.peak(table, by=["kind"])._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" in plan and "collect_list" not in plan


@pytest.mark.parametrize("block", [3, 100, 4_096])
def test_numbers_of_a_long_branch(spark, block):
    positions = sorted(random.Random(4).sample(range(20_000), 2_000))
    rows = [("long", p) for p in positions] + [("short", 17), ("short", 4_096)]
    found = expand.numbered(spark.createDataFrame(rows, "branch_id string, pos long"), block).collect()
    assert {(r["branch_id"], r["pos"]): r["n"] for r in found} == {**{("long", p): i + 1 for i, p in enumerate(positions)}, ("short", 17): 1, ("short", 4_096): 2}


def test_lines_of_a_log_that_is_read_in_parts(spark, tmp_path):
    lines = [f'{{"type":"message","id":"m{i}","message":{{"role":"user","content":"line {i} {"x" * (i % 50)}"}}}}' for i in range(3_000)]
    lines[7] = ""
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text(lines[0], encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        table = sessions.read(spark, f"{tmp_path}/*.jsonl")
        found = {(r["branch_id"].rsplit("/", 1)[1], r["pos"]): r["id"] for r in table.select("branch_id", "pos", "id").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == {**{("a.jsonl", i): f"m{i}" for i in range(3_000) if i != 7}, ("b.jsonl", 0): "m0"}


def test_medians_and_overlaps(spark):
    rows = spark.createDataFrame([("a", v) for v in (5.0, 1.0, 3.0, 9.0, None)] + [("b", 2.0), ("c", None)], "k string, v double")
    found = {r["k"]: (r["median"], r["n"]) for r in reports.cells(rows, "v", ["k"]).collect()}
    assert found == {"a": (5.0, 4), "b": (2.0, 1), "c": (None, 0)}
    schema = "case string, id string, rank long, page string"
    base = spark.createDataFrame([("x", "1", 1, "p"), ("x", "2", 2, "p"), ("y", "1", 1, "q"), ("z", "1", 1, "r"), ("z", "2", 2, "r")], schema)
    other = spark.createDataFrame([("x", "2", 1, "p"), ("x", "3", 2, "p"), ("y", "1", 1, "o"), ("w", "9", 1, "s"), ("z", "1", 1, "r"), ("z", "2", 2, "r")], schema)
    row = retrieval.overlap(base, other, (1, 2), "page").first()
    assert (row["cases"], row["new_on_empty"], row["shared_1"], row["asked_1"], row["shared_2"], row["asked_2"]) == (4, 1, 2, 3, 4, 5)
    assert (row["exact"], row["same_pages"]) == (0.5, 0.5)


def test_phases_of_all_lengths(spark):
    pick = random.Random(5)
    spans = [(float(pick.randrange(1_000)), 1.0, None if i % 2 else 10.0) for i in range(200)]
    phases = [("a", 0.0, 1_010.0), ("b", 100.0, 100.0), ("c", 250.0, 260.5), ("d", 9.0, 3.0), ("e", 5_000.0, 6_000.0)]
    events = spark.createDataFrame(spans, "startMs double, durationMs double, clockOriginMs double").withColumn("stage", F.lit("s"))
    found = sorted((r["phase"], r["startMs"]) for r in traces.in_phases(events, spark.createDataFrame(phases, "phase string, startMs double, endMs double")).collect())
    assert found == sorted((p, s) for s, _, o in spans for p, a, b in phases if a <= s + (o or 0) <= b)
