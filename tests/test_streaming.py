"""Cadences and the maintained index."""

from __future__ import annotations

import pytest

from strandline.operators import branch, recall
from strandline.operators.index import build
from strandline.plans.query import plan
from strandline.sources import sessions
from strandline.streaming import cadence, maintenance
from strandline.streaming.maintenance import Store, maintain, with_deadline

STAMP = "2026-10-06T00:00:00Z"


def msg(entry_id, content):
    return {"type": "message", "id": entry_id, "timestamp": STAMP, "message": {"role": "user", "content": content}}


def test_counts_of_a_session():
    own = cadence.Cadence(every_cycles=2, every_batches=2)
    assert own.event("end", None, True) is None  # no user message before
    assert [own.event(k, None, ok) for k, ok in (("user", True), ("end", True), ("user", True), ("end", False), ("user", True), ("end", True))] == [None] * 5 + ["cycles"]
    assert [own.event("batch", i, True) for i in ("a", "a", "b")] == [None, None, "batches"]
    assert own.event("batch", "c", False) is None
    own.event("reset", None, True)
    assert own.event("batch", "a", True) is None


def test_stream_of_events(spark, tmp_path):
    rows = [(s, i, "batch", f"{s}{i // 2}", True) for s in ("x", "y") for i in range(8 if s == "x" else 3)]
    schema = "session_id string, pos long, kind string, event_id string, ok boolean"
    source = tmp_path / "in"
    table = spark.createDataFrame(rows, schema)
    table.where("pos < 4").coalesce(1).write.parquet(str(source / "1"))
    stream = spark.readStream.schema(schema).parquet(str(source / "*"))
    run = lambda: cadence.due(stream, 10, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    table.where("pos >= 4").coalesce(1).write.parquet(str(source / "2"))
    run()
    found = spark.read.schema(cadence.DUE).parquet(str(tmp_path / "out")).collect()
    # Ids come twice; state goes on over batches and restarts.
    assert sorted((r["session_id"], r["pos"], r["reason"]) for r in found) == [("x", 2, "batches"), ("x", 6, "batches"), ("y", 2, "batches")]
    counts = {r["session_id"]: (r["due"], r["since"]) for r in cadence.due_counts(table, 2).collect()}
    assert counts == {"x": (2, 0), "y": (1, 0)}
    cycles = spark.createDataFrame([("x", i, k, None, True) for i, k in enumerate(["user", "end", "end", "user", "end"])], schema)
    assert cadence.completed_cycles(cycles).first()["cycles"] == 2


def test_maintained_index(spark, tmp_path):
    tail = lambda n: [msg(f"tail{n}", "retained"), {"type": "compaction", "id": f"c{n}", "timestamp": STAMP, "firstKeptEntryId": f"tail{n}"}]
    first = [msg("m0", "orchard harvest"), msg("m1", "silver lake"), *tail(0)]
    second = [msg("m2", "orchard bees"), *tail(1)]
    third = [{"type": "context_edit", "id": "e", "timestamp": STAMP, "targetId": "m0", "replacement": {"content": "replaced words"}}]
    other = [msg("z", "orchard elsewhere"), *tail(9)]
    whole = sessions.entries(spark, {"a": first + second + third, "b": other})
    part = lambda low, high, b="a": whole.where(f"branch_id = '{b}' AND pos >= {low} AND pos < {high}")
    store = Store(spark, str(tmp_path / "store"))
    assert store.update(part(0, 4).union(part(0, 9, "b")), 0) == {"appended": 0, "rebuilt": 2}
    assert store.update(part(4, 7), 1) == {"appended": 1, "rebuilt": 0}
    assert store.update(part(4, 7), 1) == {"appended": 0, "rebuilt": 0}  # the same batch again
    assert store.update(part(7, 8), 2) == {"appended": 0, "rebuilt": 1}
    plans = {"q": plan({"concepts": [["orchard"], ["replaced", "retained"]]})}
    pick = lambda index: sorted((r["branch_id"], r["id"], round(r["score"], 9)) for r in recall.recall(index, plans).collect())
    assert store.version() == 2
    assert pick(store.index()) == pick(build(branch.documents(branch.compacted(whole))))
    assert [x[1] for x in pick(store.index(1))] == ["m0", "m2", "tail0", "z"]
    assert {(r["branch_id"], r["id"]) for r in store.pending().collect()} == {("a", "tail1"), ("b", "tail9")}


def _files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_only_touched_buckets_are_written_and_a_failure_loses_nothing(spark, tmp_path, monkeypatch):
    log = lambda b, n: [msg(f"{b}{i}", f"orchard {b} word{i}") for i in range(n)] + [msg(f"{b}t", "tail"), {"type": "compaction", "id": f"{b}c", "timestamp": STAMP, "firstKeptEntryId": f"{b}t"}]
    names = [f"x{i}" for i in range(12)]
    whole = sessions.entries(spark, {b: log(b, 3) for b in names})
    store = Store(spark, str(tmp_path / "store"), buckets=8)
    store.update(whole, 0)
    before = _files(tmp_path / "store")
    more = sessions.entries(spark, {"x0": [*log("x0", 3), msg("y0", "orchard later")]}).where("pos >= 5")
    # The batch fails when its pointer gets its name, and again when it is half written: the old snapshot stays.
    real = Store._point
    monkeypatch.setattr(Store, "_point", lambda self, version, held: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.update(more, 1)
    assert store.version() == 0 and store.index().documents.count() == 36
    (tmp_path / "store" / "POINTER-000000000001.json").write_text('{"version": 1, "entr')
    assert store.version() == 0 and store.index().documents.count() == 36
    monkeypatch.setattr(Store, "_point", real)
    assert store.update(more, 1) == {"appended": 1, "rebuilt": 0}
    assert store.version() == 1 and store.entries(1).count() == whole.count() + 1
    # Of eight buckets one was written.
    new = {name.split("/")[-2] for name in _files(tmp_path / "store") - before}
    assert len(new) == 1
    # The row beyond the boundary is cut already, and counts from the compaction on that takes it in.
    index, pending = store.index(), store.pending().where("branch_id = 'x0'")
    assert {r["id"] for r in pending.collect()} == {"x0t", "y0"} and index.stats.where("branch_id = 'x0'").first()["n"] == 3
    end = sessions.entries(spark, {"x0": [{"type": "compaction", "id": "c2", "timestamp": STAMP, "firstKeptEntryId": "none"}]}).selectExpr("branch_id", "9L AS pos", *[c for c in whole.columns if c not in ("branch_id", "pos")])
    assert store.update(end, 2) == {"appended": 1, "rebuilt": 0}
    assert store.index().stats.where("branch_id = 'x0'").first()["n"] == 5 and store.pending().where("branch_id = 'x0'").count() == 0
    monkeypatch.setattr(maintenance, "MOST_PARTS", 3)
    for version in range(3, 6):
        store.update(sessions.entries(spark, {"x0": [msg(f"z{version}", "more")]}).selectExpr("branch_id", f"{version + 20}L AS pos", *[c for c in whole.columns if c not in ("branch_id", "pos")]), version)
    # Old snapshots go, the parts of a bucket's entries are joined, and nothing of the history is lost.
    assert store.versions() == [3, 4, 5] and store.entries(5).count() == whole.count() + 2 + 3
    assert any("entries-whole" in n for n in _files(tmp_path / "store"))
    assert not [n for n in _files(tmp_path / "store") if n.startswith(("v1/documents", "v2/documents"))]
    plans = {"q": plan({"concepts": [["orchard"]]})}
    pick = lambda index: sorted((r["branch_id"], r["id"], round(r["score"], 9)) for r in recall.recall(index, plans).collect())
    assert pick(store.index()) == pick(build(branch.documents(branch.compacted(store.entries(5)))))


def test_stream_into_an_index(spark, tmp_path):
    rows = sessions.entries(spark, {"a": [msg("m0", "quasar"), msg("m1", "tail"), {"type": "compaction", "id": "c", "timestamp": STAMP, "firstKeptEntryId": "m1"}]})
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    maintain(stream, str(tmp_path / "store"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert [r["id"] for r in Store(spark, str(tmp_path / "store")).index().documents.collect()] == ["m0"]


def test_deadline(spark):
    assert with_deadline(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(TimeoutError):
        with_deadline(spark, 0.5, lambda: spark.range(1 << 40).selectExpr("sum(hash(id))").collect())
