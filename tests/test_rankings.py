"""Further searches, measures, reports, corpora and traces on small tables."""

from __future__ import annotations

import json
import math

import pytest

from strandline.metrics import reports, retrieval
from strandline.operators import index as ix
from strandline.operators import ranking
from strandline.plans.query import Plan
from strandline.sources import corpora, traces


@pytest.fixture(scope="module")
def notes(spark):
    texts = ["Deploy the database on Rocky Linux", "database backup plan", "Rocky mountains hike plan", "数据库迁移计划", "running shoes and runs", "backup of the shoe shop"]
    rows = [("b", i, f"n{i}", "user", "2026-01-01", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "branch_id string, pos long, id string, role string, ts string, text string")
    index = ix.build(docs).cached()
    yield docs, index
    index.released()


def test_must_prefer_exclude(notes):
    _, index = notes
    query = ranking.Structured(must=[["plan", "deploy"]], prefer=[["rocky"], ["database"]], exclude=["hike"], limit=5)
    rows = ranking.structured(index, query).orderBy("prefer_groups", ascending=False).collect()
    assert [(r["id"], r["prefer_groups"], r["total"]) for r in rows] == [("n0", 2, 2), ("n1", 1, 2)]
    only = ranking.structured(index, ranking.Structured(prefer=[["数据库"], ["hike"]])).collect()
    assert {r["id"] for r in only} == {"n3", "n2"}
    for bad in (ranking.Structured(), ranking.Structured(must=[[]]), ranking.Structured(must=[["a"]]), ranking.Structured(must=[["x\0y"]]), ranking.Structured(must=[["plan"]], limit=0)):
        with pytest.raises(TypeError):
            ranking.structured_plans(bad)


def test_words_near_a_word(notes):
    _, index = notes
    assert {(r[0], r[1]) for r in ranking.with_prefix(index, {"a": "run", "b": "ba"}, 3).collect()} == {("a", "running"), ("a", "runs")}
    assert {(r[1], r[2]) for r in ranking.fuzzy(index, {"q": "shoos"}).collect()} == {("shoes", 1)}
    best = ranking.fuzzy_search(index, {"q": "databse"}).orderBy("rank").collect()
    assert {r["id"] for r in best} == {"n0", "n1"}
    assert {r["term"] for r in ranking.expanded(index, {"q": "shoe"}).collect()} == {"shoe", "shoes"}


@pytest.mark.parametrize(("word", "lemma"), [("running", "run"), ("studies", "study"), ("went", "go"), ("classes", "class"), ("happiest", "happy"), ("bus", "bus"), ("x1", "x1")])
def test_lemmas(word, lemma):
    assert ranking.lemma(word) == lemma


def test_substrings_tiers_and_places(notes, spark):
    docs, index = notes
    from pyspark.sql import functions as F

    grams = docs.select("branch_id", "id", F.explode(ranking.trigrams(F.col("text"))).alias("gram"))
    found = ranking.substring_candidates(docs, grams, {"a": "ROCKY", "b": "库迁移", "c": "of"}).collect()
    assert {(r["query_id"], r["id"]) for r in found} == {("a", "n0"), ("a", "n2"), ("b", "n3"), ("c", "n5")}
    one = spark.createDataFrame([("q", "b", "x", -1.0)], "query_id string, branch_id string, id string, score double")
    two = spark.createDataFrame([("q", "b", "x", -9.0), ("q", "b", "y", -2.0)], "query_id string, branch_id string, id string, score double")
    assert {(r["id"], r["tier"]) for r in ranking.tiers(one, two).collect()} == {("x", 0), ("y", 1)}
    assert {r["rowid"] for r in ranking.within(index, "database", "rocky", 1).collect()} == {0}
    texts = spark.createDataFrame([("d", "It was two months ago, I think two months"), ("e", "Two MONTHS, ago"), ("f", None), ("g", "of it")], "id string, text string")
    answers = spark.createDataFrame([("q", "two months ago"), ("s", "of it"), ("w", "Ago"), ("n", None)], "query_id string, answer string")
    found = {(r["query_id"], r["id"], r["phrase"], r["first"], r["start"], r["end"]) for r in ranking.answer_places(texts, answers).collect()}
    assert found == {
        ("q", "d", "two months ago", 2, 7, 21), ("q", "d", "two months", 7, 31, 41), ("q", "e", "two months ago", 0, 0, 15),
        ("w", "d", "ago", 4, 18, 21), ("w", "e", "ago", 2, 12, 15),
    }
    assert ranking.fixed_window("a" * 100 + "needle", ["needle"]) == (60, 106)


def test_rarity_and_pools(notes, spark):
    docs, _ = notes
    rows = docs.selectExpr("*", "pos AS recency")
    best = ranking.by_rarity(rows, {"q": "database plan of rocky"}).orderBy("rank").collect()
    weight = lambda df: 1 + math.log(7 / (df + 1))
    assert best[0]["score"] == pytest.approx(2 * weight(2))
    # Equal scores: the latest first.
    assert [r["id"] for r in best] == ["n2", "n1", "n0"]
    assert ranking.lex("HTTPServer the 数据库") == [("httpserver", 0), ("http", 0), ("server", 4), ("数据", 15), ("据库", 16)]
    pool = ranking.pool([spark.createDataFrame([("q", "x", 1.0, 1), ("q", "y", 2.0, 2)], "query_id string, id string, score double, recency long"), best and spark.createDataFrame([("q", "x", 3.0, 1)], "query_id string, id string, score double, recency long")])
    assert [(r["rank"], r["id"]) for r in pool.orderBy("rank").collect()] == [(1, "x"), (2, "y")]
    again = ranking.reranked(pool, spark.createDataFrame([("q", "y", 9.0)], "query_id string, id string, model_score double"))
    assert [r["id"] for r in again.orderBy("rank").collect()] == ["y", "x"]


def test_long_words_come_first(notes):
    from strandline.operators import recall
    from strandline.plans.query import plan

    _, index = notes
    found = recall.representatives(index, recall.hits(index, {"q": plan({"concepts": [["数据库"], ["plan"]]})}))
    rows = ranking.long_words_first(index, found, {"q": ["数据库", "计划"]}).collect()
    assert {(r["rowid"], r["long_words"]) for r in rows} == {(1, 0), (2, 0), (3, 1)}
    assert [r["rank"] for r in ranking.cooccurrence(index, {"q": Plan(plan({"concepts": [["plan"]]}).groups)}).orderBy("rank").collect()] == [1, 2]


def test_measures(spark):
    results = spark.createDataFrame([("q", i, r + 1) for r, i in enumerate(["x", "b", "y", "z", "w", "c"])], "query_id string, id string, rank int")
    gold = spark.createDataFrame([("q", i) for i in "abc"] + [("none", "a")], "query_id string, id string")
    rows = {r["query_id"]: r for r in retrieval.measures(results, gold, (5, 10)).collect()}
    assert rows["q"]["mrr"] == 0.5
    assert rows["q"]["ndcg_5"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3) + 1 / math.log2(4)))
    assert (rows["q"]["recall_5"], rows["q"]["recall_10"], rows["q"]["precision_5"]) == (pytest.approx(1 / 3), pytest.approx(2 / 3), 0.2)
    assert rows["none"]["mrr"] == 0.0
    calls = spark.createDataFrame([("q", 1, "x", 1), ("q", 1, "b", 2), ("q", 2, "c", 1), ("q", 2, "b", 2)], "query_id string, call int, id string, rank int")
    assert {r["query_id"]: r["recall"] for r in retrieval.tool_recall(calls, gold, 5).collect()} == {"q": pytest.approx(2 / 3), "none": 0.0}
    arms = spark.createDataFrame([("g", "q", "a"), ("m", "q", "a"), ("m", "q", "b"), ("m", "q", "c")], "arm string, query_id string, id string")
    assert {r["arm"]: (r["located"], r["any"], r["all"]) for r in retrieval.coverage(arms, gold).collect()} == {"g": (1, 1, 0), "m": (3, 1, 1)}
    shared = retrieval.overlap(results.selectExpr("query_id AS case", "id", "rank"), calls.where("call = 1").selectExpr("query_id AS case", "id", "rank"), (5,)).first()
    assert (shared["shared_5"], shared["asked_5"], shared["exact"]) == (2, 5, 0.0)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("graded", True, 9), ("graded", False, 4), ("pending", None, None), ("error", None, None)], "status string, correct boolean, score int")
    got = reports.judged(rows).first()
    assert (got["selected"], got["scored"], got["failed"], got["pending"], got["accuracy"], got["mean_score"], got["at_least"]) == (4, 2, 1, 1, 0.5, 6.5, 1)
    assert reports.judged(rows.where("status = 'pending'")).first()["accuracy"] is None
    spans = spark.createDataFrame([(0, 10), (5, 7), (7, 12), (10, 11)], "begin int, end int")
    assert reports.peak(spans).first()["peak"] == 2
    tries = spark.createDataFrame([("a", 5, 1, False), ("a", 6, None, True), ("b", 1, 2, None)], "question_id string, wall_ms int, tokens int, timeout boolean")
    assert {r[0]: (r["wall_ms"], r["tokens"], r["timeouts"]) for r in reports.attempts(tries).collect()} == {"a": (11, None, 1), "b": (1, 2, 0)}
    assert reports.capacity_errors(spark.createDataFrame([("429 Too Many Requests",), ("bad key",)], "error string")).count() == 1
    assert reports.verdict('{"score": 8, "reason": "x"}')["score"] == 8
    for bad in ('{"score": 8, "score": 9}', '{"score": 11}', '{"correct": 1}', '{"score": 1, "correct": true}', "[]", '{"score": 1.0}'):
        with pytest.raises(ValueError):
            reports.verdict(bad)
    text = reports.write(tmp_path, {"state": "done"}, {"j": {"scored": 1, "failed": 0, "pending": 0, "accuracy": None, "mean_score": 8.0}}, {"seconds": {"count": 0, "median": None, "max": None}})
    assert reports.UNRECORDED in text and json.loads((tmp_path / "FINAL.json").read_text())["state"] == "done"


def test_corpora(spark):
    schema = "question_id string, haystack_dates array<string>, haystack_sessions array<array<struct<role: string, content: string>>>"
    rows = [("q", ["2023/05/21 (Sun) 10:00", "2023/05/20 (Sat) 02:21", "2023/05/22 (Mon) 00:00"], [[("user", "later"), ("assistant", "yes")], [("assistant", "hello")], []])]
    found = corpora.messages(spark.createDataFrame(rows, schema)).orderBy("pos").collect()
    assert [(r["id"], r["role"], r["text"]) for r in found] == [
        ("00000001", "user", "[Session Date: 2023/05/20 (Sat) 02:21]"),
        ("00000002", "assistant", "hello"),
        ("00000003", "user", "[Session Date: 2023/05/21 (Sun) 10:00]\nlater"),
        ("00000004", "assistant", "yes"),
    ]
    assert found[2]["timestamp"] - found[0]["timestamp"] == ((7 * 60 + 39 + 24 * 60) * 60 + 2) * 1000
    cuts = spark.createDataFrame([("a", 0, 2), ("a", 1, 5), ("b", 0, 3), ("b", 1, 3), ("c", 0, 9)], "branch_id string, n int, cut int")
    sizes = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "branch_id string, size int")
    assert {r[0] for r in corpora.invalid_cuts(cuts, sizes).collect()} == {"b", "c"}


def test_traces(spark, tmp_path):
    events = [("span", "1", None, "t", "query", 0.0, 9.0), ("span", "2", "1", "t", "scan", 1.0, 4.0), ("span", "3", "1", "t", "scan", 5.0, 6.0)]
    table = spark.createDataFrame([(*e[:4], e[4], None, None, None, None, e[5], e[6], 100.0, None) for e in events], traces.EVENT)
    dropped = traces.write_events(table, str(tmp_path / "e"), 2).first()["dropped"]
    assert dropped == 1 and traces.read_spans(spark, str(tmp_path / "e")).count() == 2
    assert {(r["id"], r["parentStage"], r["atMs"]) for r in traces.with_parents(table).collect()} == {("1", None, 100.0), ("2", "query", 101.0), ("3", "query", 105.0)}
    phases = spark.createDataFrame([("warm", 100.0, 104.0)], "phase string, startMs double, endMs double")
    times = {r["stage"]: (r["count"], r["p50_ms"]) for r in traces.stage_times(traces.in_phases(table, phases)).collect()}
    assert times == {"query": (1, 9.0), "scan": (1, 4.0)}
    calls = spark.createDataFrame([("s", "a", "x"), ("s", "b/2", "x"), ("s", "c", "y")], "session_id string, call_id string, input string")
    models = spark.createDataFrame([("s", "a", "x"), ("s", "b/2", "x"), ("s", "c", "z")], "session_id string, call_id string, arguments string")
    none = spark.createDataFrame([], "session_id string, call_id string, parent_id string")
    assert {r["call_id"]: r["identical"] for r in traces.correlated(calls, models, none).collect()} == {"a": True, "b/2": None, "c": False}
    results = spark.createDataFrame([("s", "a", "n"), ("s", "q", "n")], "session_id string, call_id string, name string")
    known = spark.createDataFrame([("s", "a", "n")], "session_id string, call_id string, name string")
    assert [r["call_id"] for r in traces.unmatched_results(known, results).collect()] == ["q"]


def test_places_of_answers_hold_few_words_at_once(spark):
    """Many texts, and one long one, in a batch: only words that begin a phrase leave the worker, and it never holds them all."""
    import tracemalloc

    import pyarrow as pa

    texts = [f"some words {i} of the MIT license and the mit, license" for i in range(300)] + ["filler " * 200_000 + "the mit license " * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in ranking.words_ahead([batch], frozenset({"the", "mit"})))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4 * 300 + 2 * 3 and peak < 40 << 20
    every = [r for b in ranking.words_ahead([batch.slice(299)], held=50) for r in b.to_pylist()]
    assert [r["first"] for r in every if r["id"] == 300] == list(range(200_009))
    assert every[-9]["words"] == ["the", "mit", "license"] * 3 and every[-20]["words"] == ["filler"] * 11 + ["the"] and every[-1]["ends"] == [len(texts[-1]) - 1]
    docs = spark.createDataFrame(list(enumerate(texts[290:])), "id long, text string")
    answers = spark.createDataFrame([("q", "The MIT license")], "query_id string, answer string")
    known, unknown = (sorted(map(tuple, ranking.answer_places(docs, answers, n).collect())) for n in (3, None))
    assert known == unknown and len(known) == 2 * 10 + 3


def test_equal_weights_have_equal_sums_in_any_order(spark):
    """Copies whose weights come in another order tie to the last bit, so the order of a page is that of its later keys."""
    import itertools

    from pyspark.sql import functions as F

    from strandline.operators import recall

    weights = list(enumerate([7.675331203985278, 5.796021990542777, 7.142474850582529]))
    rows = [(doc, *row) for doc, order in enumerate(itertools.permutations(weights)) for row in order] + [(9, 0, None)]
    table = spark.createDataFrame(rows, "doc int, phrase int, weight double").coalesce(1)
    plain, found = ({r["doc"]: r["s"] for r in table.groupBy("doc").agg(f.alias("s")).collect()} for f in (F.sum("weight"), recall.summed("phrase", F.col("weight"))))
    assert len(set(plain.values()) - {None}) > 1
    assert {found[doc] for doc in range(6)} == {20.613828045110587} and found[9] is None
