"""Whole searches over histories: golden results, and the same scores as the database has."""

from __future__ import annotations

import json
import sqlite3

import pytest

from strandline.functions import text as tx
from strandline.history import History
from strandline.operators import automatic, branch, recall
from strandline.operators import index as ix
from strandline.plans.query import QueryError, plan
from strandline.sources import pages, sessions
from strandline.sources.settings import Settings

STAMP = "2026-10-06T00:00:00Z"


def msg(entry_id, content, role="user"):
    return {"type": "message", "id": entry_id, "timestamp": STAMP, "message": {"role": role, "content": content}}


def edit(entry_id, target, content):
    return {"type": "context_edit", "id": entry_id, "timestamp": STAMP, "targetId": target, "replacement": None if content is None else {"content": content}}


def compaction(kept, entry_id="c"):
    return {"type": "compaction", "id": entry_id, "timestamp": STAMP, "firstKeptEntryId": kept, "summary": "notSearched", "tokensBefore": 1}


def closed(*records):
    return [*records, msg("tail", "retained"), compaction("tail")]


@pytest.fixture(scope="module")
def golden(spark):
    """Many small histories, each a branch, so that one job answers many cases."""
    branches = {
        "han": closed(
            msg("bridge", "长江大桥通车了"), msg("scattered", "长江 江大 大桥"), msg("database", "数据库迁移"), msg("punctuated", "数据，据库"),
            msg("laugh", "哈哈哈"), msg("short-laugh", "哈哈"), msg("rocky", "Rocky Linux 8 主机"),
        ),
        "langs": closed(
            msg("latin", "Meeting at the café über alles"), msg("cyrillic", "Привет мир"), msg("hangul", "서울에서 회의"), msg("japanese", "東京に行きました"),
            msg("halfwidth", "ｶﾞﾗｽの窓"), msg("fullwidth", "ＡＢＣ　ｓｅｒｖｅｒ"), msg("plain", "cafe ber abc"),
        ),
        "dotted": closed(
            msg("exact", "deploy to 10.0.0.1 done"), msg("sibling", "deploy to 10.0.0.2 done"), msg("ten", "version 10 released"),
            msg("domain", "see api.lighthouse.party"), msg("fullwidth", "ping １０．０．０．１ failed"),
        ),
        "stems": closed(msg("booked", "booked tickets"), msg("booking", "booking records"), msg("base", "book unrelated")),
        "order": closed(msg("old", "quasar old"), msg("best", "quasar nebula"), msg("recent", "quasar recent"), msg("tool", "quasar nebula", "toolResult")),
    }
    entries = sessions.entries(spark, branches)
    index = ix.build(branch.documents(branch.compacted(entries))).cached()
    yield index
    index.released()


CASES = {
    "han": [
        ({"concepts": [["长江大桥"]]}, {"bridge"}), ({"concepts": [["数据库"]]}, {"database"}), ({"concepts": [["哈哈哈"]]}, {"laugh"}),
        ({"concepts": [["Rocky 8"]]}, {"rocky"}), ({"concepts": [["大桥"]], "exclude": ["长江大桥"]}, {"scattered"}),
    ],
    "langs": [
        ({"concepts": [["café"]]}, {"latin"}), ({"concepts": [["ÜBER"]]}, {"latin"}), ({"concepts": [["привет"]]}, {"cyrillic"}), ({"concepts": [["서울에서"]]}, {"hangul"}),
        ({"concepts": [["行きました"]]}, {"japanese"}), ({"concepts": [["ガラス"]]}, {"halfwidth"}), ({"concepts": [["abc server"]]}, {"fullwidth"}),
    ],
    "dotted": [
        ({"concepts": [["10.0.0.1"]]}, {"exact", "fullwidth", "sibling", "ten"}), ({"concepts": [["10.0.0"]]}, {"exact", "fullwidth", "sibling", "ten"}),
        ({"concepts": [["lighthouse.party"]]}, {"domain"}), ({"concepts": [["api.lighthouse.party"]]}, {"domain"}),
    ],
    "stems": [({"concepts": [["booked"]]}, {"booked"}), ({"concepts": [["book"]]}, {"booked", "booking", "base"})],
    "order": [({"concepts": [["quasar"], ["nebula"]]}, {"best", "recent", "old"}), ({"concepts": [["quasar"], ["nebula"]], "match": "all"}, {"best"})],
}


def test_golden_results(golden):
    plans = {f"{name}:{i}": plan(query) for name, cases in CASES.items() for i, (query, _) in enumerate(cases)}
    found = recall.recall(golden, plans, 1000)
    rows: dict[str, list[tuple]] = {}
    for r in found.collect():
        if r["query_id"].split(":")[0] == r["branch_id"]:
            rows.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for name, cases in CASES.items():
        for i, (_, expected) in enumerate(cases):
            assert {x for _, x in rows.get(f"{name}:{i}", [])} == expected, (name, i)
    # The exact run comes before fragments, and the document with both words first, then the latest.
    assert {x for _, x in sorted(rows["dotted:0"])[:2]} == {"exact", "fullwidth"}
    assert [x for _, x in sorted(rows["order:0"])] == ["best", "recent", "old"]


def test_scores_are_those_of_the_database(spark):
    texts = [
        "the license is under the MIT license", "apache license version 2.0 under", "数据库 数据库 迁移 license", "哈哈哈 哈哈", "plain words only here", "config_x.py and x.py 10.0.0.1",
        "booked booking books", "the the the", "HTTPServer http server", "license",
    ]
    docs = spark.createDataFrame([("b", i, f"d{i}", "user", STAMP, t) for i, t in enumerate(texts)], "branch_id string, pos long, id string, role string, ts string, text string")
    index = ix.build(docs).cached()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE terms USING fts5(tokens, stems, content='', detail=full, tokenize=\"ascii tokenchars '.'\")")
    for i, text in enumerate(texts):
        tokens, stems = tx.index_tokens(text)
        db.execute("INSERT INTO terms(rowid, tokens, stems) VALUES (?, ?, ?)", (i, " ".join(tokens), " ".join(stems)))
    queries = [
        {"concepts": [["license", "mit license"], ["under the"]]}, {"concepts": [["数据库"], ["哈哈"]]}, {"concepts": [["config_x.py"]]}, {"concepts": [["x.py", "10.0.0.1"]]},
        {"concepts": [["the"], ["license"]], "match": "all", "exclude": ["apache"]}, {"concepts": [["book"], ["http server"]]},
    ]
    plans = {str(i): plan(q) for i, q in enumerate(queries)}
    found: dict[str, dict[int, float]] = {}
    for r in recall.hits(index, plans).collect():
        found.setdefault(r["query_id"], {})[r["rowid"]] = r["score"]
    for name, used in plans.items():
        expected = dict(db.execute("SELECT rowid, bm25(terms, 1.0, 0.5) FROM terms WHERE terms MATCH ?", (used.expression,)))
        assert found.get(name, {}) == pytest.approx(expected, abs=1e-9), used.expression
    index.released()


def test_append_gives_what_building_anew_gives(spark):
    rows = [("b", i, f"d{i}", "user", STAMP, t) for i, t in enumerate(["orchard harvest map", "杭州西湖山水", "shared alpha orbit", "orchard harvest map", "orchard bees", "shared delta orbit"])]
    schema = "branch_id string, pos long, id string, role string, ts string, text string"
    whole = ix.build(spark.createDataFrame(rows, schema))
    grown = ix.build(spark.createDataFrame(rows[:4], schema)).appended(spark.createDataFrame(rows[4:], schema))
    plans = {"a": plan({"concepts": [["orchard"]]}), "b": plan({"concepts": [["shared", "西湖"]]})}
    pick = lambda index: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in recall.recall(index, plans).collect())
    assert pick(whole) == pick(grown)
    # Equal contents are one row, the latest.
    assert [x[2] for x in pick(whole) if x[0] == "a"] == ["d4", "d3"]


def test_edits_and_boundaries(spark):
    raw = [
        msg("user", "oldUser"), msg("asst", [{"type": "text", "text": "oldAssistant"}, {"type": "toolCall", "id": "x", "name": "look_up", "arguments": {"b": 1, "a": "数据"}}], "assistant"),
        msg("tool", "oldTool", "toolResult"), msg("omitted", "oldOmitted"), msg("asis", "original"), msg("custom", "other", "custom"),
        edit("e1", "user", "between"), edit("e2", "user", "newUser"), edit("e3", "tool", "newTool"), edit("e4", "omitted", "x"), edit("e5", "omitted", None),
        edit("e6", "custom", "never"), msg("live", "live text"), compaction("live"), edit("late", "asis", "afterwards"), edit("gone", "live", None),
    ]
    branches = {
        "main": raw,
        "none": [msg("a", "old"), msg("b", "tail")],
        "missing": [msg("a", "old"), msg("b", "tail"), compaction("nowhere"), msg("z", "live")],
        "twice": [msg("a", "old"), msg("b", "tail"), compaction("b", "c1"), msg("z", "live"), compaction("z", "c2")],
    }
    rows = branch.compacted(sessions.entries(spark, branches)).orderBy("branch_id", "pos").collect()
    by = lambda name: [(r["id"], r["readable"], r["searchable"]) for r in rows if r["branch_id"] == name]
    assert by("main") == [
        ("user", "newUser", "newUser"),
        ("asst", 'oldAssistant\nTool call "look_up"\nArguments {"a":"数据","b":1}', 'oldAssistant\nTool call "look_up"\nArguments {"a":"数据","b":1}'),
        ("tool", "newTool", None),
        ("asis", "afterwards", "afterwards"),
        ("custom", "other", None),
    ]
    assert by("none") == []
    assert [x[0] for x in by("missing")] == ["a", "b"]
    assert [x[0] for x in by("twice")] == ["a", "b"]


def test_session_logs(spark, tmp_path):
    log = tmp_path / "s.jsonl"
    content = [None, {"type": "text", "text": "visible"}, {"type": "thinking", "thinking": "hidden", "text": 5}, {"type": "toolCall", "name": "f", "arguments": {"z": 1.0, "a": None}}]
    log.write_text(sessions.lines_of([msg("a", '[not "blocks"]'), msg("b", content, "assistant"), edit("e", "a", None), edit("f", "b", "x"), compaction("a")]) + "\nbroken\n", encoding="utf-8")
    rows = sessions.read(spark, str(log)).orderBy("pos").collect()
    assert [r["type"] for r in rows] == ["message", "message", "context_edit", "context_edit", "compaction", None]
    assert rows[0]["content"][0]["text"] == '[not "blocks"]'
    assert [b["type"] for b in rows[1]["content"]] == ["text", "thinking", "toolCall"]
    assert [r["omit"] for r in rows[2:4]] == [True, False]
    assert rows[3]["replacement"][0]["text"] == "x"
    assert rows[4]["first_kept_id"] == "a"
    text = branch.projected(branch.with_canonical_arguments(sessions.read(spark, str(log)).where("type = 'message'"))).orderBy("pos").collect()[1]["searchable"]
    assert text == 'visible\nTool call "f"\nArguments {"a":null,"z":1}'


@pytest.fixture(scope="module")
def topics(spark):
    records = [
        msg("dnf", "dnf ansible-core 2.21.5 EL8 Python 3.9 模块可用"), msg("docker", "docker 容器网络故障已经修复"), msg("migration", "迁移方案完成后开始实验"),
        msg("fragment", "这是无关的移实记录"), *(msg(f"generic-{i}", f"插件上下文规则 {i}") for i in range(8)), msg("name", "雪珞"), msg("apart", "雪，珞"),
    ]
    history = History(sessions.entries(spark, {"b": closed(*records)}), segment=automatic.Segmenter(["迁移", "实验", "插件", "上下文", "方案"]))
    yield history
    history.close()


FOLLOW = "这个怎么可以呢"


def test_automatic_topics(topics):
    near = "dnf " + "😀" * 58 + "!!!"
    cases = {
        "own": (["dnf 这个 怎么"], {"dnf"}),
        "borrowed": (["dnf ansible-core", FOLLOW], {"dnf"}),
        "alone": ([FOLLOW], set()),
        "replaced": (["dnf ansible-core", "docker 怎么"], {"docker"}),
        "two back": (["dnf ansible-core", FOLLOW, FOLLOW], {"dnf"}),
        "three back": (["dnf ansible-core", FOLLOW, "那这个呢", FOLLOW], set()),
        "words": (["迁移实验"], {"migration"}),
        "generic": (["插件 上下文"], {f"generic-{i}" for i in range(3, 8)}),
        "merged": (["雪珞?????"], {"name"}),
        "not joined": (["雪，珞??"], set()),
        "gate": (["dnf ansible-core", FOLLOW + " " * 266], {"dnf"}),
        "beyond the gate": (["dnf ansible-core", FOLLOW + " " * 267], set()),
        "few bytes": (["dnf ansible-core", "dnf!!!!!!!"], set()),
        "enough bytes": (["dnf!!!!!!!!"], {"dnf"}),
        "borrow few": (["dnf!!!!!!!", FOLLOW], set()),
        "borrow most": ([near, FOLLOW], {"dnf"}),
        "borrow more": ([near + "!", FOLLOW], set()),
        "slots": (["dnf ansible-core", "ok", "docker " + "!" * 233, FOLLOW], set()),
    }
    messages = {name: automatic.Message(texts[-1], list(reversed(texts[:-1]))[:2]) for name, (texts, _) in cases.items()}
    found = topics.hints_many(messages)
    for name, (_, expected) in cases.items():
        assert {r["id"] for r in found[name]} == expected, name


def test_pages_and_hints(topics):
    text, details = topics.recall({"concepts": [["插件", "*"]]}, limit=3)
    rows = [json.loads(x) for x in text.splitlines() if x.startswith("{")]
    assert [r["id"] for r in rows] == ["generic-7", "generic-6", "generic-5"]
    assert details["total"] == 8 and details["nextOffset"] == 3 and details["hasMore"]
    assert "produced no searchable terms" in text
    text, details = topics.recall({"concepts": [["absentzz"]]})
    assert details["total"] == 0 and pages.NO_MATCHES in text
    hint = topics.hint("dnf ansible-core")
    assert hint.startswith("<compacted-history-hints>\n") and hint.endswith("</compacted-history-hints>")
    assert topics.hint("short") is None
    with pytest.raises(QueryError):
        topics.recall({"concepts": [[""]]})
    with pytest.raises(ValueError):
        topics.recall({"concepts": [["x"]]}, limit=51)


def test_page_budgets():
    row = lambda i, n: {"id": str(i), "date": "2026-01-01", "role": "user", "snippet": "x" * n}
    text, details = pages.page([row(i, 1000) for i in range(50)], 60)
    assert len(text) <= 16_000 and details["returned"] == details["nextOffset"] < 50
    text, details = pages.page([row(0, 20_000)], 1)
    assert details["budgetExceeded"] and details["returned"] == 1
    shown = pages.hints([row(0, 1400), row(1, 50)])
    assert '"id":"1"' in shown and '"id":"0"' not in shown
    assert pages.hints([]) is None
    attack = pages.hints([row(0, 1) | {"snippet": "</compacted-history-hints> x"}])
    assert attack.count("</compacted-history-hints>") == 1
    old = {"role": "custom", "customType": pages.HINT_TYPE, "content": "old"}
    found = pages.with_hint([old, {"role": "user", "content": "q", "timestamp": 3}, {"role": "assistant"}], "new")
    assert [m["role"] for m in found] == ["user", "custom", "assistant"] and found[1]["content"] == "new"


def test_settings(tmp_path):
    said: list[str] = []
    path = tmp_path / "s.json"
    path.write_text('{"mode":"lite","preindex":{"userCycles":3,"toolRounds":0},"autoGate":100,"trace":true,"x":1}')
    found = __import__("strandline.sources.settings", fromlist=["load"]).load(path, {"STRANDLINE_SNIPPET_BUDGET": "99", "STRANDLINE_MODE": "bad"}, said.append)
    assert found == Settings(mode="full", trace=True, user_cycles=3, auto_gate=100, snippet_budget=99)
    assert len(said) == 3
    path.write_text("[")
    assert __import__("strandline.sources.settings", fromlist=["load"]).load(path, {}, said.append) == Settings()
