"""Other tokenizers, raw operands, captured traces, arrays."""

from __future__ import annotations

import json

import pytest

from strandline.functions import alternatives as alt
from strandline.functions.canonical import canonical_hash
from strandline.sources import arrays, capture


def test_whole_identifiers_and_dictionary_words():
    assert alt.whole_terms("The HTTPServer_x of fooBar") == ["httpserver_x", "foobar"]
    assert alt.whole_terms("数据库迁移 a x", {"数据库", "迁移"}) == ["数据", "数据库", "据库", "库迁", "迁移", "x"]
    assert alt.han_terms("南京市长江大桥", {"长江大桥", "南京市"})[:3] == [("南京", 0, 2), ("南京市", 0, 3), ("京市", 1, 3)]


def test_pairs_singles_and_routes():
    assert alt.paired_text("见数据库 ok 한국") == " 见数 数据 据库  ok  한국 "
    assert alt.single_text("数据a库") == "数 据 库"
    assert alt.span_terms('alpha "two words" -- "!!" b') == ["alpha", "two words", "b"]
    found = alt.route(["ab", "alpha", "库"])
    assert (found.lexical, found.trigram, found.required) == (("ab", "alpha", "库"), ("alpha",), ("ab", "库"))
    assert alt.route(["ab"]).required == ()


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ('alpha AND "two ""q"" words"* OR beta', ["alpha", "two", "q", "words*", "beta"]),
        ("{tokens stems} : foo* NOT NEAR(a b, 5) ^c", ["foo*", "a", "b", "c"]),
        ("title:x (NEAR AND 5) near(2, 3)", ["x", "near", "5", "near", "2", "3"]),
        ('"" + - 长江', ["长江"]),
        ("a:) b}", ["b"]),
    ],
)
def test_operands_of_raw_expressions(expression, expected):
    assert [o.term + "*" * o.prefix for o in alt.operands(expression)] == expected


def test_trace_of_searches(spark, tmp_path):
    trace = capture.Trace(tmp_path / "trace.jsonl")
    trace.requested("s", "c1", {"q": 1})
    trace.inside("s", "c2/0", "c2")
    asked = {"q": 1}
    first, second, third = trace.begin("s", "c1", asked), trace.begin("s", "c2/0", {"q": 2}), trace.begin("t", "c1", {"q": 3})
    asked["q"] = 9  # what was asked stays as it was
    assert trace.begin("s", "bad", {"q": {1}}) is None
    trace.complete(first, {"rows": []})
    trace.fail(second, ValueError("no"))
    trace.complete(None, 1)
    assert trace.flush() == 2 and trace.pending == [third]
    rows = [json.loads(line) for line in (tmp_path / "trace.jsonl").read_text().splitlines()]
    assert [(r["call_index"], r["parent_id"], r["identical"], r["error"]) for r in rows] == [(1, None, True, None), (2, "c2", None, "no")]
    assert (tmp_path / "trace.jsonl").stat().st_mode & 0o777 == 0o600
    trace.complete(third, "x")
    found = trace.table(spark).collect()
    assert [(r["session_id"], r["call_index"], r["result"]) for r in found] == [("t", 1, '"x"')]
    assert trace.begin("s", "c9", 1).call_index == 4  # the dropped one took a number
    assert min(capture.memory(spark).values()) > 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_records_of_an_array(tmp_path, chunk):
    rows = [{"a": "]é,\"", "b": [1, 2.5, None]}, 123456, "x", [], True]
    path = tmp_path / "a.json"
    path.write_text(" " + json.dumps(rows, indent=1) + "\n")
    assert list(arrays.records(path, chunk)) == rows
    assert arrays.to_lines(path, tmp_path / "a.jsonl", chunk) == 5
    path.write_text("[]")
    assert list(arrays.records(path, chunk)) == []
    for bad in ("{}", "[1 2]", "[1", "[1] 2", ""):
        path.write_text(bad)
        with pytest.raises(ValueError):
            list(arrays.records(path, chunk))


def test_hash_of_objects():
    assert canonical_hash({"b": 1.0, "a": [None, "é"]}) == canonical_hash({"a": [None, "é"], "b": 1}) != canonical_hash({"a": [], "b": 1})
