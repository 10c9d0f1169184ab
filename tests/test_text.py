"""Tokens, stems, snippets, JSON and patterns, without Spark."""

from __future__ import annotations

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.functions import canonical, snippets
from strandline.functions import text as tx
from strandline.functions.patterns import Pattern, simple
from strandline.functions.porter import stem


def test_runs_words_and_pairs():
    assert tx.terms("HTTPServerFooBar a_bc $x1") == ["http", "server", "foo", "bar", "bc", "x1"]
    assert tx.terms("7:30") == ["30"]
    assert tx.terms("长江大桥") == ["长江", "江大", "大桥"]
    assert tx.terms("长") == []
    assert tx.terms("东京に行く café") == ["东京", "京に", "に行", "行く", "café"]
    assert tx.spans("v 10.0.0.1") == [("10", 2, 4), ("10.0.0.1", 2, 10)]


def test_index_tokens_have_barriers_and_are_cut_at_signs():
    tokens, stems = tx.index_tokens("数据，据库 config_x.py booked")
    assert tokens == ["数据", tx.BARRIER, "据库", tx.BARRIER, "config", "py", "config", "x.py", "booked"]
    assert stems == ["config", "py", "book"]
    assert tx.atom_tokens("config_x.py") == ("config", "x.py")


@pytest.mark.parametrize(
    ("word", "expected"), [("plays", "plai"), ("relational", "relat"), ("attending", "attend"), ("agreed", "agre"), ("oed", "o"), ("id", "id"), ("was", "wa")]
)
def test_stems(word, expected):
    assert stem(word) == expected


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefgilmnostuy", min_size=1, max_size=12), st.sampled_from(["", "s", "ed", "ing", "ational", "fulness", "iviti", "ement", "ion", "ll", "e", "y", "eed", "ies"]))
def test_stems_as_the_database_has_them(base, end):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter ascii')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    db.execute("INSERT INTO t VALUES (?)", (base + end,))
    assert db.execute("SELECT term FROM v").fetchone()[0] == stem(base + end)


def test_weighted_length():
    assert tx.weighted_length("ab长江") == 6
    assert tx.weighted_length("カナ") == 2


def test_window_is_centred_and_keeps_the_budget():
    text = "😀" * 100 + "needle" + "😀" * 100
    begin, end = snippets.select_window(text, [("needle", 100, 106)], 12)
    assert "needle" in text[begin:end]
    assert end - begin == 12
    han = "甲" * 100 + "答案" + "乙" * 100
    begin, end = snippets.select_window(han, [("答案", 100, 102)], 12)
    assert "答案" in han[begin:end]
    assert 2 * (end - begin) <= 12


def test_window_takes_most_terms_and_the_first_of_the_best():
    text = "alpha " * 10 + "x " * 200 + "alpha beta"
    hits = [(t, a, b) for t, a, b in tx.spans(text) if t in ("alpha", "beta")]
    assert "beta" in text[slice(*snippets.select_window(text, hits, 60))]
    assert snippets.select_window("a" * 300, [], 100) == (0, 100)
    assert snippets.render("abcdef", (2, 4)) == "…cd…"


def test_sentences():
    assert snippets.sentence_starts('One. Two! "Three?" four。五\n\nsix') == [0, 5, 10, 19, 24, 27]
    assert snippets.sentence_starts("v1.2 no") == [0]


def test_canonical_json():
    assert canonical.canonical_json({"z": 1.0, "a": {"y": "é", "b": [None, True, float("inf")]}}) == '{"a":{"b":[null,true,"Infinity"],"y":"é"},"z":1}'
    cycle: dict = {"k": 1}
    cycle["self"] = cycle
    assert canonical.canonical_json(cycle) == '{"k":1,"self":"[Circular]"}'
    assert canonical.safe_json("<a>[b]` ") == '"\\u003ca\\u003e\\u005bb\\u005d\\u0060\\u2028"'
    with pytest.raises(canonical.DuplicateKey):
        canonical.strict_json('{"a":1,"a":2}')


def test_patterns_work_on_units():
    assert Pattern(".").count("😀😀") == 4
    assert [(m.start, m.end) for m in Pattern(".").matches("😀")] == [(0, 1), (0, 1)]
    assert Pattern("").count("😀") == 3
    assert Pattern("").count("ab") == 3
    assert Pattern("[literal").literal
    assert Pattern("[literal").count("and [LITERAL") == 1
    assert Pattern(r"\s").count("A B﻿") == 2
    assert Pattern(r"a$").count("a\n") == 0
    assert Pattern(r"(?<x>a)\k<x>").count("aab") == 1
    assert Pattern(r"[^\S\n]").count("a b\n") == 1
    assert simple("tion|The") and simple(r"a\.b") and not simple("a+") and not simple("é")
