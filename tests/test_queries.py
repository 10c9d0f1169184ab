"""Validation and compilation of queries."""

from __future__ import annotations

import pytest

from strandline.plans.query import Phrase, QueryError, branches_of, compile_query, parse, plan, word_branches
from strandline.functions import text as tx
from strandline.operators.index import STEMS, TOKENS


@pytest.mark.parametrize(
    ("source", "code"),
    [
        ([], "INVALID_QUERY"),
        ({"query": "x"}, "UNKNOWN_FIELD"),
        ({"concepts": [["x"]], "match": "some"}, "INVALID_MODE"),
        ({"concepts": []}, "INVALID_ARRAY"),
        ({"concepts": [[]]}, "INVALID_ARRAY"),
        ({"concepts": [[1]]}, "INVALID_TEXT"),
        ({"concepts": [["a\x01"]]}, "INVALID_TEXT"),
        ({"concepts": [["\ud800"]]}, "INVALID_TEXT"),
        ({"concepts": [[" 　"]]}, "EMPTY_TEXT"),
        ({"concepts": [["x" * 257]]}, "LIMIT_EXCEEDED"),
        ({"concepts": [["y" * 250] + [f"{i}" * 250 for i in range(7)], ["z" * 250]]}, "LIMIT_EXCEEDED"),
        ({"concepts": [[str(i) for i in range(9)]]}, "INVALID_ARRAY"),
        ({"concepts": [["x"]], "exclude": ["a", "b", "c", "d", "e", "f"]}, "INVALID_ARRAY"),
    ],
)
def test_invalid_queries(source, code):
    with pytest.raises(QueryError) as caught:
        parse(source)
    assert caught.value.code == code


def test_compiled_expressions():
    query = parse({"concepts": [["Rocky 8", "长江大桥"], ["10.0.0.1"]], "match": "all", "exclude": ["数据库"]})
    assert compile_query(query, lambda s: branches_of(tx.spans(s))).expression == (
        '((("rocky" OR "长江 江大 大桥") AND ("10" OR "10.0.0.1")) NOT "数据 据库")'
    )


def test_equal_parts_count_once():
    found = plan({"concepts": [["alpha", "Alpha", "alpha"], ["ALPHA"]]})
    assert found.expression == '"alpha"'
    assert len(found.groups) == 1


def test_too_many_atoms_of_a_surface_stay_an_error():
    with pytest.raises(QueryError) as caught:
        plan({"concepts": [[" ".join(f"word{i}x" for i in range(17))]]})
    assert caught.value.code == "INVALID_ARRAY"


def test_warnings_and_clamping():
    found = plan({"concepts": [["topic", "*"] + [f"a{i}" for i in range(7)], *([f"x{i}"] for i in range(1, 6))], "exclude": [f"q{i}" for i in range(1, 7)]})
    assert 'Warning: concepts has more than 5 items; ignored [["x5"]].' in found.warnings
    assert 'Warning: concepts[0] has more than 8 items; ignored ["a6"].' in found.warnings
    assert 'Warning: exclude has more than 5 items; ignored ["q6"].' in found.warnings
    assert any('["*"] produced no searchable terms and was ignored' in w for w in found.warnings)
    assert any(w.startswith('Warning: "7:30" → ["30"]') for w in plan({"concepts": [["7:30"]]}).warnings)
    with pytest.raises(QueryError) as caught:
        plan({"concepts": [["*"]]})
    assert caught.value.code == "EMPTY_ANALYSIS"


def test_words_of_automatic_queries():
    assert word_branches("booked") == [(Phrase("booked", (TOKENS,)),), (Phrase("book", (STEMS,)),)]
    assert word_branches("book") == [(Phrase("book", (TOKENS, STEMS)),)]
    assert word_branches("长江") == [(Phrase("长江", (TOKENS,)),)]
