"""The pipeline's near-duplicate stage against sets of five words, all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandline.llm import simhash, similar
from tests.llm.conftest import ODD
from tests.llm.test_near_duplicates import roots


def slow_runs(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def linked(texts, least=0.8):
    sets = [slow_runs(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= least - 1e-9]


def family(n, seed=3, size=150, most=5):
    """A text, and copies with up to ``most`` words changed; every third copy is without its last words."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(10**6)}" for _ in range(size)]
    out = [" ".join(base)]
    for i in range(n - 1):
        words = base[: size - 2 * (i % 7)] if i % 3 == 0 else list(base)
        for _ in range(pick.randrange(most + 1)):
            words[pick.randrange(len(words))] = f"e{pick.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_stage_finds_pairs_beyond_four_bits(spark, docs_of):
    """Of each family a text and one copy that is similar enough but over four bits away: only the first stays."""
    texts = []
    for seed in range(400):
        a, b = family(2, seed, 120, 3)
        far = (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 4
        if far and similarity(slow_runs(a), slow_runs(b)) >= 0.8:
            texts += [a, b]
    assert len(texts) > 40
    kept = corpus_pipeline.near_duplicates(spark, docs_of(texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, len(texts), 2))


@pytest.mark.parametrize(("group", "group_runs"), [(similar.GROUP, similar.GROUP_RUNS), (10, 1 << 40), (1 << 40, 3_000)])
def test_kept_rows_are_those_of_all_pairs(docs_of, group, group_runs):
    texts = [*ODD, *family(50), *family(30, 5, 40, 2), *(" ".join(f"s{i}" for i in range(n)) for n in range(1, 14)), *family(40, 9, 150, 12)]
    table = docs_of(texts)
    kept = similar.one_of_each(table, group=group, group_runs=group_runs)
    assert kept.columns == table.columns
    expected = sorted(set(roots(len(texts), linked(texts))))
    assert sorted(r["doc_id"] for r in kept.collect()) == expected
    assert 20 < len(expected) < len(texts) - 60
    assert similar.one_of_each(docs_of([])).collect() == []


def test_null_ids_and_repeated_rows_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text + " more"), (5, text + " more"), (7, "other words " * 9), (None, "alone " * 7), (None, "alone " * 7), (None, None)]
    kept = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in kept), key=str) == [(5, "w0 w1"), (7, "other"), (None, ""), (None, "alone")]


def test_segments_meet_at_the_similarity():
    """Pairs at a similarity of 0.8 to 0.82 share a segment, nearly all of them, and texts that share little seldom do."""
    pick = np.random.default_rng(1)
    shared = similar_but_far = 0
    for _ in range(2_000):
        both, own, other, rest = (pick.integers(0, 1 << 63, n, dtype=np.uint64) for n in (400, 50, 50, 400))
        a, b, c = np.unique(np.r_[both, own]), np.unique(np.r_[both, other]), np.unique(np.r_[both[:40], rest])
        meet = lambda x, y: any(i == j for i, j in zip(similar.segments(x), similar.segments(y), strict=True))
        shared += meet(a, b)
        similar_but_far += meet(a, c)
    assert shared >= 1_995 and similar_but_far < 60
    assert similar.segments(np.arange(3, dtype=np.uint64)) == []


def test_linked_groups_give_few_edges_and_exclude_none():
    """In one group: a family, a chain whose neighbours only are similar, and texts like none; known links give no edge."""
    base = np.arange(100, dtype=np.uint32)
    sets = [np.r_[base[: 100 - i % 3], np.uint32(1_000 + i)] for i in range(40)]
    sets += [np.arange(9 * i, 9 * i + 90, dtype=np.uint32) + np.uint32(10_000) for i in range(30)]
    sets += [np.arange(5_000 + 200 * i, 5_090 + 200 * i, dtype=np.uint32) for i in range(10)]
    sets = [np.unique(x) for x in sets]
    nodes, fps = np.arange(len(sets)), np.zeros(len(sets), np.uint64)
    expected = roots(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8])
    left, right = similar.links(nodes, nodes, fps, sets)
    assert len(left) == len(sets) - len(set(expected))
    assert roots(len(sets), zip(left, right, strict=True)) == expected
    assert similar.links(nodes, np.array(expected), fps, sets) == ([], [])


def test_copies_are_no_hot_task(spark):
    """Of three rows one is the same text and one a near copy of it; both shuffle by what they share."""
    words = " ".join(f"w{i}" for i in range(60))
    table = spark.range(6_000).selectExpr("id AS doc_id", f"CASE id % 3 WHEN 0 THEN '{words}' WHEN 1 THEN concat('{words} and ', id) ELSE concat_ws(' ', transform(sequence(1, 30), x -> concat('u', id, x))) END AS text")
    kept = {r["doc_id"] for r in similar.one_of_each(table, group=500).collect()}
    assert kept == {0, *range(2, 6_000, 3)}


def test_segments_are_those_of_the_whole_fingerprint():
    """Multi-index hashing cuts one SimHash fingerprint over all runs; a pair goes on from the first segment that it shares."""
    found = np.random.default_rng(5).integers(0, 1 << 63, 300, dtype=np.uint64)
    words = similar.fingerprint(found)
    assert len(words) == similar.WORDS_OF and len(similar.segments(found)) == similar.WORDS_OF * similar.SEGMENTS_OF
    assert similar.segments(found)[:5] == [*(int(words[0]) >> 14 * i & 0x3FFF for i in range(4)), int(words[1]) & 0x3FFF]
    votes = similar._hashes(found, similar.WORDS_OF)[:, 3]
    assert [int(words[3]) >> b & 1 for b in range(64)] == [int(2 * sum(int(v) >> b & 1 for v in votes) > 300) for b in range(64)]
    low = np.array([(1 << 14) - 1 << 14], np.uint64)  # equal in segments 0, 2 and 3 of the first word
    full = np.array([(1 << 56) - 1], np.uint64)
    assert [bool(similar._met_before(x, full, np.array([n]))[0]) for x, n in ((low, 0), (low, 1), (full, 7), (full, 90))] == [False, True, False, False]


def test_parities_leave_out_no_similar_pair():
    """Sets of all sizes at the least similarity, or a little above: their parities never differ in too many bits."""
    pick = np.random.default_rng(7)
    for own in [*range(1, 40), 60, 100, 400]:
        for both in (8 * own, 8 * own + 1, 9 * own):
            shared, a, b = (pick.integers(0, 1 << 63, n, dtype=np.uint64) for n in (both, own, own))
            sets = [np.unique(np.r_[shared, a]), np.unique(np.r_[shared, b]), shared, np.unique(np.r_[shared, a, b])]
            for x, y in ((0, 1), (2, 3)):
                x, y = sets[x], sets[y]
                assert similarity(set(x.tolist()), set(y.tolist())) >= 0.8
                columns = {c: np.zeros(2, np.int64) for c in ("k", "fp", "more")} | {"root": np.arange(2), "size": np.array([len(x), len(y)])}
                odd = np.array([similar.parities(x), similar.parities(y)]).view(np.int64)
                table = pa.table(columns | {f"odd{i}": odd[:, i] for i in range(similar.ODD)})
                assert similar.candidates(table, 0.8, similar.RADIUS).all()


def test_texts_near_a_large_group_are_not_searched_again(docs_of, monkeypatch):
    """Texts at 0.5 to 0.7 from a large group meet its members in many segments; few go on, and no link is lost."""
    pick, rows = random.Random(11), []
    group = family(150, 3, 150, 2)
    near = []
    for i in range(150):
        words = group[0].split()
        for at in pick.sample(range(0, 150, 6), 8):
            words[at] = f"n{i}x{at}"
        near.append(" ".join(words))
    real = similar.written
    monkeypatch.setattr(similar, "written", lambda df, name: (out := real(df, name), rows.append(out.count()) if name == "meeting" else None)[0])
    texts = group + near
    kept = similar.one_of_each(docs_of(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots(len(texts), linked(texts))))
    assert 0 < sum(rows) < 3_000


def test_blocks_of_a_linked_group_are_not_all_paired(docs_of, monkeypatch):
    """A group of near copies beyond what a task compares is linked through one block of it, and its rows aren't dealt to all pairs."""
    rows = []
    texts = [*family(400, 3, 150, 2), *family(6, 4)]
    real = similar.written
    monkeypatch.setattr(similar, "written", lambda df, name: (out := real(df, name), rows.append(out.where("NOT large").count()) if name == "meeting" else None)[0])
    kept = similar.one_of_each(docs_of(texts), group=40)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots(len(texts), linked(texts))))
    assert 400 < sum(rows) < 2_000
