"""Operator 3 against brute force, and components of graphs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from strandline.llm import components, simhash
from tests.llm.conftest import ODD


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near(fps, radius=4):
    return [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]


def group_of_copies(n, seed=2):
    """Texts of which many differ by a word or two, some are equal, and some stand alone."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(10**6)}" for _ in range(180)]
    out = []
    for i in range(n):
        words = list(base) if i % 4 else [f"u{pick.randrange(10**6)}" for _ in range(60)]
        for _ in range(i % 3):
            words[pick.randrange(len(words))] = f"e{pick.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_fingerprints():
    for text in [*ODD, "one two three", "One TWO three four", "a b c d e", "É É x\x0by", *group_of_copies(20)]:
        assert simhash.fingerprint(text or "") == slow_fingerprint(text)


@pytest.mark.parametrize("group", [simhash.GROUP, 6])
def test_components_are_those_of_all_pairs(docs_of, group):
    texts = [*ODD, *group_of_copies(160)]
    fps = [slow_fingerprint(t) for t in texts]
    expected = roots(len(texts), near(fps))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(texts), group=group).collect()}
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [rows[i]["component_id"] for i in range(len(texts))] == expected
    assert 5 < len(set(expected)) < len(texts)


@pytest.mark.parametrize("group", [simhash.GROUP, 5])
def test_dense_and_sparse_fingerprints(spark, group):
    """Balls of fingerprints, chains of four bits, and pairs at five bits that mustn't link."""
    pick = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = pick.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(5))))
        step = centre
        for _ in range(6):
            step ^= sum(1 << b for b in pick.sample(range(64), pick.choice([4, 5])))
            fps.add(step)
    fps = sorted(fps)
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    found = {r["doc_id"]: r["component_id"] for r in simhash.classes(rows, group=group).collect()}
    assert [found[i] for i in range(len(fps))] == roots(len(fps), near(fps))


def test_segments_cover_all_bits_and_find_all_pairs():
    for masks in simhash.SEGMENTS:
        assert sum(masks) == (1 << 64) - 1
    pick = random.Random(5)
    for _ in range(2000):
        flips = pick.sample(range(64), 4)
        for masks in simhash.SEGMENTS:
            assert min(sum(m >> b & 1 for b in flips) for m in masks) <= 1


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (5, text), (5, text), (5, "other words " * 9), (None, "alone " * 7), (None, "alone " * 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(table).collect()), key=str)
    assert found == [(5, 5), (5, 5), (5, 5), (None, 5), (None, None), (None, None)]
    kept = sorted(((r["doc_id"], r["text"][:5]) for r in simhash.one_of_each(table).collect()), key=str)
    assert kept == [(5, "other"), (5, "w0 w1"), (None, "alone")]


def test_one_of_each_keeps_columns(docs_of):
    texts = group_of_copies(80)
    table = docs_of(texts)
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots(80, near([slow_fingerprint(t) for t in texts]))))
    assert simhash.one_of_each(docs_of([])).collect() == []
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_components_of_graphs(spark):
    pick = random.Random(6)
    shapes = {
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(0, i) for i in range(1, 400)],
        "random": [(pick.randrange(150), pick.randrange(150)) for _ in range(100)],
        "none": [(3, 3)],
    }
    for edges, few in [(e, few) for e in shapes.values() for few in (0, components.FEW_EDGES)]:
        rows = components.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()
        n = max(max(e) for e in edges) + 1
        expected = roots(n, edges)
        touched = {x for a, b in edges if a != b for x in (a, b)}
        assert {r["node"]: r["root"] for r in rows} == {x: expected[x] for x in touched}
        assert len(rows) == len(touched)


def test_hot_keys_join_whole(spark):
    from strandline.llm.common import join_counted

    left = spark.createDataFrame([(0, i) for i in range(900)] + [(i, 0) for i in range(1, 40)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(0, "hot", 900), *((i, f"c{i}", 1) for i in range(1, 30))], "k long, name string, n long")
    rows = join_counted(left, right, "k", "n", 940, "left").collect()
    assert len(rows) == 940 and sum(r["name"] == "hot" for r in rows) == 900 and sum(r["name"] is None for r in rows) == 11
    assert len(join_counted(left, right, "k", "n", 940).collect()) == 929


def test_trees_span_what_is_linked():
    pick = np.random.default_rng(7)
    fps = pick.integers(0, 1 << 12, 60).astype(np.uint64)
    flags = pick.integers(0, 2, 60).astype(np.int32)
    a, b = simhash.trees(fps, flags, 2)
    assert len(a) < 60
    index = {int(f): i for i, f in enumerate(fps)}
    allowed = [(i, j) for i in range(60) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 2 and not flags[i] & flags[j]]
    merge = lambda edges: roots(60, [*edges, *((i, index[int(f)]) for i, f in enumerate(fps))])
    assert merge([(index[int(x)], index[int(y)]) for x, y in zip(a, b, strict=True)]) == merge(allowed)
