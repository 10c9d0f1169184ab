"""Operator 8: prints, alignment, and search against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import audio


def tune(seed, notes=48):
    return audio.melody(np.random.default_rng(seed).normal(size=notes))


def slow_alignment(a, b):
    """The fullest offset of all, as the definition has it."""
    votes = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x == y:
                votes[i - j] = votes.get(i - j, 0) + 1
    votes = {k: v for k, v in votes.items() if v >= audio.VOTES}
    if not votes:
        return None
    shift = min(votes, key=lambda k: (-votes[k], k))
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high - low < audio.LEAST_OVERLAP:
        return None
    errors = sum(int(a[i] ^ b[i - shift]).bit_count() for i in range(low, high)) / (32 * (high - low))
    return (shift, votes[shift], round(errors, 6)) if errors <= audio.MOST_ERRORS else None


def test_integral_image_gives_sums_of_rectangles():
    rows = audio.chroma(tune(1).astype(float))
    assert rows.shape[1] == 12 and np.allclose(np.linalg.norm(rows, axis=1), 1)
    twice = np.concatenate([rows, rows], axis=1)
    image = np.zeros((len(rows) + 1, 25))
    image[1:, 1:] = twice.cumsum(0).cumsum(1)
    assert np.isclose(image[6, 15] - image[2, 15] - image[6, 10] + image[2, 10], twice[2:6, 10:15].sum())


def test_prints_don_t_mind_loudness_and_noise():
    own = tune(2)
    found = audio.prints(own)
    assert found.dtype == np.uint32 and len(found) > 30
    assert (audio.prints((own * 0.5).astype(np.int16)) == found).mean() > 0.9
    noisy = own + np.random.default_rng(0).normal(size=len(own)) * 60
    assert np.bitwise_count(audio.prints(noisy) ^ found).mean() < 3
    assert np.bitwise_count(audio.prints(tune(3)) ^ found).mean() > 6
    assert len(audio.prints(np.zeros(10))) == 0


def test_alignment_finds_the_offset():
    whole = tune(4, 80)
    clip = whole[20 * audio.HOP : 60 * audio.HOP]
    own, theirs = audio.prints(clip), audio.prints(whole)
    assert slow_alignment(own, theirs)[0] == -20
    assert audio.alignment(own, theirs, -20) < 0.05 and audio.alignment(own, theirs, 0) is None and audio.alignment(own, theirs, 10**6) is None


def rows_of(spark):
    """Recordings with copies, cuts, quieter ones, repeated ids, silence, nothing: rows (id, bytes)."""
    recordings = [tune(s) for s in range(25)]
    recordings += [recordings[0][8 * audio.HOP :], recordings[20], (recordings[20] * 0.7).astype(np.int16), recordings[3], np.zeros(8000, np.int16), np.zeros(8000, np.int16)]
    rows = [(i, r.astype("<i2").tobytes()) for i, r in enumerate(recordings)] + [(101, None), (101, b""), (102, b"abc"), (40, recordings[29].tobytes())]
    # Queries with the same id and sound, and one with that id and another sound.
    rows += [(60, tune(30).tobytes()), (60, tune(30).tobytes()), (60, tune(31).tobytes()), (61, tune(30).tobytes()), (None, tune(30).tobytes()), (80, tune(40, 3_000).tobytes())]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "rec_id long, audio binary, prints string").repartition(3)


def expected(rows):
    """For each row the alignments with the query rows but itself, by brute force, the best first."""
    own = [audio.prints(np.frombuffer((a or b"")[: len(a or b"") // 2 * 2], "<i2")) for _, a in rows]
    small = {i for i, x in enumerate(own) if len(x) < 1_000}
    out = []
    for i, mine in enumerate(own):
        hits = []
        for q, (name, _) in enumerate(rows):
            if q != i and name is not None and name % 20 == 0:
                same = len(mine) == len(own[q]) > 0 and (mine == own[q]).all()
                hit = slow_alignment(mine, own[q]) if {i, q} <= small or same else None
                if hit:
                    hits.append((name, *hit))
        out.append((len(mine), sorted(hits, key=lambda h: (-h[2], h[3], h[0]))))
    return out


@pytest.mark.parametrize(("block", "held"), [(audio.BLOCK, audio.HELD_BYTES), (2, 1_000)])
def test_search_is_that_of_all_pairs(spark, monkeypatch, block, held):
    monkeypatch.setattr(audio, "HELD_BYTES", held)
    rows, table = rows_of(spark)
    plain = [(name, n, hits[0] if hits else (None, None, None, None), len(hits)) for (name, _), (n, hits) in zip(rows, expected(rows), strict=True)]
    found = [(r["rec_id"], r["n_prints"], (r["match_id"], r["offset"], r["votes"], r["bit_errors"]), r["n_matches"]) for r in audio.matches(table, block=block).collect()]
    assert sorted(found, key=repr) == sorted(plain, key=repr)
    best = {r[0]: r[2][0] for r in found}
    assert best[25] == 0 and best[26] == 20 and best[29] == 40 and best[61] == 60
    assert sorted(r[3] for r in found if r[0] == 60) == [0, 1, 1]
    assert audio.matches(table.limit(0)).collect() == []


def test_alignments_list_every_query(spark):
    rows, table = rows_of(spark)
    prints = audio.recording_prints(table)
    found = [(r["rec_id"], r["n_prints"], [(m["match_id"], m["offset"], m["votes"], round(m["bit_errors"], 6)) for m in r["matches"]]) for r in audio.alignments(prints, F.col("rec_id") % 20 == 0).collect()]
    assert sorted(found, key=repr) == sorted(((name, n, hits) for (name, _), (n, hits) in zip(rows, expected(rows), strict=True)), key=repr)


def test_degraded_recordings_are_found(spark):
    """Of 60 queries three versions each: noise, a cut of two thirds, and sampled at another rate and back.  At least 0.9 of each kind is found."""
    pick = np.random.default_rng(9)
    rows, truth = [], {}
    for i in range(60):
        whole = tune(1_000 + i, 64)
        rows.append((20 * i, whole.astype("<i2").tobytes()))
        noisy = whole + pick.normal(size=len(whole)) * 0.05 * np.abs(whole).mean()
        cut = whole[len(whole) // 6 // audio.HOP * audio.HOP + audio.HOP // 2 : len(whole) * 5 // 6]
        at = np.arange(0, len(whole) - 1, 0.8)
        coarse = np.interp(np.arange(len(whole)), at, np.interp(at, np.arange(len(whole)), whole.astype(float)))
        for k, kind in enumerate((noisy, cut, coarse)):
            rows.append((10_001 + 20 * i + k, np.clip(kind, -32768, 32767).astype("<i2").tobytes()))
            truth[10_001 + 20 * i + k] = (k, 20 * i)
    found = {r["rec_id"]: r["match_id"] for r in audio.matches(spark.createDataFrame(rows, "rec_id long, audio binary")).collect()}
    right = [[found[r] == q for r, (kind, q) in truth.items() if kind == k] for k in range(3)]
    assert all(sum(x) >= 0.9 * len(x) for x in right), [sum(x) / len(x) for x in right]
    assert all(found[q] is None for q in range(0, 1_200, 20))


def test_copies_are_compared_once(spark):
    """A third of the rows is one recording, queries among it: its pairs don't grow with its rows."""
    one, other = tune(5).tobytes(), [tune(2_000 + i).tobytes() for i in range(40)]
    rows = [(i, one if i % 3 == 0 else other[i % 40]) for i in range(600)]
    prints = audio.recording_prints(spark.createDataFrame(rows, "rec_id long, audio binary"))
    _, classes, queries = audio._classes(prints, F.col("rec_id") % 20 == 0, "rec_id")
    assert classes.count() == 41 and audio.pairs(classes, queries).where("class = query").count() == queries.count()
    found = {r["rec_id"]: r for r in audio.search(prints, F.col("rec_id") % 20 == 0).collect()}
    hot = [i for i in range(0, 600, 20) if i % 3 == 0]
    assert all(found[i]["n_matches"] == len(hot) - (i in hot) and found[i]["match_id"] == (0 if i else hot[1]) for i in range(0, 600, 3))


def test_melodies(spark):
    table = spark.createDataFrame([(1, [0.1, 0.5, None]), (2, []), (3, None)], "vec_id long, embedding array<float>")
    sizes = {r["vec_id"]: r["n"] for r in audio.melodies(table).select("vec_id", F.length("audio").alias("n")).collect()}
    assert sizes == {1: 3 * 256 * 2, 2: 0, 3: 0}
