"""Operators 1, 4, 7, 9 and 10 against brute force and held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.llm import decontam, langid, licenses, toxicity, urls
from tests.llm.conftest import ODD

BIG = Path("/root/testdata/sf0.1")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# ---------------------------------------------------------------- licences

LICENSED = [
    "Released under the MIT License.", "under THE mit\nlicense; under-the mit license", "Apache License, Version 2.0", "apache license version 3", "CC BY-NC 4.0 and cc by nc",
    "licensed under the GNU General Public License, version 3", "under the m\u0130t license", "mit license under the", "ccc by nc", "\u212aapache license version 2",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "x " * 3000 + "under the mit license " * 50,
    "under the mit license " * 4_000, "ma\u212ae the mit", "\u212bpache license version 2", "UNDER THE MIT LICENSE\u212a",
]


def test_license_places_are_all_found(docs_of):
    texts = [*ODD, *LICENSED, *(["plain words only here"] * 30)]
    rows = {r["doc_id"]: r for r in licenses.summary(docs_of(texts)).collect()}
    for i, text in enumerate(texts):
        own = words(text)
        places = [(label, at) for label, phrase in licenses.BASE for at in range(len(own)) if own[at : at + len(phrase.split())] == phrase.split()]
        starts = [at for _, at in places]
        row = rows[i]
        assert (row["n_words"], row["n_base"]) == (len(own), len(places)), text
        assert (row["first_word"], row["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert row["base_labels"] == ",".join(sorted({label for label, _ in places}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1 and (row["score"] == 1) == bool(row["labels"]), text
    assert rows[len(ODD) + 5]["labels"] == "gpl-3"
    assert rows[len(ODD) + 10]["labels"] == "mit"
    assert licenses.summary(docs_of([])).collect() == []
    plan = licenses.summary(docs_of(texts))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def changed(sentence, pick, n):
    """A template's sentence with n words outside its key phrase replaced."""
    before, _, rest = sentence.partition("[")
    inside, _, after = rest.partition("]")
    out = [*((w, False) for w in before.split()), *((w, True) for w in inside.split()), *((w, False) for w in after.split())]
    free = [i for i, (_, key) in enumerate(out) if not key]
    for i in pick.sample(free, min(n, len(free))):
        out[i] = ("zzz", False)
    return " ".join(w for w, _ in out)


def test_licence_texts_may_have_changed_words(docs_of):
    pick = random.Random(2)
    texts, expected = [], []
    for label, sentences in licenses.TEXTS.items():
        texts.append(f"Some words first. {'. '.join(changed(s, pick, 0) for s in sentences)}.")
        expected.append({label})
        # One word changed in every sentence: of three rare words two still agree.
        texts.append(f"Other words; {'; '.join(changed(s, pick, 1) for s in sentences)}")
        expected.append({label})
        texts.append(sentences[0].replace("[", "").replace("]", "").split("permitted")[0] + " alone")  # too few of its sentences
        expected.append(set() if label != "mit" else {"mit"})
        key = sentences[0].partition("[")[2].partition("]")[0] or sentences[0]
        texts.append(" and ".join(s.replace("[", "").replace("]", "").replace(key.split()[1], "qqq") for s in sentences[:2]))
        expected.append(set())
    texts += ["plain words only here"] * 40
    rows = {r["doc_id"]: r for r in licenses.scan(docs_of(texts)).collect()}
    for i, labels in enumerate(expected):
        assert labels <= set(rows[i]["labels"]) and (labels or rows[i]["score"] < 1), (texts[i], rows[i])


def test_licences_with_null_and_repeated_ids(spark):
    table = spark.createDataFrame([(None, "under the mit license"), (1, "cc by nc"), (1, "cc by nc"), (1, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["n_base"], r["labels"]) for r in licenses.summary(table).collect()), key=str)
    assert found == [(1, 0, ""), (1, 1, "cc-by-nc"), (1, 1, "cc-by-nc"), (None, 1, "mit")]


# ---------------------------------------------------------------- languages

SYLLABLES = {"aa": ["ba", "ku", "ri"], "bb": ["schö", "tz", "ung"], "cc": ["çã", "nho", "eir"]}


def invented(language, pick, n=40):
    return " ".join("".join(pick.choice(SYLLABLES[language]) for _ in range(pick.randrange(1, 4))) for _ in range(n))


def test_languages_are_learned(docs_of):
    pick = random.Random(8)
    names = [pick.choice(list(SYLLABLES)) for _ in range(300)]
    texts, langs = [invented(x, pick) for x in names], list(names)
    texts += ODD
    langs += [None] * len(ODD)
    rows = {r["doc_id"]: r for r in langid.predictions(docs_of(texts, langs)).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i]["lang_pred"] == names[i] for i in range(300))
    for i, text in enumerate(texts):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= rows[i]["score"] <= 1
        assert (rows[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))


def test_languages_need_no_ids_and_no_labels(spark, docs_of):
    nothing = langid.predictions(docs_of(["some text", None], [None, None])).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.predictions(docs_of([])).collect() == []
    model = langid.fit([("ba ku ri", "aa"), ("schö tz", "bb")], 2)
    assert model.predict(["ku ba", "tz", "", "12"])[0] == ["aa", "bb", "und", "und"]
    kept = langid.known_language(docs_of(["ba ku", "12 !", None, "tz"]), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def grams_of(text):
    """The n-grams of a lower-case text as strings."""
    line = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    return {line[i : i + n] for n in range(1, langid.ORDERS + 1) for i in range(len(line) - n + 1)}


def slow_kernel(text, mark):
    return len(grams_of(text) & grams_of(mark)) / (len(grams_of(text)) * len(grams_of(mark))) ** 0.5


def test_kernel_is_that_of_shared_ngrams(monkeypatch):
    marks = ["abc ab", "bca c"]
    texts = ["abc", "cab b", "zzz", "abc, \u6f22\u5b57 bca " * 9]
    for piece in (langid.PIECE, 7):
        monkeypatch.setattr(langid, "PIECE", piece)  # texts longer than a piece are cut, and no n-gram is lost
        for row, text in zip(langid.Kernel(marks).kernel(texts), texts, strict=True):
            assert row.tolist() == pytest.approx([slow_kernel(text, m) for m in marks], abs=1e-6)


def test_predictions_are_those_of_a_ridge_over_sets_of_ngrams():
    """The whole classifier worked out from Python sets, for three scripts; the sparse product has to give the same values."""
    import numpy as np

    pick = random.Random(4)
    alphabets = {"cy": "абвгдежз", "ha": "漢字文語本日人大", "la": "abcdefgh"}
    line = lambda x: " ".join("".join(pick.choice(alphabets[x]) for _ in range(pick.randrange(1, 5))) for _ in range(12))
    names = [x for x in alphabets for _ in range(25)]
    texts = [line(x) for x in names]
    marks = texts[::5]
    model = langid.Kernel(marks).fit(texts, names, marks)
    square = np.array([[slow_kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(square)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    features = np.array([[slow_kernel(t, m) for m in marks] for t in texts]) @ root
    target = np.array([[1.0 if x == y else -1.0 for y in sorted(alphabets)] for x in names])
    mean = target.mean(0)
    weights = np.linalg.solve(features.T @ features + langid.RIDGE * len(texts) * np.eye(features.shape[1]), features.T @ (target - mean))
    new = [*(line(x) for x in alphabets for _ in range(10)), "abc 漢字", "zzz", "Ω" * 40]
    expected = np.array([[slow_kernel(t, m) for m in marks] for t in new]) @ root @ weights + mean
    found, known = model.values(new)
    assert np.abs(found - expected).max() < 1e-4
    every = set().union(*map(grams_of, marks))
    assert known.tolist() == pytest.approx([len(grams_of(t) & every) / len(grams_of(t)) for t in new])
    assert model.predict(new[:30])[0] == [x for x in alphabets for _ in range(10)]


def test_texts_of_no_learned_language_are_rejected(docs_of):
    pick = random.Random(5)
    names = [pick.choice(list(SYLLABLES)) for _ in range(400)]
    model = langid.fit([(invented(x, pick, pick.randrange(1, 40)), x) for x in names], 60)
    clean = [invented(x, pick, n) for x in SYLLABLES for n in (1, 2, 5, 50, 500)]
    strange = ["漢字かな交じり文です", "Привет, как дела", "qwx vfpl wqx", "Ω" * 500, "你好 " * 200]
    kept = langid.known_language(docs_of([*clean, *strange, "12 !", None]), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(clean)))
    # Without its limit the model would keep them, as a letter alone does.
    assert langid.known_language(docs_of(strange), model, 0.0).count() == len(strange)


@pytest.mark.skipif(not BIG.exists(), reason="needs the test tables")
def test_languages_of_held_out_rows(spark):
    """The figures of the README, on rows that nothing was learned from; and the stage keeps all of them."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    model = langid.train(docs)
    rows = langid.languages(docs.where(langid.held_out()), model).join(docs.where("lang IS NOT NULL"), "doc_id").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.995 * len(rows) > 3_000
    assert sum(r["score"] < model.least for r in rows if r["lang_pred"] != "und") == 0


def test_hot_ids_and_texts_neither_fill_nor_starve_the_sample(spark):
    pick = random.Random(6)
    texts = [(invented(x, pick, 10), x) for x in SYLLABLES for _ in range(300)]
    for hot in (["same text in all these rows"] * 3_000, [f"other text {i} of one id" for i in range(3_000)]):
        rows = [(100 if i % 3 else 101, t, "aa") for i, t in enumerate(hot)] + [(3 * i, t, g) for i, (t, g) in enumerate(texts)]
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        found = langid.sample(table, 90, 10**6, "doc_id", "text", "lang")
        assert len(found) <= 90 + len(SYLLABLES) and len(set(found)) == len(found)
        assert all(sum(g == x for _, g in found) >= 20 for x in SYLLABLES)


def test_languages_of_other_scripts_are_told_apart():
    """Languages with words of the same lengths, of which only the letters beyond U+2000 differ."""
    pick = random.Random(12)
    alphabets = {"h1": range(0x4E00, 0x4E60), "h2": range(0x5200, 0x5260), "ja": range(0x3041, 0x3090), "ko": range(0xAC00, 0xAC60)}

    def line(language, words):
        return " ".join("".join(chr(pick.choice(alphabets[language])) for _ in range(3)) for _ in range(words))

    model = langid.fit([(line(x, 60), x) for x in alphabets for _ in range(30)], 40)
    names = [x for x in alphabets for _ in range(20)]
    assert model.predict([line(x, 30) for x in names])[0] == names


def test_signs_beyond_latin_are_blanks():
    kernel = langid.Kernel(["ab cd", "bc \u6f22\u5b57"])
    assert kernel.kernel(["\u201cab\u201d\u2013cd"])[0].tolist() == kernel.kernel(['"ab"-cd'])[0].tolist()
    assert kernel.kernel(["\u6f22\u5b57"])[0][1] > kernel.kernel(["\u6587\u66f8"])[0][1]


# ---------------------------------------------------------------- decontamination


def slow_hits(text, items, size=10):
    own, hit, found = words(text), set(), set()
    for item, line in items:
        theirs = words(line)
        windows = [theirs] if 0 < len(theirs) <= size else [theirs[i : i + size] for i in range(len(theirs) - size + 1)] if theirs else []
        for window in windows:
            for at in range(len(own) - len(window) + 1):
                if own[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    return len(own), len(hit), ",".join(sorted(found)), len(found)


@pytest.mark.parametrize(("small", "salted"), [(decontam.SMALL_BYTES, decontam.SALTED), (0, decontam.SALTED), (0, 3)])
def test_contamination_is_that_of_all_windows(spark, docs_of, monkeypatch, small, salted):
    monkeypatch.setattr(decontam, "PART_WORDS", 8)  # items are longer than a part
    pick = random.Random(9)
    line = lambda n: " ".join(pick.choice(["the", "a", "of", f"w{pick.randrange(40)}"]) for _ in range(n))
    items = [(1, line(30)), (2, line(10)), (10, "just three words"), (11, None), (12, "..."), (13, "the the the the the the the the the the the"), (14, line(12))]
    items.append((15, items[0][1]))
    texts = [*ODD, *(line(80) for _ in range(20))]
    for _, passage in items:
        for low, high in ((0, 30), (5, 15), (0, 9)):
            part = " ".join((passage or "").split()[low:high])
            texts.append(f"{line(6)} {part.upper()}, {line(5)} -- {part} {part}")
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.digests(docs_of(texts), table, small_bytes=small, salted=salted).collect()}
    for i, text in enumerate(texts):
        n, hit, ids, count = slow_hits(text, items)
        row = rows[i]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (n, hit, count, hit > 0), text
        assert row["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    clean = decontam.clean(docs_of(texts), table, small_bytes=small, salted=salted)
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i in range(len(texts)) if not rows[i]["contaminated"]]


def test_empty_sides(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontam.digests(docs_of(["a b", None]), none).collect()} == {0}
    assert decontam.digests(docs_of([]), none).collect() == []
    assert decontam.clean(docs_of(["a b", None]), none).count() == 2


# ---------------------------------------------------------------- toxicity


def test_folding_and_exceptions():
    own = toxicity.Lexicon({" idiot": 6.0, " clown ": 5.0})
    bad = ("you IDIOT", "1d10t", "іdіоt!", "ＩＤＩＯＴ", "an id\u0456ot, yes", "idiotic", "idi\u200bot", "ídiot", "îdíöt", "i-d-i-o-t", "I.D.I.O.T!", "1d!ot", "i\u0301diot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d")
    for text in bad:
        assert own.score(text) > 0.5, text
    for text in ("", "a clown fish", "room 101 107", "clowning", "videoidiot", "plain", "i d i o t", "i-d.i-o.t", "an idi-ot", "1-0-1-0-7", "\x00", "a-b-c-d"):
        assert own.score(text) < 0.5, text
    assert own.matches("the idiots, one clown.") == [(4, 9, 6.0), (16, 21, 5.0)]
    for text, word in (("so i-d-i-o-t it is", "i-d-i-o-t"), ("so idi\u200b\u200bots it", "idi\u200b\u200bot"), ("e\u0301 ídiot", "ídiot")):
        assert [text[a:b] for a, b, _ in own.matches(text)] == [word]
    assert own.score("idiot " + "word " * 50) > own.score("idiot " + "word " * 20_000)


def slow_matches(text, weights):
    """Every word of the folded text against every entry, one by one; for texts in which nothing is dropped."""
    folded = toxicity.fold(text)
    found, voided = [], []
    for phrase in toxicity.EXCEPTIONS:
        at = f" {folded} ".find(f" {phrase} ")
        while at >= 0:
            voided.append((at, at + len(phrase)))
            at = f" {folded} ".find(f" {phrase} ", at + 1)
    for word in re.finditer(r"[^ ]+", folded):
        best = None
        for entry, weight in weights.items():
            own = entry.strip()
            if (word.group() == own if entry.endswith(" ") else word.group().startswith(own)) and (best is None or weight > best[1]):
                best = (word.start() + len(own), weight)
        if best and 3 * sum(c.isalpha() for c in text[word.start() : word.end()]) >= len(word.group()):
            if not any(a <= word.start() and best[0] <= b for a, b in voided):
                found.append((word.start(), best[0], best[1]))
    return found


def test_matches_are_those_of_a_naive_matcher():
    pick = random.Random(21)
    weights = {" trash": 4.0, " clown ": 3.0, " clowns ": 3.5, " sc": 1.0, " scum": 5.0, " scu ": 2.0, " pathetic ": 2.5, " stup1d": 9.0, " stupid": 2.0, " id": 0.5, " idiot": 6.0}
    lexicon = toxicity.Lexicon(weights)
    pieces = ["trash", "TRASH can", "trash cans", "trashy", "clown", "clown fish", "class clown", "clowns", "sc", "scum", "pond scum", "scumbag", "ѕсum", "pathetic", "pathetic fallacy", "5tup1d", "stupid question",
              "1d", "101d", "id1ot", "x", ",", "ＣＬＯＷＮ", "...", "the", "9\n", "idea"]
    for _ in range(400):
        text = "".join(pick.choice(pieces) + pick.choice([" ", " ", " ", ", ", ""]) for _ in range(12))
        if len(toxicity.fold(text)) == len(text):
            assert lexicon.matches(text) == slow_matches(text, weights), text


def test_toxicity_is_learned(spark, docs_of):
    pick = random.Random(10)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ko", "pel", "dri", "gut")]
    texts, toxic = [], []
    for _ in range(500):
        own = [pick.choice(plain) + pick.choice(plain) for _ in range(30)]
        bad = pick.random() < 0.2
        if bad:
            for at in pick.sample(range(30), 3):
                own[at] = "zwurk" + pick.choice(plain)
        texts.append(" ".join(own))
        toxic.append(int(bad))
    table = docs_of([*texts, *ODD])
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(toxic)] + [(3, None), (10**9, 1), (None, 1)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.predictions(table, labels).collect()}
    assert len(rows) == len(texts) + len(ODD)
    assert all(rows[i]["predicted"] == y for i, y in enumerate(toxic))
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows.values())
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(500))
    lexicon = toxicity.train(table, labels)
    # The executors learn what one process does from the same rows in the same order.
    sample = toxicity.sample(table, labels, "doc_id", "text", "toxic", toxicity.SAMPLE_ROWS, toxicity.SAMPLE_CHARS).orderBy("place").collect()
    assert {r["t"] for r in sample} == {texts[i] for i in range(500) if zlib.crc32(str(i).encode()) % 5}
    alone = toxicity.fit([(r["t"], r["y"]) for r in sample])
    assert alone.weights == lexicon.weights and alone.parameters == pytest.approx(lexicon.parameters)
    kept = toxicity.not_toxic(table, lexicon)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(rows)) if not rows[i]["predicted"]]


def test_toxicity_without_labels(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = {r["doc_id"]: r["predicted"] for r in toxicity.predictions(docs_of(["you stupid idiot", "nice words", None]), labels).collect()}
    assert rows == {0: 1, 1: 0, 2: 0}
    assert toxicity.predictions(docs_of([]), labels).collect() == []


def test_copies_teach_once():
    text = " ".join(f"odd{i}" for i in range(60))
    rows = [(text + f" {i}", 1) for i in range(30)] + [(f"clean words number {i} and more of them {i * 7}", 0) for i in range(200)]
    halves = toxicity.halves_of((i, y, toxicity.signature(x)) for i, (x, y) in enumerate(rows))
    assert sum(label for label, _ in halves.values()) == 1
    assert toxicity.Lexicon(toxicity.fit(rows).weights).score(" ".join(f"odd{i}" for i in range(5))) < 0.5


def test_the_sample_for_toxicity_keeps_its_bounds(spark):
    """One id in most rows, with different texts: rows and characters stay within what was asked for."""
    rows = [(1, f"text number {i} of a hot id") for i in range(3_000)] + [(i, f"other text {i}") for i in range(2, 400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400)], "doc_id long, toxic int")
    found = toxicity.sample(table, labels, "doc_id", "text", "toxic", 50, 600).collect()
    assert 0 < len(found) <= 50 and sum(len(r["t"]) for r in found) <= 600
    assert toxicity.sample(table, labels, "doc_id", "text", "toxic", 50, 3) is None


@pytest.mark.skipif(not BIG.exists(), reason="needs the test tables")
def test_toxicity_of_held_out_rows(spark):
    """The figures of the README: toxic rows found and clean rows flagged, on rows that nothing was learned from."""
    docs, labels = (spark.read.parquet(f"{BIG}/{name}.parquet") for name in ("documents", "labels"))
    rows = toxicity.predictions(docs, labels).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    count = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    toxic, clean = (sum(n for (label, _), n in count.items() if label == y) for y in (1, 0))
    assert count[1, 1] >= 0.9 * toxic and count.get((0, 1), 0) <= 0.01 * clean, count


# ---------------------------------------------------------------- URLs

ADDRESSES = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://a.NET/x?y#z", "https://a.net?x", "https://m.example.net/en/1", "https://example.net/en", "http://example.net/EN/",
    "http://example.com/de/", "http://www.example.com/de/x", "http://notexample.com/de/", "http://x.org/fr/", "http://org/fr/a", "http://x.org/fr", "ftp://u@h.net:80/p", "a://b://c.net/", "http://a.net./",
    "http://" + "a." * 3000 + "net/" + "p/" * 3000, "http://x.org\n/fr/", "https://É.net/",
]


def slow_judgement(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else urls.DEFAULT


MORE = (*urls.RULES, ("example.net", "/en/1", "block"), ("b.example.net", "", "block"), ("com", "/d", "block"), ("com", "/d", "allow"))


@pytest.mark.parametrize(("rules", "broadcast"), [(urls.RULES, 100_000), (MORE, 100_000), (MORE, 0), ((), 100_000)])
def test_urls_are_judged_by_the_longest_rule(spark, rules, broadcast):
    many = [*ADDRESSES, *(["http://hot.net/en/same"] * 400), *(f"http://{h}.example.{t}/{p}/{i}" for i, (h, t, p) in enumerate((h, t, p) for h in ("a", "b") for t in ("com", "net", "org") for p in ("en", "de", "fr")))]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(many)], "page_id long, url string, html string").withColumns({n: F.lit("x") for n in ("u", "n", "rule", "host", "id")})
    found = urls.judged(pages, urls.rule_table(spark, rules), broadcast_rules=broadcast)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan
    rows = {r["page_id"]: tuple(r)[1:] for r in found.collect()}
    assert len(rows) == len(many)
    for i, url in enumerate(many):
        assert rows[i] == slow_judgement(url, rules), url
    assert urls.judged(pages.limit(0), urls.rule_table(spark, rules)).collect() == []


def test_hot_urls_are_no_hot_task(spark):
    """A third of the rows each: null, one URL that no rule fits, and others; no partition of the result's shuffle may hold a hot key."""
    rows = spark.range(60_000).selectExpr(
        "id AS page_id", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'http://free.example.xyz/same' ELSE concat('http://h', id, '.example.net/', id) END AS url"
    )
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = urls.judged(rows, urls.rule_table(spark))
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        verdicts = {(r["verdict"], r["rule"]): r["n"] for r in found.groupBy("verdict", "rule").agg(F.count("*").alias("n")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert verdicts == {("allow", None): 40_000, ("block", "net/"): 20_000}
    assert max(sizes) < 20_000 / 2
