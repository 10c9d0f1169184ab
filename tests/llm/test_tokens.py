"""Operators 2, 5 and 6 against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from strandline.llm import bpe, common, counts, sstable
from tests.llm.conftest import ODD

WORDS = ["The", "don't", "we'll", " 12.5", "\n\n", "naïve", "  ", "Größe", "漢字", "😀", "'s", "!?", "\u0558", "x" * 40, "İstanbul", "e\u0301", "\xa0", "\x85", "<|endoftext|>", "<|startoftext|>"]


def texts(n=300, seed=1):
    pick = random.Random(seed)
    mixed = ["".join(pick.choice(WORDS) + pick.choice(["", " ", "\t"]) for _ in range(pick.randrange(25))) for _ in range(n)]
    odd = ["".join(chr(pick.choice([pick.randrange(32, 127), pick.randrange(128, 256), pick.randrange(0x300, 0x2FFF)])) for _ in range(pick.randrange(30))) for _ in range(n)]
    return mixed + odd + [x or "" for x in ODD]


def test_written_out_patterns_and_newer_characters():
    import regex

    split = common.Splitter(public_tokenizers.PATTERN)
    plain = regex.compile(public_tokenizers.PATTERN).findall
    for text in texts():
        if not common.newer_search()(text):
            assert split(text) == plain(text)
        assert "".join(split(text)) == text
    assert common.newer_search()("a\u0558") and not common.newer_search()("漢é")


def test_memo_is_bounded_and_right():
    calls = []
    memo = common.Memo(lambda k: calls.append(k) or len(k), {"start": -1}, most=3, longest=5)
    assert [memo[k] for k in ("a", "bb", "ccc", "dddd", "a", "start", "toolong")] == [1, 2, 3, 4, 1, -1, 7]
    assert len(memo) <= 5 and "toolong" not in memo and calls.count("a") == 1


def test_byte_bpe_is_the_librarys():
    path = public_tokenizers.path(bpe.VOCABULARY)
    own = bpe.coder(path)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for text in texts():
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_serialised_model_and_tokens_without_merges():
    """A token to which no merges lead is still what a pre-token equal to it becomes."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.serialise(ranks))
    assert model.get_piece_size() == 259
    assert model.get_score(1 + 256) == -256.0
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import base64
    import tempfile

    with tempfile.NamedTemporaryFile("wb", suffix=".tiktoken") as file:
        file.writelines(base64.b64encode(t) + b" " + str(r).encode() + b"\n" for t, r in ranks.items())
        file.flush()
        own = bpe.ByteBpe(file.name)
    assert own.direct == {"xyz": 257}
    for text in ("xyz", "axyz", "ab abab", "xyz xyz"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_byte_bpe_over_tables(spark, docs_of):
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    rows = {r["doc_id"]: r for r in bpe.digests(docs_of(ODD)).collect()}
    for i, text in enumerate(ODD):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encoded(docs_of(ODD))
    decoded = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decoded(encoded).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.digests(docs_of([])).collect() == []


def test_counts_are_the_librarys(docs_of):
    library = Tokenizer.from_file(public_tokenizers.path(counts.VOCABULARY))
    own = counts.counter(public_tokenizers.path(counts.VOCABULARY))
    for text in texts():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    rows = {r["doc_id"]: r for r in counts.token_counts(docs_of(ODD)).collect()}
    for i, text in enumerate(ODD):
        expected = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (expected, len((text or "").encode()), expected > 1024)
    assert counts.token_counts(docs_of([])).collect() == []


def test_whole_tokens_are_proven():
    own = counts.counter(public_tokenizers.path(counts.VOCABULARY))
    whole = own.whole_tokens()
    assert len(whole) > 40_000 and " the" in whole and "\n\n" not in [x for x in whole if own.split(x) != [x]]
    assert all(own.memo[x] == 1 for x in whole[:2000])


def test_word_ids_are_the_librarys():
    library = Tokenizer.from_file(public_tokenizers.path(sstable.VOCABULARY))
    own = sstable.coder(public_tokenizers.path(sstable.VOCABULARY))
    for text in texts():
        assert np.frombuffer(own.encode(text), own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    many = [*texts(), *map(chr, range(256)), "a'S b'll'VE '#'s 12 don't", " ".join(f"{chr(i)}a{chr(i)}'re" for i in range(256)), "", "\t"]
    for text, ids in zip(many, own.encode_all(many), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.encode_all([]) == []


@pytest.mark.parametrize("shards", [None, 5])
def test_shards_hold_all_documents(spark, docs_of, shards):
    library = Tokenizer.from_file(public_tokenizers.path(sstable.VOCABULARY))
    pick = random.Random(3)
    many = [*ODD, *("".join(pick.choice(WORDS) for _ in range(5)) for _ in range(400))]
    rows = sorted(sstable.digests(docs_of(many), shards=shards).collect(), key=lambda r: r["doc_id"])
    start = 0
    for i, (row, text) in enumerate(zip(rows, many, strict=True)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, sstable.END_ID], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert sstable.digests(docs_of([])).collect() == []


def test_look_ups_and_repeated_ids(spark):
    table = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "n"), (-5, "m"), (9, None), *((i, f"text {i}") for i in range(100, 400))], "doc_id long, text string")
    manifest = sstable.write_shards(table, shards=3)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 305
    assert [len(x) for x in sstable.look_up(manifest, 7)] == [3, 3]
    assert sstable.look_up(manifest, 8) == []
    assert [x.tolist() for x in sstable.look_up(manifest, 9)] == [[sstable.END_ID]]
    assert len(sstable.look_up(manifest, None)) == 1
    read = sstable.read_shards(spark, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in read[:4]] == [None, -5, 7, 7]


def test_one_row_in_a_third_of_the_table_is_spread(spark):
    table = spark.range(9_000).selectExpr("CASE WHEN id % 3 = 0 THEN 77 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('text ', id) END AS text")
    sizes = [r["n_docs"] for r in sstable.write_shards(table, shards=12).collect()]
    assert sum(sizes) == 9_000 and max(sizes) < 2 * 9_000 / 12


def test_long_texts_make_more_shards(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 10_000)
    table = spark.range(40).selectExpr("id AS doc_id", "repeat('word ', 500) AS text")
    assert sstable.write_shards(table).count() >= 8
    assert sstable._uri("s3a://bucket/x") == "s3://bucket/x" and sstable._uri("file:/x") == "file:///x"


def test_a_shard_by_itself(tmp_path):
    import pyarrow as pa

    path = tmp_path / "x.sst"
    entries = sorted((sstable.key_of(i * 3), bytes([i % 251]) * (i % 900) * 2) for i in range(2000))
    with pa.OSFile(str(path), "wb") as sink:
        writer = sstable.Writer(sink, 2)
        for key, value in entries:
            writer.add(key, value)
        writer.close()
    with pa.OSFile(str(path), "rb") as source:
        reader = sstable.Reader(source)
        assert list(reader) == entries
        assert len(reader.blocks) > 5
        assert all(reader.get(k) == [v] for k, v in entries[::37])
        assert all(reader.get(sstable.key_of(i * 3 + 1)) == [] for i in range(300))
        assert sum(sstable.key_of(i * 3 + 1) in reader.bloom for i in range(3000)) < 90
    data = bytearray(path.read_bytes())
    data[-200] ^= 1
    path.write_bytes(data)
    with pa.OSFile(str(path), "rb") as source, pytest.raises(ValueError):
        sstable.Reader(source)
    assert sorted([sstable.key_of(x) for x in (None, -3, 0, 5, 1 << 40)]) == [sstable.key_of(x) for x in (None, -3, 0, 5, 1 << 40)]
    assert [sstable.id_of(sstable.key_of(x)) for x in (None, -3, "é")] == [None, -3, "é"]
