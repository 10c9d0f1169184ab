"""Operator 5: token ids in sorted-string-table shards.

A shard is one file that holds documents in the order of their ids:

* data blocks: entries (shared key bytes, other key bytes, value), keys
  prefix-compressed against the one before, whole again every ``RESTART``
  entries; each block compressed by itself;
* the block index: last key, place and size of each block, for binary search;
* a Bloom filter over the keys;
* a footer of fixed size: where index and filter are, counts, and a check sum.

A key is a document id in an order-preserving form (null, then integers, then
strings).  A value is the document's ids as little-endian unsigned 16- or 32-bit
integers, as the vocabulary needs.

Documents are range-partitioned by id (among equal ids by a hash of the text, among
equal texts of an id by their place in the table, so that even one row in a third
of all is spread), sorted, and encoded in the task that writes the shard.  There
are as many shards as the bytes of the texts need.  A file has a name of its own for each attempt, and
only files of successful tasks come into the manifest, a Parquet table beside
them: lost executors and second attempts do no harm.  Files are written and read
through pyarrow's file systems, so the folder may be on any that it knows (local,
hdfs, s3a as s3, gs, abfss).

Null text is empty and has the end id alone.  Repeated ids and rows are all kept; a
null id is the least.  An empty table gives no shard and no rows.  Only id and text
are read, so further columns don't matter.
"""

from __future__ import annotations

import array
import bisect
import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Memo, Splitter, by_bytes, byte_alphabet, fresh_path, tokenizer_file

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_BYTES = 64 << 10
RESTART = 16
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"STRSST01"
FOOTER = struct.Struct("<QQQQQQBxxxxxxxI8s")
#: Bytes of text of a shard in a large table; a small one has as many shards as there are cores, so that all work.
SHARD_BYTES = 64 << 20
#: Bytes of text that are cut and encoded at once, and pre-tokens that a worker remembers.
SLICE_BYTES = 2 << 20
REMEMBERED = 120_000
MANIFEST = "shard int, path string, n_docs long, n_ids long, first_key binary, last_key binary, n_bytes long"


# ---------------------------------------------------------------- keys


def key_of(doc_id: object) -> bytes:
    """An id as bytes that sort like the ids."""
    if doc_id is None:
        return b"\x00"
    if isinstance(doc_id, int):
        return b"\x01" + struct.pack(">Q", doc_id + (1 << 63))
    return b"\x02" + str(doc_id).encode()


def id_of(key: bytes) -> object:
    if key[:1] == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[:1] == b"\x01" else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


# ---------------------------------------------------------------- writing


class Bloom:
    """A Bloom filter with two hashes of a key for all of its probes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        out = cls(np.zeros(max(8, (len(keys) * BLOOM_BITS + 7) // 8), np.uint8))
        if keys:
            at = np.concatenate([out._places(k) for k in keys])
            np.bitwise_or.at(out.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    def _places(self, key: bytes) -> np.ndarray:
        import xxhash

        h = xxhash.xxh128_intdigest(key)
        first, second, size = h & (1 << 63) - 1, h >> 64 | 1, len(self.bits) * 8
        return np.array([(first + i * second) % size for i in range(BLOOM_HASHES)], np.int64)

    def __contains__(self, key: bytes) -> bool:
        at = self._places(key)
        return bool(((self.bits[at >> 3] >> (at & 7)) & 1).all())


def _pack(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + pa.compress(data, "zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    (size,) = struct.unpack_from("<Q", data)
    return pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""


class Writer:
    """Writes one shard to a binary stream; entries come in the order of their keys."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.at = self.docs = self.ids = 0
        self.index, self.keys = [], []
        self.block, self.size, self.count, self.last = [], 0, 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.count % RESTART:
            shared = next((i for i, (a, b) in enumerate(zip(self.last, key)) if a != b), min(len(self.last), len(key)))
        else:
            shared = 0
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.count += 1
        self.docs += 1
        self.ids += len(value) // self.width
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            data = _pack(b"".join(self.block))
            self.sink.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
        self.block, self.size, self.count = [], 0, 0

    def close(self) -> None:
        self._close_block()
        index = _pack(b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) for k, at, size in self.index))
        bloom = Bloom.of(self.keys).bits.tobytes()
        self.sink.write(index)
        self.sink.write(bloom)
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, self.width, zlib.crc32(index + bloom), MAGIC)
        self.sink.write(footer)
        self.at += len(index) + len(bloom) + len(footer)


# ---------------------------------------------------------------- reading


class Reader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < FOOTER.size:
            raise ValueError("not a shard: too short")
        (index_at, index_size, bloom_at, bloom_size, self.docs, self.ids, self.width, check, magic) = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: no footer")
        index, bloom = self._bytes(index_at, index_size), self._bytes(bloom_at, bloom_size)
        if zlib.crc32(index + bloom) != check:
            raise ValueError("a damaged shard: index or filter")
        self.bloom = Bloom(np.frombuffer(bloom, np.uint8))
        self.blocks, data, at = [], _unpack(index), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.blocks.append((key, place, length))
        self.last_keys = [k for k, _, _ in self.blocks]

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, length = self.blocks[block]
        data, at, key = _unpack(self._bytes(place, length)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: filter, binary search in the index, then the blocks that may have it."""
        if key not in self.bloom:
            return []
        out = []
        for block in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            entries = [(k, v) for k, v in self._entries(block) if k >= key]
            out += [v for k, v in entries if k == key]
            if entries and entries[-1][0] > key:
                break
        return out


# ---------------------------------------------------------------- token ids


class WordBpe:
    """Ids as the tokenizers library gives them, with each pre-token looked up once."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.split = Splitter(pattern)
        # Of the pattern's alternatives, those that aren't runs of letters, in the syntax of Arrow's engine (whose blanks are
        # ASCII only; texts with one of the other two of Latin-1 are left to the splitter).
        kinds = [x for x in pattern.split("|") if x != r"[\p{L}]+"]
        self.cuts = len(kinds) == pattern.count("|")  # else this isn't such a pattern, and the splitter takes all texts
        self.between = "(" + "|".join(x.replace(r"\s", r"\t\n\x0b\f\r ") for x in kinds) + ")"
        self.blanks = re.compile("[\x1c-\x1f\x85\xa0]").search
        self.letters = byte_alphabet()
        most = max(self.library.get_vocab(with_added_tokens=True).values())
        self.width = 2 if most < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.code = "H" if self.width == 2 else "I"
        self.memo = Memo(self._ids, most=REMEMBERED)

    def _ids(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        return array.array(self.code, [t.id for t in self.library.model.tokenize(mapped)]).tobytes()

    @staticmethod
    def plain(text: str) -> bool:
        """Whether a text is Latin-1 without special strings: normalising is lower-casing then (white space is dropped anyway)."""
        if "<|" in text:
            return False
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return True

    def encode(self, text: str) -> bytes:
        if not self.plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.memo.__getitem__, self.split.latin(text.lower())))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        Plain texts are cut by Arrow: what isn't a run of letters gets blanks around
        it, so that the matches of the pattern are what stands between blanks.  Only
        the different ones of a batch are looked up one by one.
        """
        out: list[bytes | None] = [None if self.cuts and self.plain(x) and not self.blanks(x) else self.encode(x) for x in texts]
        plain = [i for i, x in enumerate(out) if x is None]
        low = pc.utf8_lower(pa.array([texts[i] for i in plain], pa.large_string()))
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(low, self.between, r" \1 "))
        coded = pc.dictionary_encode(pieces.flatten())
        ids = list(map(self.memo.__getitem__, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        firsts = np.cumsum(sizes) - sizes
        used = coded.indices.to_numpy()
        lengths = sizes[used]
        ends = np.r_[0, np.cumsum(lengths)]
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        at = np.repeat((firsts[used] - ends[:-1]).astype(kind), lengths)
        at += np.arange(ends[-1], dtype=kind)
        found = np.frombuffer(b"".join(ids), self.kind)[at]
        edges = ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        for i, a, b in zip(plain, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[i] = found[a:b].tobytes()
        return out


@functools.cache
def coder(path: str) -> WordBpe:
    """The coder of a file, made once per Python worker."""
    return WordBpe(path)


# ---------------------------------------------------------------- shards


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    """A Hadoop path as a URI that pyarrow knows: file:/x is file:///x, s3a is s3."""
    if path.startswith(("s3a://", "s3n://")):
        return f"s3://{path[6:]}"
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def write_shards(
    docs: DataFrame,
    path: str | None = None,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """Write the shards to a new folder ``path`` (of the shared folder if None); the manifest, a row for each shard."""
    spark = docs.sparkSession
    root = _uri(path or fresh_path(spark, "shards"))
    if shards is None:
        rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()
        shards = max(1, -(-size // SHARD_BYTES), min(4 * spark.sparkContext.defaultParallelism, rows // 256))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer_file(vocabulary))
        end = np.array([end_id], bpe.kind).tobytes()
        shard = TaskContext.get().partitionId()
        store, folder = _file_system(root)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        writer = sink = first = None
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                texts = [x or "" for x in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("id").to_pylist(), bpe.encode_all(texts), strict=True):
                    if writer is None:
                        store.create_dir(folder, recursive=True)
                        sink = store.open_output_stream(f"{folder}/{name}")
                        writer, first = Writer(sink, bpe.width), key_of(doc_id)
                    writer.add(key_of(doc_id), ids + end)
        if writer is not None:
            last = writer.last
            writer.close()
            sink.close()
            row = (shard, f"{root}/{name}", writer.docs, writer.ids, first, last, writer.at)
            names = ["shard", "path", "n_docs", "n_ids", "first_key", "last_key", "n_bytes"]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("copy")]
    # Rows equal in id and text are alike; a number by place tells them apart, so that no shard has to take them all.
    ranged = source.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("copy")
    manifest = f"{root}/manifest.parquet"
    ranged.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_shards(spark: SparkSession, manifest: DataFrame, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """Id, ``start`` (ids of all documents before it) and ``ids`` (binary, unsigned 32-bit) of each document, from the files."""
    shards = manifest.select("shard", "path", "n_ids").orderBy("shard").collect()  # a row for each file
    before, rows = 0, []
    for r in shards:
        rows.append((r["path"], before))
        before += r["n_ids"]
    files = spark.createDataFrame(rows, "path string, start long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                store, file = _file_system(path)
                with store.open_input_file(file) as source:
                    reader = Reader(source)
                    held, size = [], 0
                    for key, value in reader:
                        ids = value if reader.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                        held.append((id_of(key), start, ids))
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 4 << 20:
                            yield out(held)
                            held, size = [], 0
                    if held:
                        yield out(held)

    kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def out(held: list[tuple]) -> pa.RecordBatch:
        ids, starts, values = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], names=[id_col, "start", "ids"])

    return files.repartition(max(1, len(rows)), "path").mapInArrow(run, f"`{id_col}` {id_type}, start long, ids binary")


def look_up(manifest: DataFrame, doc_id: object) -> list[np.ndarray]:
    """The ids of the documents with an id, by the manifest, the filters and binary search."""
    key = key_of(doc_id)
    out = []
    for r in manifest.where((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("shard").collect():
        store, file = _file_system(r["path"])
        with store.open_input_file(file) as source:
            reader = Reader(source)
            out += [np.frombuffer(v, f"<u{reader.width}").astype("<u4") for v in reader.get(key)]
    return out


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Id, ``start``, ``n_tokens`` and ``ids_crc32`` of each document, as read back from the shards written for ``docs``."""
    manifest = write_shards(docs, path, id_col=id_col, **options)
    id_type = dict(docs.dtypes)[id_col]
    found = read_shards(docs.sparkSession, manifest, {"bigint": "long"}.get(id_type, id_type), id_col)
    return found.select(id_col, "start", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
