"""Operator 2: byte-level BPE encoding and decoding through a serialised model.

The vocabulary (bytes and rank of each token) is turned directly into a
sentencepiece BPE model, without any training: a piece is the token's bytes in
the byte alphabet, its score is the negative rank, and normalisation is the
identity.  Merging the pair with the best score first is then merging the pair
with the lowest rank first, so each pre-token gets the ids that the ranks give.
Ids are the ranks; decoding maps ids back to bytes.

Null text is empty; an empty text has no ids.  Texts are encoded whole, whatever
their length.  Repeated rows are each encoded.  Only id and text are read.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import Memo, Splitter, byte_alphabet, map_text, tokenizer_file

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Field numbers and values of the sentencepiece model format.  Fixed values.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID, UNK_TEXT, BPE = 3, 4, 40, 41, 42, 43, 45, 2
RULE_NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
#: No byte maps to this character, so that no piece can be it.
UNKNOWN_PIECE = "⁇"


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    if n < 0:
        n += 1 << 64
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary.  Piece ``i + 1`` is the i-th token by rank."""
    alphabet = byte_alphabet()
    pieces = [(UNKNOWN_PIECE, 0.0, UNKNOWN)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(("".join(alphabet[b] for b in token), -float(rank), NORMAL))
    out = bytearray()
    for text, score, kind in pieces:
        score_field = _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", score)
        out += _block(PIECES, _block(PIECE_TEXT, text.encode()) + score_field + _number(PIECE_KIND, kind))
    out += _block(
        TRAINER,
        _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(pieces)) + _number(UNK_ID, 0) + _number(BOS_ID, -1)
        + _number(EOS_ID, -1) + _number(PAD_ID, -1) + _block(UNK_TEXT, UNKNOWN_PIECE.encode()),
    )
    identity = _block(RULE_NAME, b"identity") + _number(DUMMY_PREFIX, 0) + _number(EXTRA_SPACES, 0) + _number(ESCAPE_SPACES, 0)
    return bytes(out + _block(NORMALIZER, identity))


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.pattern = pattern or public_tokenizers.PATTERN
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.pre_tokens = Splitter(self.pattern)
        ordered = sorted(self.ranks.items(), key=lambda x: x[1])
        self.rank_of = [rank for _, rank in ordered]
        self.token_of = {rank: token for token, rank in ordered}
        self.dense = self.rank_of == list(range(len(ordered)))
        self.tokens = [token for token, _ in ordered] if self.dense else self.token_of
        self.letters = {i: c for i, c in byte_alphabet().items()}
        # A pre-token that is in the vocabulary is that token, even where no merges lead to it.
        whole = ["".join(self.letters[b] for b in token) for token, _ in ordered]
        self.direct = {
            text: rank for text, (_, rank), ids in zip(whole, ordered, self.model.encode(whole, num_threads=1), strict=True) if len(ids) != 1
        }
        self.memo = Memo(self._ids)

    def _ids(self, piece: str) -> bytes:
        """The ids of a pre-token, as little-endian unsigned 32-bit integers."""
        mapped = piece.encode().decode("latin-1").translate(self.letters)
        if mapped in self.direct:
            return struct.pack("<I", self.direct[mapped])
        return np.array([self.rank_of[i - 1] for i in self.model.encode(mapped)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pre_tokens(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def coder(path: str, pattern: str | None = None) -> ByteBpe:
    """The coder of a file, made once per Python worker."""
    return ByteBpe(path, pattern)


def encoded(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``ids`` (little-endian unsigned 32-bit integers, as binary) of each row."""

    def make() -> Callable:
        bpe = coder(tokenizer_file(vocabulary))
        return lambda texts: [pa.array([bpe.encode(x) for x in texts], pa.binary())]

    return map_text(df, make, [("ids", T.BinaryType())], id_col, text_col)


def decoded(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Id and ``decoded`` (the bytes that the ids stand for) of each row; null ids are empty."""
    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        bpe = coder(tokenizer_file(vocabulary))
        for batch in batches:
            out = pa.array([bpe.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), out], names=[id_col, "decoded"])

    return source.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``ids`` and the bytes ``decoded`` from those ids, in one pass over the texts."""

    def make() -> Callable:
        bpe = coder(tokenizer_file(vocabulary))

        def work(texts: list[str]) -> list[pa.Array]:
            ids = [bpe.encode(x) for x in texts]
            return [pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())]

        return work

    return map_text(df, make, [("ids", T.BinaryType()), ("decoded", T.BinaryType())], id_col, text_col)


def digests(df: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded bytes of each row."""
    return round_trip(df, vocabulary, id_col, text_col).select(
        id_col,
        F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
