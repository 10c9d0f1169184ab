"""Operator 6: token counts with a whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone; those
that come out as one token, and that the splitter leaves whole, are proven to
count one wherever they are a pre-token.  Such pre-tokens are counted directly;
only the others go through the merges.  Special strings inside a text count one
each, as they do in the library by default.

Null and empty texts have no tokens.  Texts are counted whole.  Only id and text
are read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import Memo, Splitter, byte_alphabet, map_text, tokenizer_file

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


class Counter:
    """Counts the tokens of texts for one byte-level vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.split = Splitter(public_tokenizers.PATTERN)
        self.letters = byte_alphabet()
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.memo = Memo(self._merged, dict.fromkeys(self.whole_tokens(), 1))

    def whole_tokens(self) -> list[str]:
        """The vocabulary's strings that are one pre-token and one token."""
        back = {c: b for b, c in self.letters.items()}
        texts = []
        for piece in self.library.get_vocab(with_added_tokens=False):
            try:
                texts.append(bytes(back[c] for c in piece).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # a part of a character never is a pre-token
        alone = [x for x in texts if self.split(x) == [x]]
        return [x for x, e in zip(alone, self.library.encode_batch(alone, add_special_tokens=False), strict=True) if len(e.ids) == 1]

    def _merged(self, piece: str) -> int:
        return len(self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.memo.__getitem__, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.memo.__getitem__, self.split(x))) for x in parts)


@functools.cache
def counter(path: str) -> Counter:
    """The counter of a file, made once per Python worker."""
    return Counter(path)


def token_counts(df: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row."""

    def make() -> Callable:
        count = counter(tokenizer_file(vocabulary)).count

        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array([count(x) for x in texts], pa.int64())]

        return work

    out = map_text(df, make, [("n_bytes", T.LongType()), ("n_tokens", T.LongType())], id_col, text_col)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
