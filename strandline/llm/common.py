"""What several operators need: shared folders, Arrow batches, character classes."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one slice of an Arrow batch holds (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20


# ---------------------------------------------------------------- folders


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder for the session;
    on a cluster a machine-local folder would lose files, so that is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = root or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; its lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_strandline_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


# ---------------------------------------------------------------- Arrow


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` each."""
    held = begin = 0
    for i, value in enumerate(batch.column(column)):
        size = value.as_buffer().size if value.is_valid else 0
        if held and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    columns: list[tuple[str, T.DataType]],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``df``: its id and what a function makes of its text.

    ``make`` runs once per task in the Python worker and returns a function from
    texts (null is empty) to Arrow arrays.  Only id and text are read, so other
    columns of ``df``, whatever their names, don't matter.  There is no shuffle.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *(T.StructField(n, t) for n, t in columns)])
    names = [f.name for f in out.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in by_bytes(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *work(texts)], names=names)

    return source.mapInArrow(run, out)


def keep_rows(df: DataFrame, make: Callable[[], Callable[[list[str | None]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text a function accepts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in by_bytes(batch, text_col):
                yield part.filter(pa.array(work(part.column(text_col).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- skew


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` by ``key`` where a key may hold most of ``left``.

    ``right`` has each key once, and in ``count`` how many rows of ``left`` have
    it; ``total`` is their sum.  Keys above 1/4096 of the rows (4,096 at most, by
    that arithmetic) are broadcast, so that the rows of a hot key stay where they
    are; only the others are shuffled.
    """
    hot_from = max(128, total // 4096)
    hot = right.where(F.col(count) > hot_from).drop(count)
    cold = right.where(F.col(count) <= hot_from).drop(count)
    here = left.join(F.broadcast(hot), key, "inner")
    there = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return here.unionByName(there.select(*here.columns))


# ---------------------------------------------------------------- bitmaps

#: Bits of a bitmap's places: two megabytes, however many values went in.
BITMAP_BITS = 24


def slot(*columns) -> Column:
    """The place of a value in a bitmap."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def bitmap(df: DataFrame, *columns, hashed: bool = False) -> np.ndarray:
    """A bitmap of fixed size with the slots of all values of ``columns`` in ``df``, or with the slots that one column is.

    Executors fold the values into words, so what comes to the driver is bounded.
    It tells which values surely aren't there; with very many values it tells little,
    and callers must be right without it.
    """
    at = columns[0] if hashed else slot(*columns)
    words = df.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    return (bits[slots >> 6] >> (slots & 63) & 1).astype(bool)


# ---------------------------------------------------------------- tokenizers


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is installed; every machine has its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """The printable character for each byte that byte-level vocabularies use.

    A byte whose Latin-1 character is printable stands for itself; the others
    take the characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@functools.cache
def newer_characters() -> str:
    """Letters and numbers of the ``regex`` module that older Unicode tables lack.

    Both tokenizer libraries carry their own tables.  One pass over all code
    points tells where they differ; a text with such a character takes the
    library's own splitter instead of the pattern.
    """
    import regex
    from tokenizers import Regex, pre_tokenizers

    points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    blocks = ["".join(points[at : at + 512]) for at in range(0, len(points), 512)]  # the library is slow on long texts here
    found = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        ours, remove = regex.compile(kind), pre_tokenizers.Split(Regex(kind), behavior="removed")
        for block in blocks:
            theirs = set(block).difference(*(x for x, _ in remove.pre_tokenize_str(block)))
            found |= theirs.symmetric_difference(ours.findall(block))
    return "".join(sorted(found))


@functools.cache
def newer_search() -> Callable[[str], bool]:
    """A function that tells whether a text has any of :func:`newer_characters`."""
    import re

    found = set(newer_characters())
    if not found:
        return lambda text: False
    # One range is quick to look for; few texts have any character so far up.
    above = re.compile(f"[{re.escape(min(found))}-\U0010ffff]+").findall
    return lambda text: any(not found.isdisjoint(x) for x in above(text))


class Splitter:
    """All matches of a tokenizer's pattern, as its library finds them.

    Latin-1 texts take the standard module with the classes written out, which is
    about twice as fast; others take the ``regex`` module, and those with a
    character on which it differs from the library take the library.
    """

    def __init__(self, pattern: str):
        import re

        import regex
        from tokenizers import Regex, pre_tokenizers

        self.latin = re.compile(_written_out(pattern)).findall
        self.wide = regex.compile(pattern).findall
        self.beyond = re.compile(r"[^\x00-\xff]").search
        self.newer = newer_search()
        self.library = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond(text):
            return self.latin(text)
        if self.newer(text):
            return [x for x, _ in self.library.pre_tokenize_str(text)]
        return self.wide(text)


def _written_out(pattern: str) -> str:
    """The pattern with its classes of letters, numbers and blanks as ranges of Latin-1."""
    import regex

    latin = [chr(c) for c in range(256)]
    inner = {
        kind: "".join(f"\\x{ord(c):02x}" for c in latin if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s")
    }
    out, at, in_class = [], 0, False
    while at < len(pattern):
        kind = next((k for k in inner if pattern.startswith(k, at)), None)
        if kind:
            out.append(inner[kind] if in_class else f"[{inner[kind]}]")
            at += len(kind)
        elif pattern.startswith(r"\S", at) and not in_class:
            out.append(f"[^{inner[r'\s']}]")
            at += 2
        else:
            size = 2 if pattern[at] == "\\" else 1
            in_class = {"[": True, "]": False}.get(pattern[at], in_class)
            out.append(pattern[at : at + size])
            at += size
    return "".join(out)


class Memo(dict):
    """A bounded dict that works out what it lacks; long keys aren't kept.

    When it is full it begins anew, but what comes again from the filling before
    is taken over, so that frequent keys stay.
    """

    def __init__(self, make: Callable, start: dict | None = None, most: int = 160_000, longest: int = 64):
        super().__init__(start or {})
        self.make, self.start, self.most, self.longest, self.before = make, start or {}, most, longest, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most + len(self.start):
                self.before = self.copy()
                self.clear()
                self.update(self.start)
            self[key] = value
        return value
