"""Operator 3: near-duplicate components over 64-bit SimHash fingerprints.

A fingerprint takes the hash of every shingle (runs of four words, repeats
included) and sets the bits that are set in over half of them.  Fingerprints at
four or fewer differing bits are linked, and linked ones form components.

Multi-index hashing: the 64 bits are cut into three segments.  Two fingerprints
within four bits differ by at most one bit in one of the segments, so each enters
the table of a segment under its own value and under the values one bit away;
rows that meet under a value are candidates, and their complete distance is
verified.  Of two values one bit apart only the one with the 0 bit probes, which
finds each such pair once.

What keeps this linear:

* equal fingerprints are one node with a count, however many documents share it;
* within a group that meets, links are found by growing trees, so a group of n
  gives n - 1 edges at most, never all its pairs;
* a group beyond ``GROUP`` rows isn't gathered: its rows go through the same
  search again, cut by further bits of the fingerprint; what is left beyond it after
  three cuts is dealt into blocks, and each pair of blocks is a task's group.

Definitions for odd rows: null and blank texts have fingerprint zero, which links
like any other.  A text of fewer than four words has one shingle, all its words.
Rows with a null id take part; the component id is the least non-null id reached,
else null.  Repeated rows are each returned.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import join_counted, map_text, unused, written
from strandline.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: The segments by level, as masks that together have all 64 bits.  With three segments and RADIUS 4, one
#: of them differs by one bit at most.  Deeper levels deal the bits out otherwise, so that what a group
#: shares at one level is spread over the segments of the next.
SEGMENTS = tuple(
    tuple(sum(1 << bit for bit in range(64) if of(bit) == segment) for segment in range(3))
    for of in (lambda bit: min(bit // 21, 2), lambda bit: bit % 3, lambda bit: bit // 3 % 3)
)
#: Rows of one value that one task compares; larger groups are cut further.
GROUP = 16_384
#: Groups up to this size are compared many at once.
SMALL = 24


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str) -> int:
    """The fingerprint of a text, as an unsigned 64-bit integer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return hashed(line, SEED)
    starts = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
    hashes = np.array([hashed(line[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])], "<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        rows = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``fp`` (the fingerprint's 64 bits as a signed long) of each row."""

    def make() -> Callable:
        return lambda texts: [pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))]

    return map_text(df, make, [("fp", T.LongType())], id_col, text_col)


# ---------------------------------------------------------------- candidates


def _signed(n: int) -> str:
    return f"{n - (1 << 64) if n >> 63 else n}L" if n != 1 << 63 else "(-9223372036854775807L - 1L)"


def _entries(rows: DataFrame, key: str, masks: tuple[int, ...], mark: int) -> DataFrame:
    """Rows (k, fp, flags): each fingerprint under its own value of each segment and under those that it probes.

    ``key`` is what the rows already share, as SQL; ``mark`` is the flag of a probe.
    """
    parts = []
    for number, mask in enumerate(masks):
        value = f"(fp & {_signed(mask)})"
        bits = ", ".join(str(b) for b in range(64) if mask >> b & 1)
        parts.append(f"array(named_struct('k', xxhash64({key}, {number}, {value}), 'p', 0))")
        parts.append(
            f"transform(filter(array({bits}), i -> (shiftrightunsigned(fp, i) & 1L) = 0L),"
            f" i -> named_struct('k', xxhash64({key}, {number}, {value} | shiftleft(1L, i)), 'p', {mark}))"
        )
    return rows.selectExpr("fp", "flags", f"explode(concat({', '.join(parts)})) AS e").selectExpr("e.k AS k", "fp", "flags | e.p AS flags")


def trees(fps: np.ndarray, flags: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links of one group.  Two rows that both probe the same value aren't candidates."""
    left, right = [], []
    open_fps, open_flags = fps, flags
    while len(open_fps):
        reached = [(open_fps[0], open_flags[0])]
        open_fps, open_flags = open_fps[1:], open_flags[1:]
        while reached and len(open_fps):
            fp, flag = reached.pop()
            near = (np.bitwise_count(open_fps ^ fp) <= radius) & ((open_flags & flag) == 0)
            if near.any():
                new, new_flags = open_fps[near], open_flags[near]
                left.append(np.full(len(new), fp))
                right.append(new)
                reached.extend(zip(new, new_flags, strict=True))
                open_fps, open_flags = open_fps[~near], open_flags[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _trees_at_once(fps: np.ndarray, flags: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`trees` for many groups of the same size, one a row: each row's least fellow reached."""
    size = fps.shape[1]
    linked = (np.bitwise_count(fps[:, :, None] ^ fps[:, None, :]) <= radius) & ((flags[:, :, None] & flags[:, None, :]) == 0)
    linked |= np.eye(size, dtype=bool)
    label = np.broadcast_to(np.arange(size), fps.shape).copy()
    while True:
        least = np.where(linked, label[:, None, :], size).min(axis=2)
        if (least == label).all():
            break
        label = least
    group, at = np.nonzero(label != np.arange(size))
    return fps[group, label[group, at]], fps[group, at]


def _linker(radius: int, group: int) -> Callable:
    """Over rows sorted by k: edges (a, b), and the rows of groups beyond ``group`` (k, fp, flags)."""

    def links(k: np.ndarray, fps: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[edge, len(k)])
        # Where all rows probe, no two of them are candidates.
        useful = (sizes > 1) & (np.bitwise_and.reduceat(flags, edge) == 0)
        left, right = [], []
        for size in np.unique(sizes[useful]):
            begins = edge[useful & (sizes == size)]
            if size <= SMALL:
                for some in np.array_split(begins, max(1, len(begins) * size * size // 2_000_000)):
                    rows = some[:, None] + np.arange(size)
                    a, b = _trees_at_once(fps[rows], flags[rows], radius)
                    left.append(a)
                    right.append(b)
            else:
                for at in begins:
                    a, b = trees(fps[at : at + size], flags[at : at + size], radius)
                    left.append(a)
                    right.append(b)
        none = np.zeros(0, np.uint64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def out(a, b, k=None, flags=None) -> pa.RecordBatch:
        n = len(a)
        later = pa.array(np.asarray(k, np.int64)) if k is not None else pa.nulls(n, pa.int64())
        marks = pa.array(np.asarray(flags, np.int32)) if flags is not None else pa.nulls(n, pa.int32())
        other = pa.array(b.view(np.int64)) if b is not None else pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), other, later, marks], names=["a", "b", "k", "flags"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)]
        passing = None  # the value of a group that is passed on
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
            k, fps, flags = (np.concatenate(x) for x in zip(held, new, strict=True))
            if not len(k):
                continue
            if passing is not None:
                n = int(np.searchsorted(k, passing, "right"))
                if n:
                    yield out(fps[:n], None, k[:n], flags[:n])
                k, fps, flags = k[n:], fps[n:], flags[n:]
                if not len(k):
                    held = [k, fps, flags]
                    continue
                passing = None
            last = int(np.searchsorted(k, k[-1], "left"))
            held = [k[last:], fps[last:], flags[last:]]
            if last:
                yield from whole(k[:last], fps[:last], flags[:last])
            if len(held[0]) > group:
                passing = held[0][0]
                yield out(held[1], None, held[0], held[2])
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from whole(*held)

    def whole(k, fps, flags) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[edge, len(k)])
        large = np.repeat(sizes > group, sizes)
        if large.any():
            yield out(fps[large], None, k[large], flags[large])
            k, fps, flags = k[~large], fps[~large], flags[~large]
        if len(k):
            a, b = links(k, fps, flags)
            if len(a):
                yield out(a, b)

    return run


#: What :func:`_linker` returns: edges have a and b; rows to be cut further have a (the fingerprint), k and flags.
LINKS = T.StructType(
    [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("k", T.LongType()), T.StructField("flags", T.IntegerType())]
)


def links(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that span all links within ``radius`` bits between the distinct fingerprints ``fp``.

    Groups beyond ``group`` rows are cut further.  Rows that are together in such a
    group after the last cut share three cuts, so they are dense: their blocks are
    compared pair by pair, each in a task of its own with about ``group`` rows.
    """
    if radius > 5:
        raise ValueError("three segments, of which one is searched to one bit, cover five differing bits at most")
    rows = _entries(nodes.select("fp", F.lit(0).alias("flags")), "0L", SEGMENTS[0], 1)
    edges = None
    for level in range(len(SEGMENTS) + 1):
        last = level == len(SEGMENTS)
        sorted_rows = rows.repartition("k").sortWithinPartitions("k")
        found = written(sorted_rows.mapInArrow(_linker(radius, 1 << 62 if last else group), LINKS), "links")
        some = found.where("b IS NOT NULL").select("a", "b")
        edges = some if edges is None else edges.union(some)
        large = found.where("b IS NULL").selectExpr("k", "a AS fp", "flags")
        if last or large.isEmpty():
            return edges
        rows = _block_pairs(large, group) if level == len(SEGMENTS) - 1 else _entries(large, "k", SEGMENTS[level + 1], 2 << level)
    return edges


def _block_pairs(rows: DataFrame, group: int) -> DataFrame:
    """Rows (k, fp, flags) of large groups, each once for every pair of blocks that its block is in; k names the pair."""
    half = max(1, group // 2)
    blocks = rows.groupBy("k").agg(F.ceil(F.count("*") / half).cast("int").alias("blocks"))
    # A key has over `group` rows, so there are few.
    dealt = rows.join(F.broadcast(blocks), "k").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return paired.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "fp", "flags")


# ---------------------------------------------------------------- documents


def classes(fps: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Id, ``fp`` and ``component_id`` of each row of a table of ids and fingerprints, as :func:`fingerprints` gives it."""
    nodes = written(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "nodes")
    total = fps.count()
    linked = components(links(nodes, radius, group)).withColumnRenamed("node", "fp").join(nodes.select("fp", "least"), "fp")
    by_root = linked.groupBy("root").agg(F.min("least").alias("c"), F.count("*").alias("n"))
    named = join_counted(linked.select("fp", "root"), by_root, "root", "n", linked.count()).select("fp", "c")
    all_nodes = nodes.join(named, "fp", "left").select("fp", F.coalesce("c", "least").alias("component_id"), "n")
    return join_counted(fps, written(all_nodes, "nodes"), "fp", "n", total).select(id_col, "fp", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Id, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` of each row."""
    fps = written(fingerprints(df, id_col, text_col), "fingerprints")
    return classes(fps, id_col, radius, group).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, without near duplicates: of each component the row with the least id.

    Rows that are wholly alike in id and fingerprint count as one; of a component
    without any id one row stays too.  The rows are written once with their
    fingerprints, and read again for the choice.
    """
    key, same, bits, count = (unused(df, name) for name in ("fingerprint_bits", "kept_id", "kept_fp", "kept_n"))
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(key, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or "") for x in batch.column(text_col).to_pylist()]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, key])

    rows = written(df.mapInArrow(run, schema), "documents")
    fps = rows.select(F.col(id_col).alias("doc_id"), F.col(key).alias("fp"))
    chosen = written(classes(fps).where("doc_id <=> component_id").groupBy("doc_id", "fp").agg(F.count("*").alias("n")), "kept")
    nameless = chosen.where("doc_id IS NULL")
    if not nameless.isEmpty():
        # Without ids a component's rows are equally good: the least fingerprint stands for it.
        roots = components(links(nameless.select("fp").distinct()))
        lesser = roots.where("node <> root").select(F.col("node").alias("fp"))
        chosen = chosen.where("doc_id IS NOT NULL").unionByName(nameless.join(lesser, "fp", "left_anti"))
    named = chosen.select(F.col("doc_id").alias(same), F.col("fp").alias(bits), F.col("n").alias(count))
    joined = rows.join(named, F.col(id_col).eqNullSafe(F.col(same)) & (F.col(key) == F.col(bits)))
    if chosen.where("n > 1").isEmpty():
        return joined.select(*names)
    once, again = joined.where(F.col(count) == 1), joined.where(F.col(count) > 1)
    return once.unionByName(again.dropDuplicates([id_col, key])).select(*names)
