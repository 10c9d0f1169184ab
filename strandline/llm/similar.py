"""Near duplicates by what texts share: the pipeline's stage, SimHash with multi-index hashing and exact verification.

Two texts are near duplicates if at least ``SIMILARITY`` of their different runs of
five words (of those that either has) are in both; linked ones form components.

Operator 3 at four bits finds few of these: at a similarity of 0.8 fingerprints differ
by about ten bits of 64.  So here a fingerprint is longer, ``WORDS_OF`` words of 64 bits
by the same rule (majority of bits over all runs), and multi-index hashing cuts it into
segments of ``BITS`` bits.  Texts that are equal in a segment are candidates.  At a
similarity of 0.8 a bit is the same with a chance of 0.848, a segment of 0.1, and all 112
segments differ for one pair in a hundred thousand (texts of up to five runs agree less
and have twice the segments).  The distance of the first two words (``RADIUS``, ``BOTH``),
sizes and parities that allow the similarity are asked next, and what is left is verified
exactly, by the runs themselves (up to equal hashes of 32 bits).

A text's parities are ``64 * ODD`` bits: whether the number of its runs at each of so many
places is odd.  A run that two texts share changes both alike, so they differ in no more bits
than there are runs which only one of them has; a pair whose parities differ in more bits than
the similarity allows such runs is surely none.  That leaves out most texts which are near a
large group but not similar enough, and meet its members in segment after segment.

What keeps this linear:

* texts with the same runs are one node, however many documents have them;
* segments are searched in rounds, the first one before the others.  Rows that meet
  are first a few numbers each, and only texts that have a candidate they aren't
  linked to yet go on; so a cluster that one round has linked costs the next ones
  nothing more;
* runs are only fetched for those texts, found by a bitmap of fixed size;
* a group verifies a pair only if it isn't linked yet, and gives edges that span its
  links, never all its pairs; a group beyond ``GROUP`` texts or ``GROUP_RUNS`` runs is
  dealt into blocks, each pair of which is a task's group of its own: first one block with
  all others, then those texts that aren't linked to most of the group with all.

Definitions for odd rows: null and blank texts have no runs and are all alike.  A
text of up to five words has one run, all its words; texts with fewer than four runs
are alike or not linked at 0.8.  Of a component the row with the least id stays, of
rows with that id the first; a component without any id keeps one row too.  An empty
table stays empty, and all columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import bitmap, by_bytes, in_bitmap, slot, unused, written
from strandline.llm.components import components

WORDS = 5
SEED = 42
SIMILARITY = 0.8
#: Words of a fingerprint, those of texts with up to ``TINY`` runs, segments of a word and their bits.
WORDS_OF, WORDS_OF_TINY, TINY = 28, 56, 5
SEGMENTS_OF, BITS = 4, 14
SEGMENTS = WORDS_OF_TINY * SEGMENTS_OF
#: Bits by which candidates differ at most in the first word, and in the first two; at a similarity of 0.8
#: about 10, give or take 3, and 20, give or take 4.  Of tiny texts that differ more a few bits more.
RADIUS, BOTH = 24, 38
MORE, MORE_BOTH = 4, 8
#: Words of a text's parities; they tell the most of texts with up to some 64 * ODD runs, and nothing of very long ones.
ODD = 3
#: Texts of a group that one task compares, and their runs.
GROUP = 16_384
GROUP_RUNS = 4 << 20
#: Segments that are verified together.
ROUNDS = ((0, 4), (4, 24), (24, SEGMENTS))
#: Rows and candidates that are looked at at once, and groups that are compared many at once.
ROWS, CANDIDATES, SMALL = 64, 1 << 15, 24
SLACK = 1e-9


def runs(text: str) -> np.ndarray:
    """The hashes of a text's different runs of words, in order."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return np.array([hashed(line, SEED)], np.uint64)
    starts = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
    return np.unique(np.array([hashed(line[a : b - 1], SEED) for a, b in zip(starts, starts[WORDS:])], np.uint64))


#: What tells the hashes of a run for the words of a fingerprint apart, from a seeded generator.
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS_OF_TINY, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _hashes(found: np.ndarray, words: int) -> np.ndarray:
    """A row of ``words`` hashes for each run."""
    x = found[:, None] + _SALTS[:words]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The bits that over half of the runs have, as words of 64."""
    words = WORDS_OF if len(found) > TINY else WORDS_OF_TINY
    bits = np.zeros(64 * words, np.int64)
    for at in range(0, len(found), 255):
        rows = _hashes(found[at : at + 255], words).astype("<u8").view(np.uint8).reshape(-1, 8 * words)
        bits += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)  # 255 at most
    return np.packbits(2 * bits > len(found), bitorder="little").view("<u8")


def cut(fp: np.ndarray) -> np.ndarray:
    """The segments of a fingerprint, one after another."""
    return ((fp[:, None] >> (np.arange(SEGMENTS_OF, dtype=np.uint64) * np.uint64(BITS))) & np.uint64((1 << BITS) - 1)).astype(np.int16).ravel()


def parities(found: np.ndarray) -> np.ndarray:
    """For each of ``64 * ODD`` places whether the number of runs there is odd, as words of 64."""
    counts = np.bincount((found % np.uint64(64 * ODD)).astype(np.int64), minlength=64 * ODD)
    return np.packbits(counts & 1 == 1, bitorder="little").view("<u8")


def segments(found: np.ndarray) -> list[int]:
    """The segments of a text with these runs; texts with fewer than four runs have none."""
    return cut(fingerprint(found)).tolist() if len(found) >= 4 else []


def _node(found: np.ndarray) -> int:
    """What texts with the same runs share, as a signed long."""
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


# ---------------------------------------------------------------- groups


def _groups(batches: Iterable[pa.RecordBatch], most: int = 1 << 62) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by ``k`` as whole groups, many in a table; and those of groups beyond ``most`` rows as they come, marked True."""
    held: list[pa.RecordBatch] = []  # rows of the group that goes on, and whole groups before it
    rows, large = 0, None
    for batch in batches:
        k = batch.column("k").to_numpy()
        if large is not None and len(k):
            n = int(np.searchsorted(k, large, "right"))
            if n:
                yield pa.Table.from_batches([batch.slice(0, n)]), True
            batch, k = batch.slice(n), k[n:]
        if not len(k):
            continue
        large = None
        last = int(np.searchsorted(k, k[-1], "left"))
        if last or (held and held[-1].column("k")[0].as_py() != k[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)]), False
            held, rows = [], 0
        held.append(batch.slice(last))
        rows += batch.num_rows - last
        if rows > most:
            large = int(k[-1])
            yield pa.Table.from_batches(held), True
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held), False


def _edges_of(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return begins, np.diff(np.r_[begins, len(k)])


def _near(fps, others, more, their_more, sizes, their_sizes, similarity: float, radius: int) -> np.ndarray:
    """Whether distances and sizes allow the similarity."""
    least, most = np.minimum(sizes, their_sizes), np.maximum(sizes, their_sizes)
    first, tiny = np.bitwise_count(fps ^ others), least <= TINY
    near = first <= radius + MORE * tiny
    near &= first + np.bitwise_count(more ^ their_more) <= BOTH + MORE_BOTH * tiny
    return near & (least >= similarity * most - SLACK)


def _met_before(first: np.ndarray, second: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Whether pairs, by the bits in which their first two words differ, are equal in a segment of those before this one."""
    out = np.zeros(len(first), bool)
    for number in range(2 * SEGMENTS_OF):
        word, at = (first, second)[number // SEGMENTS_OF], np.uint64(number % SEGMENTS_OF * BITS)
        out |= ((word >> at & np.uint64((1 << BITS) - 1)) == 0) & (number < segment)
    return out


def candidates(table: pa.Table, similarity: float, radius: int, by_segment: bool = False) -> np.ndarray:
    """Which rows (k, root, fp, more, size, parities; sorted by k) have a candidate in their group that they aren't linked to.

    With ``by_segment`` the key tells the segment; pairs that are equal in an earlier one were verified there.
    """
    k, fps, more, sizes, roots = (table.column(c).to_numpy() for c in ("k", "fp", "more", "size", "root"))
    fps, more = fps.view(np.uint64), more.view(np.uint64)
    odd = [table.column(c).to_numpy().view(np.uint64) for c in _ODD]
    out = np.zeros(len(k), bool)

    def mark(a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), CANDIDATES):
            x, y = a[at : at + CANDIDATES], b[at : at + CANDIDATES]
            apart = np.zeros(len(x), np.int64)
            for word in odd:
                apart += np.bitwise_count(word[x] ^ word[y])
            # Of n and m runs, so many at most are in one of two similar texts only.
            kept = apart <= (sizes[x] + sizes[y]) * ((1 - similarity) / (1 + similarity)) + SLACK
            if by_segment:
                kept &= ~_met_before(fps[x] ^ fps[y], more[x] ^ more[y], k[x] >> BITS)
            out[x[kept]] = True

    begins, counts = _edges_of(k)
    for n in np.unique(counts[counts > 1]):
        at = begins[counts == n]
        if n <= SMALL:
            for some in np.array_split(at, max(1, len(at) * n * n // 500_000)):
                rows = some[:, None] + np.arange(n)
                x, y = rows[:, :, None], rows[:, None, :]
                near = _near(fps[x], fps[y], more[x], more[y], sizes[x], sizes[y], similarity, radius)
                group, i, j = np.nonzero(near & (roots[x] != roots[y]))
                mark(rows[group, i], rows[group, j])
        else:
            for begin in at:
                every = slice(begin, begin + n)
                for part in range(begin, begin + n, ROWS):
                    own = slice(part, min(begin + n, part + ROWS))
                    near = _near(fps[own, None], fps[every], more[own, None], more[every], sizes[own, None], sizes[every], similarity, radius)
                    i, j = np.nonzero(near & (roots[own, None] != roots[every]))
                    mark(part + i, begin + j)
    return out


def links(nodes: np.ndarray, roots: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """Edges that span the links between texts of one group beyond those that ``roots`` has already."""
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    nodes, fps, sizes, sets = nodes[order], fps[order], sizes[order], [sets[i] for i in order]
    label = np.unique(roots[order], return_inverse=True)[1]
    left, right = [], []
    for at in range(0, len(fps), ROWS):
        own = sizes[at : at + ROWS]
        end = int(np.searchsorted(sizes, own[-1] / similarity + SLACK, "right"))
        a, b = np.nonzero(np.bitwise_count(fps[at : at + ROWS, None] ^ fps[None, at + 1 : end]) <= radius + MORE * (own[:, None] <= TINY))
        a, b = a + at, b + at + 1
        fits = (a < b) & (sizes[a] >= similarity * sizes[b] - SLACK)
        a, b = a[fits], b[fits]
        for some in range(0, len(a), CANDIDATES):
            x, y = a[some : some + CANDIDATES], b[some : some + CANDIDATES]
            apart = label[x] != label[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if label[i] == label[j]:
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (len(sets[i]) + len(sets[j]) - shared) - SLACK:
                    label[label == label[j]] = label[i]
                    left.append(int(nodes[i]))
                    right.append(int(nodes[j]))
    return left, right


# ---------------------------------------------------------------- tables


def _few_files(df: DataFrame) -> DataFrame:
    """What many tasks found, a few rows each, dealt out to as many files as there are cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


_ODD = [f"odd{i}" for i in range(ODD)]
_LIGHT = ", ".join(f"{c} long" for c in ("k", "node", "root", "fp", "more", "size", *_ODD))


def _searched(keyed: DataFrame, similarity: float, radius: int, most: int = 1 << 62, most_runs: int = 1 << 62, by_segment: bool = False) -> DataFrame:
    """Rows, as ``_LIGHT``, of texts that have a candidate in a group ``k`` that they aren't linked to; those of groups too large for a task as they are, marked ``large``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, large in _groups(batches, most):
            passed = np.full(table.num_rows, large)
            if not large:
                begins, counts = _edges_of(table.column("k").to_numpy())
                runs_of = np.add.reduceat(table.column("size").to_numpy(), begins)
                passed = np.repeat((counts > most) | (runs_of > most_runs) & (counts > 1), counts)
            kept = passed.copy()
            kept[~passed] = candidates(table.filter(pa.array(~passed)), similarity, radius, by_segment)
            out = table.append_column("large", pa.array(passed)).filter(pa.array(kept))
            yield from out.to_batches()

    return written(_few_files(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(run, f"{_LIGHT}, large boolean")), "meeting")


def _dealt(large: DataFrame, group: int, group_runs: int, star: bool) -> DataFrame:
    """Rows of large groups, as ``_LIGHT``, dealt into blocks, where each pair of blocks that is compared is a group.

    As a ``star`` only the first block is compared with all, which links most of a
    cluster and takes twice its rows.  Else all pairs are, but for those of the root
    that most rows of a group have: they are linked to each other.
    """

    def blocks(n: str, size: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(2 * F.col(n) / group), F.ceil(2 * F.col(size) / group_runs)).cast("int")

    roots = large.groupBy("k", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sums = roots.groupBy("k").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "root", "s")).alias("main")).where("roots > 1")
    rest = sums.withColumns({"rest_n": F.expr("n - main.n"), "rest_s": F.expr("s - main.s")})
    counts = rest.select("k", F.col("main.root").alias("main"), blocks("n", "s").alias("all"), blocks("main.n", "main.s").alias("mains"), blocks("rest_n", "rest_s").alias("rests"))
    # Each of these groups has over `group` texts or `group_runs` runs, so there are few.
    rows = large.join(F.broadcast(counts), "k").withColumn("hash", F.xxhash64("node"))
    if star:
        own, others = F.expr("pmod(hash, all)"), F.expr("IF(own = 0, sequence(0, all - 1), array(0))")
    else:
        own = F.expr("IF(root = main, -1 - pmod(hash, mains), pmod(hash, rests))")
        others = F.expr("IF(root = main, sequence(0, rests - 1), sequence(-mains, rests - 1))")
    paired = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(others))
    return paired.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "node", "root", "fp", "more", "size", *_ODD)


def _runs_table(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, runs) of texts whose place is in ``wanted``, and of a few others; ``rows`` have text, node and place."""
    context = rows.sparkSession.sparkContext
    shipped = context.broadcast(bitmap(wanted, "place"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of this task: copies without end go out once
        for batch in batches:
            kept = batch.filter(pa.array(in_bitmap(shipped.value, batch.column("slot").to_numpy())))
            for part in by_bytes(kept, "text"):
                out = []
                for node, text in zip(part.column("node").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if node not in seen:
                        seen.add(node)
                        out.append((node, np.unique(runs(text or "").astype(np.uint32)).astype("<u4").tobytes()))
                columns = list(zip(*out, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["node", "runs"])

    return rows.select("text", "node", slot("place").alias("slot")).mapInArrow(run, "node long, runs binary")


def _verify(similarity: float, radius: int) -> Callable:
    """Over rows (k, node, root, fp, runs) sorted by k: the edges of each group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _groups(batches):
            k, nodes, roots = (table.column(c).to_numpy() for c in ("k", "node", "root"))
            fps = table.column("fp").to_numpy().view(np.uint64)
            found = table.column("runs").combine_chunks() if table.num_rows else None
            left, right = [], []
            for begin, n in zip(*_edges_of(k), strict=True):
                if n > 1 and (roots[begin : begin + n] != roots[begin]).any():
                    sets = [np.frombuffer(found[i].as_buffer(), "<u4") for i in range(begin, begin + n)]
                    a, b = links(nodes[begin : begin + n], roots[begin : begin + n], fps[begin : begin + n], sets, similarity, radius)
                    left += a
                    right += b
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def rooted(nodes: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, group: int = GROUP, group_runs: int = GROUP_RUNS) -> DataFrame | None:
    """Nodes that are linked to others, with ``root``; ``nodes`` have node, fp, more, size, parities, segs and place, ``rows`` have text, node and place."""
    edges = found = None

    def now(rows: DataFrame) -> DataFrame:
        return rows.withColumn("root", F.col("node")) if found is None else rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def link(met: DataFrame) -> None:
        nonlocal edges, found
        if met.isEmpty():
            return
        wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "fp", "place")
        sets = _runs_table(rows, wanted.select("place"))
        about = wanted.select("node", "fp").join(sets.groupBy("node").agg(F.first("runs").alias("runs")), "node")
        sorted_rows = met.join(about, "node").select("k", "node", "root", "fp", "runs").repartition("k").sortWithinPartitions("k")
        new = written(_few_files(sorted_rows.mapInArrow(_verify(similarity, radius), "a long, b long")), "links")
        edges = new if edges is None else edges.union(new)
        found = written(components(edges), "roots")

    for first, last in ROUNDS:
        known = now(nodes.select("node", "fp", "more", "size", *_ODD, "segs"))
        some = known.select("node", "root", "fp", "more", "size", *_ODD, F.posexplode(F.slice("segs", first + 1, last - first)).alias("segment", "s"))
        value = ((F.col("segment") + first) * (1 << BITS) + F.col("s")).cast("long")
        keyed = some.select(value.alias("k"), "node", "root", "fp", "more", "size", *_ODD)
        met = _searched(keyed, similarity, radius, group, group_runs, True)
        link(met.where("NOT large").select("k", "node", "root"))
        large = met.where("large").drop("large")
        if large.isEmpty():
            continue
        for star in (True, False):
            dealt = _dealt(now(large.drop("root")), group, group_runs, star)
            link(_searched(dealt, similarity, radius).select("k", "node", "root"))
    return found


def one_of_each(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    group: int = GROUP,
    group_runs: int = GROUP_RUNS,
) -> DataFrame:
    """The rows of ``df``, all columns, without near duplicates: of each component one row, with the least id.

    The rows are written once, with what the search needs of them, and read again for the choice.
    """
    place, key, bits, others, count, parts = (unused(df, name) for name in ("kept_place", "kept_node", "kept_fp", "kept_more", "kept_size", "kept_segments"))
    odd = [unused(df, f"kept_{c}") for c in _ODD]
    names = df.columns
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in (key, bits, others, count, *odd)), T.StructField(parts, T.ArrayType(T.ShortType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text_col):
                sets = [runs(x or "") for x in part.column(text_col).to_pylist()]
                fps = [fingerprint(x) for x in sets]
                two = np.array([x[:2] for x in fps], np.uint64).reshape(-1, 2).view(np.int64)
                parity = np.array([parities(x) for x in sets], np.uint64).reshape(-1, ODD).view(np.int64)
                cuts = [cut(fp) if len(x) >= 4 else np.zeros(0, np.int16) for fp, x in zip(fps, sets, strict=True)]
                columns = [
                    pa.array([_node(x) for x in sets], pa.int64()),
                    pa.array(two[:, 0]),
                    pa.array(two[:, 1]),
                    pa.array([len(x) for x in sets], pa.int64()),
                    *(pa.array(parity[:, i]) for i in range(ODD)),
                    pa.array(cuts, pa.list_(pa.int16())),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, key, bits, others, count, *odd, parts])

    rows = written(df.mapInArrow(run, schema).withColumn(place, F.monotonically_increasing_id()), "documents")
    plain = rows.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(key).alias("node"), F.col(bits).alias("fp"), F.col(others).alias("more"), F.col(count).alias("size"), *(F.col(c).alias(o) for c, o in zip(odd, _ODD, strict=True)), F.col(parts).alias("segs"), F.col(place).alias("place")
    )
    least = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "place")).alias("least")
    about = [F.first(c).alias(c) for c in ("fp", "more", "size", *_ODD, "segs")]
    # Two different sets share fewer than (smaller set) / (smaller set + 1) of their members.
    fewest = math.ceil(similarity / max(1 - similarity, SLACK) - 1e-6)
    nodes = written(plain.drop("text").groupBy("node").agg(least, *about).withColumn("place", F.col("least.place")), "nodes")
    found = rooted(nodes.where(F.col("size") >= fewest), plain.where(F.col("size") >= fewest), similarity, radius, group, group_runs)
    ends = nodes.select("node", "least")
    if found is not None:
        ends = ends.join(found, "node", "left").withColumn("node", F.coalesce("root", "node"))
    kept = ends.groupBy("node").agg(F.min("least").alias("least")).select(F.col("least.place").alias(place))
    return rows.join(kept, place, "left_semi").select(*names)
