"""Operator 8: chroma fingerprints of recordings, and their alignment.

A recording is 16-bit mono PCM in a binary column.  Its spectrum, by overlapping
frames, is folded into the twelve pitch classes; an integral image over frames
and classes makes the sum of any rectangle four look-ups.  Sixteen filters, each
a difference of rectangle sums around a place, give two bits each (a Gray code of
four levels), which packed make one 32-bit integer for each place.

Two recordings are aligned by a histogram of offsets over their equal integers; at the
fullest offset, if it has ``VOTES``, the share of differing bits over the overlap
decides.

Searches take a stated set of queries against all recordings, in blocks.  Recordings
with the same integers are one class, however many there are, so copies are compared
once.  The query classes' fingerprints are written to the shared folder by the
executors; each task holds ``HELD_BYTES`` of recordings and reads block after block,
one in memory at a time, in which equal integers are found by binary search.  What
comes of a recording is its best query and a count, so that no pairs are shuffled or
collected, however many recordings are alike.  (An equi-join on integers, or on pairs
of them, makes a row for each of those pairs: where a third of the recordings is
alike, a third of all recordings times a third of the queries.)

:func:`alignments` lists all queries that align with a recording; in :func:`search`
its row has the best one and how many there are.

Null, empty and too short recordings have no integers and align with nothing.  A row
never is its own match; another row is one if it is a query, whatever its id, so two
queries with the same id and sound match each other.  Ties go to more equal integers,
fewer bit errors, the lesser id.  An empty table gives no rows.  Only id and recording
are read, so further columns don't matter.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.llm.common import fresh_path, join_counted, written
from strandline.llm.sstable import _file_system, _uri

RATE = 4_000
FRAME = 1_024
HOP = 128
#: Frames that a filter spans at most.  Half as long a hop as would do for equal cuts: a recording cut
#: between two frames is at most a quarter of a usual hop away from one.
SPAN = 16
LOWEST, HIGHEST = 110.0, 1_760.0
#: A filter's levels are cut at these values of the logarithm of a quotient of sums.
CUTS = (-0.25, 0.0, 0.25)
VOTES = 4
MOST_ERRORS = 0.2
LEAST_OVERLAP = 16
#: Query classes of one block, and bytes of fingerprints that a task holds while it reads all blocks.
BLOCK = 2_048
HELD_BYTES = 32 << 20


def _filters() -> list[tuple[int, int, int, int]]:
    """Kind, first pitch class, classes and frames of the sixteen filters: kinds by turns, growing and moving up."""
    return [(i % 4, i * 5 % 12, 2 + i % 3 * 2, 4 + 4 * (i // 4)) for i in range(16)]


FILTERS = _filters()


def _pitch_classes() -> np.ndarray:
    """The pitch class of each bin of the spectrum; 12 for bins that don't count."""
    frequency = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.full(len(frequency), 12)
    used = (frequency >= LOWEST) & (frequency <= min(HIGHEST, RATE / 2))
    out[used] = np.round(12 * np.log2(frequency[used] / 440.0)).astype(int) % 12
    return out


_FOLD = np.eye(13)[_pitch_classes()][:, :12]
_WINDOW = np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energy by frame, each frame scaled to length one."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(frames), 4096):
        spectrum = np.abs(np.fft.rfft(frames[at : at + 4096] * _WINDOW, axis=1)) ** 2
        out.append(spectrum @ _FOLD)
    rows = np.concatenate(out)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(size > 1e-9, rows / np.maximum(size, 1e-9), 0.0)


def prints(samples: np.ndarray) -> np.ndarray:
    """The packed integers of a recording."""
    rows = chroma(np.asarray(samples, np.float64) / 32768)
    places = len(rows) - SPAN + 1
    if places <= 0:
        return np.zeros(0, np.uint32)
    # Classes twice over, so that a rectangle may go round the octave.
    image = np.zeros((len(rows) + 1, 25))
    image[1:, 1:] = np.concatenate([rows, rows], axis=1).cumsum(0).cumsum(1)
    at = np.arange(places)

    def area(frame: int, frames: int, first: int, classes: int) -> np.ndarray:
        a, b = at + frame, at + frame + frames
        return image[b, first + classes] - image[a, first + classes] - image[b, first] + image[a, first]

    out = np.zeros(places, np.uint32)
    for number, (kind, first, classes, frames) in enumerate(FILTERS):
        half, part = frames // 2, classes // 2
        whole = area(0, frames, first, classes)
        if kind == 0:  # earlier against later
            one = area(0, half, first, classes)
        elif kind == 1:  # lower against higher
            one = area(0, frames, first, part)
        elif kind == 2:  # one diagonal against the other
            one = area(0, half, first, part) + area(half, frames - half, first + part, classes - part)
        else:  # these classes against the others
            one, whole = whole, area(0, frames, 0, 12)
        value = np.log((one + 1e-3) / (np.maximum(whole - one, 0) + 1e-3))
        level = np.digitize(value, CUTS).astype(np.uint32)
        out |= (level ^ (level >> 1)) << np.uint32(2 * number)
    return out


def recording_prints(df: DataFrame, id_col: str = "rec_id", audio_col: str = "audio") -> DataFrame:
    """Id and ``prints`` (binary, little-endian unsigned 32-bit integers) of each recording."""
    source = df.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [prints(np.frombuffer((a := x or b"")[: len(a) // 2 * 2], "<i2")).astype("<u4").tobytes() for x in part.column("audio").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.binary())], names=[id_col, "prints"])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("prints", T.BinaryType())]))


def alignment(own: np.ndarray, theirs: np.ndarray, shift: int) -> float | None:
    """The share of differing bits over the overlap at an offset; None if that is too short or too different."""
    a, b = max(0, shift), min(len(own), len(theirs) + shift)
    if b - a < LEAST_OVERLAP:
        return None
    errors = float(np.bitwise_count(own[a:b] ^ theirs[a - shift : b - shift]).sum()) / (32 * (b - a))
    return errors if errors <= MOST_ERRORS else None


class Block:
    """The postings of some query classes: their integers in order, with class and place; ``rows`` say what belongs to each."""

    def __init__(self, rows: list[dict], prints_of: list[bytes]):
        self.rows = rows
        self.prints = [np.frombuffer(x, "<u4") for x in prints_of]
        sizes = [len(x) for x in self.prints]
        values = np.concatenate([np.zeros(0, np.uint32), *self.prints])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.query = np.repeat(np.arange(len(rows)), sizes)[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in sizes]])[order]

    def aligned(self, own: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Query, offset, equal integers and share of differing bits of each query that aligns."""
        first, last = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        sizes = last - first
        if not sizes.sum():
            return []
        at = np.repeat(first, sizes) + np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
        offset = np.repeat(np.arange(len(own)), sizes) - self.place[at]
        pairs, votes = np.unique(np.stack([self.query[at], offset]), axis=1, return_counts=True)
        enough = votes >= VOTES
        pairs, votes = pairs[:, enough], votes[enough]
        out = []
        # Of each query the fullest offset, of equally full ones the least.
        order = np.lexsort((pairs[1], -votes, pairs[0]))
        queries, begin = np.unique(pairs[0][order], return_index=True)
        for query, row in zip(queries, order[begin]):
            shift, theirs = int(pairs[1, row]), self.prints[query]
            errors = alignment(own, theirs, shift)
            if errors is not None:
                out.append((int(query), shift, int(votes[row]), errors))
        return out


def write_blocks(queries: DataFrame, block: int = BLOCK) -> list[str]:
    """Write query classes, all columns, in blocks; the files' paths."""
    root = _uri(fresh_path(queries.sparkSession, "queries"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            store, folder = _file_system(root)
            store.create_dir(folder, recursive=True)
            name = f"block-{uuid.uuid4().hex}.arrow"
            table = pa.Table.from_batches(held)
            with store.open_output_stream(f"{folder}/{name}") as sink, pa.ipc.new_file(sink, table.schema) as writer:
                writer.write_table(table)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([table.num_rows], pa.int64())], names=["path", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                if sum(x.num_rows for x in held) >= block:
                    yield close()
        if held and sum(x.num_rows for x in held):
            yield close()

    manifest = written(queries.mapInArrow(run, "path string, n long"), "query-blocks")
    return [r["path"] for r in manifest.orderBy("path").collect()]


def read_block(path: str) -> Block:
    store, file = _file_system(path)
    with store.open_input_file(file) as source:
        table = pa.ipc.open_file(io.BytesIO(source.read())).read_all()
    return Block(table.drop_columns(["prints"]).to_pylist(), table.column("prints").to_pylist())


def aligned(classes: DataFrame, paths: list[str], schema: str | T.StructType, fold: Callable[[list[str]], tuple[Callable, Callable]]) -> DataFrame:
    """What ``fold`` makes of the alignments of classes (class, prints) with other classes of the blocks.

    It gets the names of the classes that a task holds and returns two functions: one takes (place
    of the class, the query class's row, offset, equal integers, share of differing bits), block by
    block, and one gives record batches when all is done.
    """

    def held_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], list[np.ndarray]]]:
        names, own, size = [], [], 0
        for batch in batches:
            for name, prints_of in zip(batch.column("class").to_pylist(), batch.column("prints").to_pylist(), strict=True):
                names.append(name)
                own.append(np.frombuffer(prints_of, "<u4"))
                size += len(prints_of)
                if size >= HELD_BYTES:
                    yield names, own
                    names, own, size = [], [], 0
        if names:
            yield names, own

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, own in held_parts(batches):
            take, give = fold(names)
            for path in paths:
                block = read_block(path)
                for place, (name, mine) in enumerate(zip(names, own, strict=True)):
                    for query, shift, votes, errors in block.aligned(mine):
                        if block.rows[query]["class"] != name:
                            take(place, block.rows[query], shift, votes, errors)
            yield from give()

    return classes.select("class", "prints").mapInArrow(run, schema)


def pairs(classes: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Aligned pairs (class, query, offset, votes, bit_errors) of classes and query classes; a class aligns with itself where it lies."""

    def fold(names: list[str]):
        rows: list[tuple] = []

        def give() -> Iterator[pa.RecordBatch]:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            for at in range(0, len(rows), 1 << 16):
                columns = zip(*rows[at : at + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["class", "query", "offset", "votes", "bit_errors"])

        return lambda place, row, shift, votes, errors: rows.append((names[place], row["class"], shift, votes, errors)), give

    found = aligned(classes, write_blocks(queries.select("class", "prints"), block), "class string, query string, offset long, votes long, bit_errors double", fold)
    return found.unionByName(_with_itself(queries).select("class", F.col("class").alias("query"), F.lit(0).cast("long").alias("offset"), "votes", F.lit(0.0).alias("bit_errors")))


def _with_itself(queries: DataFrame) -> DataFrame:
    """Query classes that align with themselves, with ``votes``: all of their integers, where they lie."""
    size = F.floor(F.length("prints") / 4).cast("long")
    return queries.where(size >= max(VOTES, LEAST_OVERLAP)).withColumn("votes", size)


def _classes(found: DataFrame, is_query: Column, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, row, class, query), classes (class, prints, n) and query classes (class, prints, ids: the least two queries, queries)."""
    name = F.when(F.length("prints") > 0, F.concat(F.md5("prints"), F.length("prints").cast("string")))
    rows = found.select(F.col(id_col).alias("id"), "prints", name.alias("class"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "recordings")
    some = rows.where("class IS NOT NULL")
    classes = written(some.groupBy("class").agg(F.first("prints").alias("prints"), F.count("*").alias("n")), "classes")
    asked = some.where("query")
    # The two least queries of a class, by two minima, so that nothing is listed.
    key = F.struct("id", "row")
    least = asked.groupBy("class").agg(F.min(key).alias("one"), F.count("*").alias("queries"))
    second = join_counted(asked, least, "class", "queries", asked.count()).where(key > F.col("one")).groupBy("class").agg(F.min(key).alias("two"))
    queries = least.join(second, "class", "left").join(classes.select("class", "prints"), "class")
    return rows, classes, written(queries, "queries")


def search(found: DataFrame, is_query: Column, id_col: str = "rec_id", block: int = BLOCK) -> DataFrame:
    """All rows of ``found`` (id, prints) with the first of their :func:`alignments`, and ``n_matches``."""
    rows, classes, queries = _classes(found, is_query, id_col)
    id_type = found.schema[id_col].dataType
    best_of = [("class", T.StringType()), ("v", T.LongType()), ("e", T.DoubleType()), ("id", id_type), ("o", T.LongType()), ("matches", T.LongType())]

    def fold(names: list[str]):
        best: list[tuple | None] = [None] * len(names)
        count = [0] * len(names)

        def take(place: int, row: dict, shift: int, votes: int, errors: float) -> None:
            count[place] += row["queries"]
            rank = (-votes, errors, row["id"] is None, row["id"] if row["id"] is not None else 0, shift)
            if best[place] is None or rank < best[place]:
                best[place] = rank

        def give() -> Iterator[pa.RecordBatch]:
            some = [i for i, x in enumerate(best) if x]
            kind = T.StructType([T.StructField("id", id_type)])
            ids = pa.array([None if best[i][2] else best[i][3] for i in some], to_arrow_schema(kind).field(0).type)
            columns = [pa.array([names[i] for i in some], pa.string()), pa.array([best[i][0] for i in some], pa.int64()), pa.array([best[i][1] for i in some], pa.float64()), ids]
            columns += [pa.array([best[i][4] for i in some], pa.int64()), pa.array([count[i] for i in some], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in best_of])

        return take, give

    asked = queries.select("class", "prints", F.col("one.id").alias("id"), "queries")
    other = aligned(classes, write_blocks(asked, block), T.StructType([T.StructField(n, t) for n, t in best_of]), fold)
    other = written(other.select("class", "matches", F.struct("v", "e", F.col("id").isNull().alias("nameless"), "id", "o").alias("other")), "matches")
    rank = lambda who: F.struct((-F.col("votes")).alias("v"), F.lit(0.0).alias("e"), who["id"].isNull().alias("nameless"), who["id"].alias("id"), F.lit(0).cast("long").alias("o"))
    # Of a row's own class it has to leave itself out: for the least query the second one stands in.
    itself = _with_itself(queries).select(
        "class", rank(F.col("one")).alias("own"), F.when(F.col("two").isNotNull(), rank(F.col("two"))).alias("next"), F.col("one.row").alias("least_row"), "queries"
    )
    best = classes.select("class", "n").join(other, "class", "left").join(itself, "class", "left").where("other IS NOT NULL OR own IS NOT NULL")
    kept = rows.where("class IS NOT NULL").select("row", "class", "query")
    with_best = join_counted(kept, best, "class", "n", kept.count())
    in_own = F.when(F.col("row") == F.col("least_row"), F.col("next")).otherwise(F.col("own"))
    matched = with_best.withColumn("best", F.least(F.col("other"), in_own)).withColumn("itself", (F.col("query") & F.col("own").isNotNull()).cast("long"))
    many = F.coalesce("matches", F.lit(0)) + F.coalesce("queries", F.lit(0)) - F.col("itself")
    hit = matched.select("row", F.col("best.id").alias("match_id"), F.col("best.o").alias("offset"), (-F.col("best.v")).alias("votes"), F.col("best.e").alias("bit_errors"), many.alias("n_matches"))
    every = rows.select("id", "row", F.floor(F.coalesce(F.length("prints"), F.lit(0)) / 4).cast("long").alias("n_prints"))
    out = every.join(hit, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_prints", "match_id", "offset", "votes", "bit_errors", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"))


def alignments(found: DataFrame, is_query: Column, id_col: str = "rec_id", block: int = BLOCK) -> DataFrame:
    """All rows of ``found`` (id, prints) with ``matches``: every query that aligns, with offset, votes and bit errors, the best first.

    This expands copies: a row lists each query of a class.  :func:`search` doesn't.
    """
    rows, classes, queries = _classes(found, is_query, id_col)
    found_pairs = pairs(classes, queries, block)
    asked = rows.where("query AND class IS NOT NULL").select(F.col("class").alias("query"), F.col("id").alias("match_id"), F.col("row").alias("match_row"))
    mine = rows.where("class IS NOT NULL").select("row", "class")
    listed = mine.join(found_pairs, "class").join(asked, "query").where("row <> match_row")
    item = F.struct(
        (-F.col("votes")).alias("v"), F.col("bit_errors").alias("e"), F.col("match_id").isNull().alias("nameless"),
        F.struct("match_id", "offset", "votes", "bit_errors").alias("m"),
    )
    lists = listed.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["m"]).alias("matches"))
    every = rows.select("id", "row", F.floor(F.coalesce(F.length("prints"), F.lit(0)) / 4).cast("long").alias("n_prints"))
    out = every.join(lists, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_prints", F.coalesce("matches", F.array().cast(lists.schema["matches"].dataType)).alias("matches"))


# ---------------------------------------------------------------- recordings for tests


def melody(values: np.ndarray, seconds: float = 0.064) -> np.ndarray:
    """A recording of a vector: a note for each value, whose pitch class is the value's place among equal shares."""
    values = np.nan_to_num(np.asarray(values, np.float64))
    if not len(values):
        return np.zeros(0, np.int16)
    spread = values.std() or 1.0
    # A value's rank under the normal curve, in twelve steps.
    steps = np.clip((12 * 0.5 * (1 + np.tanh(0.8 * (values - values.mean()) / spread))).astype(int), 0, 11)
    time = np.arange(int(RATE * seconds)) / RATE
    notes = 8_000 * np.sin(2 * np.pi * 220.0 * 2 ** (np.arange(12)[:, None] / 12) * time) * np.hanning(len(time)) ** 0.5
    return notes[steps].reshape(-1).astype(np.int16)


def melodies(df: DataFrame, id_col: str = "vec_id", values_col: str = "embedding", out_col: str = "audio") -> DataFrame:
    """Id and a recording (binary PCM) of each vector."""
    source = df.select(F.col(id_col).alias("id"), F.col(values_col).cast("array<double>").alias("values"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                audio = [melody(np.array([v if v is not None else 0.0 for v in x or []])).astype("<i2").tobytes() for x in part.column("values").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(audio, pa.binary())], names=[id_col, out_col])

    return source.mapInArrow(run, T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField(out_col, T.BinaryType())]))


def matches(df: DataFrame, id_col: str = "rec_id", audio_col: str = "audio", every: int = 20, block: int = BLOCK) -> DataFrame:
    """Search all recordings with those whose id is divisible by ``every``."""
    out = search(recording_prints(df, id_col, audio_col), F.col(id_col) % every == 0, id_col, block)
    return out.withColumn("bit_errors", F.round("bit_errors", 6))
