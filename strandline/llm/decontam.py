"""Operator 7: benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer
words, but not none, is one window).  A document word inside any occurrence of a
window is hit.

Each window is the set of its ``SHINGLE``-word shingles with their positions.
Containment must be whole, so by the prefix principle one shingle is enough as
the prefix: the rarest, by the document frequency of its words over all
documents.  Only document shingles that are some window's prefix join; the length
bound (the window's words must fit) and the positional bound (its start follows
from where the prefix stands in it) leave one place each, which is verified word
by word over a window of the item's size.

Frequencies are counted in one pass over the documents into ``CELLS`` cells by word
hash (words that share a cell count together, which may make a prefix less rare but
never loses a window).  Then, by the size of the benchmark:

* up to ``SMALL_BYTES`` of text its windows are broadcast and documents are read once
  more, without any shuffle;
* beyond that windows are a table by prefix.  A bitmap of fixed size tells which
  document shingles may be a prefix; those few go, with the words around them, through
  a shuffle to the table.  Prefixes that very many documents have are dealt over salts.
  Nothing of the benchmark is collected and nothing that grows with it is broadcast.

Null and wordless texts have no words and no hits; such items have no windows, and an
empty benchmark hits nothing.  Items with equal ids count as one in a document's list,
null item ids as none there, but their hits count.  Documents are judged whole, row by
row, repeated ids and rows each by themselves; an empty table gives no rows.  Only id
and text are read, so further columns don't matter.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import Memo, bitmap, by_bytes, in_bitmap, keep_rows, map_text, unused, written

WINDOW = 10
SHINGLE = 5
#: Bytes of benchmark text whose windows are broadcast at most; as Python objects they take some 150 times that.
SMALL_BYTES = 512 << 10
#: Cells in which the document frequency of words is counted.
CELLS = 1 << 20
#: Words of an item that are cut into windows at once, and document places of one prefix that one task verifies.
PART_WORDS = 4_096
SALTED = 50_000
#: A-Z become a-z and what is no word character becomes a space.  Bytes from 0x80 on are parts of word characters.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def cell_of(word: bytes) -> int:
    """The cell that a word's document frequency is counted in."""
    return zlib.crc32(word) & (CELLS - 1)


def prefix_of(words: tuple[bytes, ...], frequency: np.ndarray, shingle: int = SHINGLE) -> tuple[int, int]:
    """Place and size of a window's rarest shingle: by its rarest word, then by the others, then by place."""
    size = min(shingle, len(words))
    rarity = [int(frequency[cell_of(w)]) for w in words]
    return min(range(len(words) - size + 1), key=lambda i: (sorted(rarity[i : i + size]), i)), size


class Block:
    """The windows of some items, by prefix shingle."""

    def __init__(self, items: list[tuple[object, list[bytes]]], frequency: np.ndarray, window: int, shingle: int):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, words in items:
            for found in windows_of(words, window):
                owners[found].add(item)
        self.windows: list[tuple[tuple[bytes, ...], tuple]] = []
        #: rarest word of a prefix shingle -> (words before it, the shingle) -> [(the shingle's place, window)]
        self.prefixes: dict[bytes, dict[tuple[int, tuple[bytes, ...]], list[tuple[int, int]]]] = {}
        for words, items_of in owners.items():
            place, size = prefix_of(words, frequency, shingle)
            prefix = words[place : place + size]
            ahead = min(range(size), key=lambda i: (int(frequency[cell_of(prefix[i])]), i))
            known = self.prefixes.setdefault(prefix[ahead], {}).setdefault((ahead, prefix), [])
            known.append((place, len(self.windows)))
            self.windows.append((words, tuple(items_of)))

    def match(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Mark the words of all occurrences in ``hit`` and add the items to ``items``."""
        prefixes, total = self.prefixes, len(words)
        found = defaultdict(list)  # a window's places
        for at in [i for i, w in enumerate(words) if w in prefixes]:
            for (ahead, prefix), places in prefixes[words[at]].items():
                begin = at - ahead
                if begin < 0 or tuple(words[begin : begin + len(prefix)]) != prefix:
                    continue
                for place, window in places:
                    start = begin - place
                    size = len(self.windows[window][0])
                    if 0 <= start <= total - size and tuple(words[start : start + size]) == self.windows[window][0]:
                        found[window].append(start)
        for window, starts in found.items():
            size = len(self.windows[window][0])
            items.update(x for x in self.windows[window][1] if x is not None)
            for start in starts:
                hit[start : start + size] = True


def frequencies(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", words: frozenset | None = None) -> np.ndarray:
    """In how many rows of ``docs`` a word of each cell stands, for the cells that the benchmark's words have; one pass, counted per task.

    Of a small benchmark all ``words`` are known, and only they are counted.
    """
    context = docs.sparkSession.sparkContext
    if words is not None:
        return _added(docs.select(F.col(text_col).cast("string")).mapInArrow(functools.partial(_count_words, context.broadcast(words)), "cell long, n long"))

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(CELLS, bool)
        for batch in batches:
            for text in batch.column(0):
                own[[cell_of(w) for w in set(words_of(text.as_py() or ""))]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(own))], names=["cell"])

    asked = benchmark.select(F.col(item_text_col).cast("string")).mapInArrow(cells, "cell long").distinct().toArrow()  # CELLS rows at most
    wanted = np.zeros(CELLS, bool)
    wanted[asked.column("cell").to_numpy()] = True
    shipped = context.broadcast(np.packbits(wanted))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.unpackbits(shipped.value).astype(bool), np.zeros(CELLS, np.int64)
        cell = Memo(cell_of)
        for batch in batches:
            for text in batch.column(0):
                own = np.unique(np.fromiter(map(cell.__getitem__, set(words_of(text.as_py() or ""))), np.int64))
                counts[own[known[own]]] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    return _added(docs.select(F.col(text_col).cast("string")).mapInArrow(count, "cell long, n long"))


def _count_words(wanted: Broadcast, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, words = Counter(), wanted.value
    for batch in batches:
        for text in batch.column(0):
            counts.update(words.intersection(words_of(text.as_py() or "")))
    by_cell: Counter = Counter()
    for word, n in counts.items():
        by_cell[cell_of(word)] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(by_cell), pa.int64()), pa.array(list(by_cell.values()), pa.int64())], names=["cell", "n"])


def _added(counted: DataFrame) -> np.ndarray:
    """Counts by cell as one array, of CELLS numbers whatever the input."""
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def matcher(shipped: Broadcast) -> Callable[[list[str]], list[tuple[int, np.ndarray, list]]]:
    """A function from texts to their words, hit words and item ids."""
    block = shipped.value

    def work(texts: list[str]) -> list[tuple[int, np.ndarray, list]]:
        out = []
        for text in texts:
            words = words_of(text)
            hit, items = np.zeros(len(words), bool), set()
            block.match(words, hit, items)
            out.append((len(words), hit, sorted(map(str, items))))
        return out

    return work


def _small(benchmark: DataFrame, item_text_col: str, small_bytes: int) -> bool:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text_col).cast("string"))), F.lit(0))).first()[0]
    return size <= small_bytes


def _block(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, shingle: int) -> Broadcast:
    """The windows of a small benchmark, broadcast."""
    rows = benchmark.select(F.col(item_col), F.col(item_text_col).cast("string")).collect()  # small, as was checked
    items = [(i, words_of(t or "")) for i, t in rows]
    frequency = frequencies(docs, benchmark, text_col, item_text_col, frozenset(w for _, own in items for w in own))
    return docs.sparkSession.sparkContext.broadcast(Block(items, frequency, window, shingle))


# ---------------------------------------------------------------- large benchmarks

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, from the hashes of the words, as signed longs."""
    out = np.full(max(0, len(hashes) - size + 1), size, np.uint64)
    for i in range(size if len(out) else 0):
        out = (out ^ hashes[i : len(hashes) - size + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def window_table(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, shingle: int) -> DataFrame:
    """Rows (item, prefix, size, place, words) of all windows; ``prefix`` is the hash of the rarest shingle, of ``size`` words."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequencies(docs, benchmark, text_col, item_text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shipped.value
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text or "")
                # A long item is cut into overlapping parts, so that no window is lost.
                for begin in range(0, max(1, len(words) - window + 1), PART_WORDS):
                    rows = []
                    for found in windows_of(words[begin : begin + PART_WORDS + window - 1], window):
                        place, size = prefix_of(found, frequency, shingle)
                        hashes = np.array([word_hash(w) for w in found[place : place + size]], np.uint64)
                        rows.append((item, int(shingle_hashes(hashes, size)[0]), size, place, [w.decode("utf-8", "surrogatepass") for w in found]))
                    if rows:
                        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
                        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=["item", "prefix", "size", "place", "words"])

    source = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    return written(source.mapInArrow(run, "item string, prefix long, size int, place int, words array<string>"), "windows")


def _probes(prefix: Column) -> list[Column]:
    """Two slots of a prefix: two parts of its hash."""
    return [prefix.bitwiseAND(F.lit(SLOTS)), F.shiftright(prefix, 24).bitwiseAND(F.lit(SLOTS))]


#: Places of a bitmap, as a mask.
SLOTS = (1 << 24) - 1


def _survivors(texts: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """Rows (row, id, n_words, survivors): of each text (row, id, text) the places that may be a prefix, with the words around."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # as many as a shingle has words
    bits = [bitmap(windows, probe, hashed=True) for probe in _probes(F.col("prefix"))]
    shipped = texts.sparkSession.sparkContext.broadcast(bits)
    item = pa.struct([("begin", pa.int32()), ("size", pa.int32()), ("prefix", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.string()))])

    def of(words: list[bytes], hash_of: Memo) -> list[dict]:
        hashes = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
        out = []
        for size in sizes:
            own = shingle_hashes(hashes, size)
            for begin in np.flatnonzero(in_bitmap(shipped.value[0], own & SLOTS) & in_bitmap(shipped.value[1], own >> 24 & SLOTS)).tolist():
                first = max(0, begin - window + size)
                around = [w.decode("utf-8", "surrogatepass") for w in words[first : begin + window]]
                out.append({"begin": begin, "size": size, "prefix": int(own[begin]), "first": first, "words": around})
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = Memo(word_hash)
        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 20):
                words = [words_of(x or "") for x in part.column("text").to_pylist()]
                columns = [part.column("row"), part.column("id"), pa.array([len(x) for x in words], pa.int64()), pa.array([of(x, hash_of) for x in words], pa.list_(item))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_words", "survivors"])

    struct = "array<struct<begin: int, size: int, prefix: long, first: int, words: array<string>>>"
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", texts.schema["id"].dataType), T.StructField("n_words", T.LongType())])
    schema = schema.add("survivors", T.DataType.fromDDL(struct))
    return written(texts.select("row", "id", "text").mapInArrow(run, schema), "survivors")


def joined(texts: DataFrame, windows: DataFrame, window: int = WINDOW, salted: int = SALTED) -> tuple[DataFrame, DataFrame]:
    """The texts (row, id, n_words), and their occurrences (row, start, end, item) of windows, by a shuffle on prefixes."""
    found = _survivors(texts, windows, window)
    rows = found.select("row", F.inline("survivors"))
    # A prefix that over `salted` places have, and 1/4096 of all, is dealt over salts: 4,096 such at most.
    most = max(salted, rows.count() // 4096)
    hot = rows.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > most).select("prefix", F.ceil(F.col("n") / most).cast("int").alias("salts"))
    hot = F.broadcast(hot)
    dealt = rows.join(hot, "prefix", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row", "begin"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    # Equal windows of many items are one row here; their items join the occurrences afterwards.
    different = windows.select("prefix", "size", "place", "words").withColumn("w", F.xxhash64("words")).dropDuplicates(["w", "prefix", "place"])
    spread = different.join(hot, "prefix", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    spread = spread.select("prefix", "size", "salt", "place", "w", F.col("words").alias("window"))
    start = F.col("begin") - F.col("place")
    # Word by word; what a text has too few words for doesn't fit either.
    fits = (start >= F.col("first")) & (F.slice("words", start - F.col("first") + 1, F.size("window")) == F.col("window"))
    met = dealt.join(spread, ["prefix", "size", "salt"]).where((start >= 0) & (start >= F.col("first"))).where(fits)
    hits = met.select("row", start.alias("start"), (start + F.size("window")).alias("end"), "w").distinct()
    owners = windows.select(F.xxhash64("words").alias("w"), "item").distinct()
    return found.select("row", "id", "n_words"), hits.join(owners, "w").select("row", "start", "end", "item")


def _merged(places: Column) -> Column:
    """Sorted places (start, end) as spans that don't touch."""
    kind = "array<struct<begin: bigint, end: bigint>>"
    begun = F.array().cast(kind)

    def add(spans: Column, x: Column) -> Column:
        last = F.element_at(spans, -1)
        fresh = F.array(F.struct(x["start"].cast("long").alias("begin"), x["end"].cast("long").alias("end")))
        longer = F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"].cast("long")).alias("end")))
        return F.when(F.size(spans) == 0, fresh).when(x["start"] <= last["end"], F.concat(F.slice(spans, 1, F.size(spans) - 1), longer)).otherwise(F.concat(spans, fresh))

    return F.aggregate(F.array_sort(places), begun, add)


def _contamination_by_shuffle(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, window: int, salted: int) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows, hits = joined(texts, windows, window, salted)
    by_row = hits.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("places"), F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.join(by_row, "row", "left")
    none = "array<struct<begin: bigint, end: bigint>>"
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(F.col("places").isNotNull(), _merged(F.col("places"))).otherwise(F.array().cast(none)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


# ---------------------------------------------------------------- documents


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    small_bytes: int = SMALL_BYTES,
    salted: int = SALTED,
) -> DataFrame:
    """Id, ``n_words``, ``spans`` (of hit words: first, and the one after the last) and ``items`` (ids as sorted strings)."""
    if not _small(benchmark, item_text_col, small_bytes):
        windows = window_table(docs, benchmark, text_col, item_col, item_text_col, window, shingle)
        return _contamination_by_shuffle(docs, windows, id_col, text_col, window, salted)
    block = _block(docs, benchmark, text_col, item_col, item_text_col, window, shingle)

    def make() -> Callable:
        judge = matcher(block)

        def work(texts: list[str]) -> list[pa.Array]:
            found = judge(texts)
            spans = []
            for _, hit, _ in found:
                edges = np.flatnonzero(np.diff(np.r_[False, hit, False])).reshape(-1, 2) if hit.any() else []
                spans.append([{"begin": int(a), "end": int(b)} for a, b in edges])
            span = pa.struct([pa.field("begin", pa.int64()), pa.field("end", pa.int64())])
            return [pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, pa.list_(span)), pa.array([i for _, _, i in found], pa.list_(pa.string()))]

        return work

    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    columns = [("n_words", T.LongType()), ("spans", T.ArrayType(span)), ("items", T.ArrayType(T.StringType()))]
    return map_text(docs, make, columns, id_col, text_col)


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The counts and the digest of the item ids that :func:`contamination` finds."""
    found = contamination(docs, benchmark, **options)
    id_col = options.get("id_col", "doc_id")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        id_col,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that no window occurs in."""
    settings = {"item_col": "item_id", "item_text_col": "text", "window": WINDOW, "shingle": SHINGLE} | options
    small_bytes, salted = settings.pop("small_bytes", SMALL_BYTES), settings.pop("salted", SALTED)
    if not _small(benchmark, settings["item_text_col"], small_bytes):
        place = unused(docs, "kept_place")
        rows = written(docs.withColumn(place, F.monotonically_increasing_id()), "documents")
        windows = window_table(rows, benchmark, text_col, **settings)
        texts = rows.select(F.col(place).alias("row"), F.col(place).alias("id"), F.col(text_col).cast("string").alias("text"))
        hit = joined(texts, windows, settings["window"], salted)[1].select(F.col("row").alias(place)).distinct()
        return rows.join(hit, place, "left_anti").select(*docs.columns)
    block = _block(docs, benchmark, text_col, **settings)

    def make() -> Callable:
        judge = matcher(block)
        return lambda texts: [not hit.any() for _, hit, _ in judge([x or "" for x in texts])]

    return keep_rows(docs, make, text_col)
