"""The positional index: documents, postings and statistics as DataFrames.

``postings`` has a row for each document, term and column (0: tokens, 1: stems)
with the places in an array and the document's length, so that a term's frequency
is an array's size and scoring needs no join to ``documents``; ``head`` marks one
posting of each document.  Texts stay in
``documents`` and are joined only to the rows of a page.
"""

from __future__ import annotations

import functools
import itertools
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import content_hash, index_tokens, nfkc, run_tokens

TOKENS, STEMS = 0, 1
#: Bytes of text that are cut into terms at once.
SLICE_BYTES = 4 << 20
PARTS = T.StructType(
    [
        T.StructField("branch_id", T.StringType()),
        T.StructField("rowid", T.LongType()),
        T.StructField("recency", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("dl", T.IntegerType()),
        T.StructField("head", T.BooleanType()),
    ]
)


@dataclass
class Index:
    """An index over branches.  ``branches`` is how many there are, where that is known: statistics of few are broadcast."""

    documents: DataFrame
    postings: DataFrame
    stats: DataFrame
    branches: int | None = None

    def cached(self) -> Index:
        """The same index kept in memory, and on disk where that is short.

        Postings are sorted by term within their partitions, so that a query skips
        the batches in which none of its terms can be.  Statistics are taken from
        what is kept, so texts are cut once.
        """
        documents, postings = self.documents.persist(), self.postings.sortWithinPartitions("term").persist()
        return Index(documents, postings, sums(documents, postings).persist(), self.branches)

    def released(self) -> None:
        for part in (self.documents, self.postings, self.stats):
            part.unpersist()

    def save(self, path: str, buckets: int = 64) -> None:
        """Write the index; postings are clustered by term, so that a query reads few row groups."""
        spark = self.documents.sparkSession
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        self.postings.repartitionByRange(buckets, "term").sortWithinPartitions("term", "branch_id", "rowid").write.mode("overwrite").parquet(f"{path}/postings")
        # From what was written, so that texts aren't cut again.
        sums(*(spark.read.parquet(f"{path}/{part}") for part in ("documents", "postings"))).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str, branches: int | None = None) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{part}") for part in ("documents", "postings", "stats")), branches)

    def appended(self, docs: DataFrame) -> Index:
        """The index with further documents, whose ids are new and whose places come after the others.

        Statistics are sums, so the result is what building anew would give.
        """
        more = build(docs, unique_ids=True)
        sums = self.stats.unionByName(more.stats).groupBy("branch_id").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        return Index(self.documents.unionByName(more.documents), self.postings.unionByName(more.postings), sums, self.branches)


def latest_by_id(docs: DataFrame) -> DataFrame:
    """Of each id the row that comes last, at the place (``rowid``) where the id first came."""
    newest = F.max(F.struct(F.col("recency"), F.col("pos"), "role", "ts", "text")).alias("d")
    found = docs.groupBy("branch_id", "id").agg(newest, F.min("pos").alias("rowid"))
    return found.select("branch_id", "rowid", "id", "d.role", "d.ts", "d.recency", "d.text")


def build(docs: DataFrame, unique_ids: bool = False, branches: int | None = None, terms: Callable[[str], list[str]] | None = None) -> Index:
    """An index of rows (branch_id, pos, id, role, ts, text; recency is ``pos`` unless given).

    The latest row of an id wins before empty texts are left out, so a later empty
    edit hides an older text.  ``unique_ids`` says that ids are unique already, which
    spares the shuffle.  ``rowid`` orders documents by first appearance.  Another
    tokenizer gives ``terms``; its index has no stems.
    """
    if "recency" not in docs.columns:
        docs = docs.withColumn("recency", F.col("pos"))
    docs = docs.select("branch_id", "pos", "id", "role", "ts", "recency", F.coalesce("text", F.lit("")).alias("text"))
    one = docs.withColumnRenamed("pos", "rowid").select("branch_id", "rowid", "id", "role", "ts", "recency", "text") if unique_ids else latest_by_id(docs)
    plain = one.mapInArrow(_normalised, one.schema).where("text <> ''")
    documents = plain.withColumn("ts", F.coalesce("ts", F.lit(""))).withColumns({"date": F.substring("ts", 1, 10), "content_hash": content_hash(F.col("text"))})
    postings = plain.select("branch_id", "rowid", "recency", "text").mapInArrow(functools.partial(_postings, terms=terms), PARTS)
    return Index(documents, postings, sums(documents, postings), branches)


def sums(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """Documents (n) and length by branch.

    Each document's first posting is its head, so lengths sum up without a shuffle by
    document; one without terms has length 0.
    """
    lengths = postings.where("head").groupBy("branch_id").agg(F.sum("dl").cast("long").alias("length"))
    counts = documents.groupBy("branch_id").agg(F.count("*").alias("n"))
    return counts.join(lengths, "branch_id", "left").select("branch_id", "n", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def _normalised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at)
        plain = pc.string_is_ascii(texts)
        if pc.all(plain).as_py() is not False:
            yield batch
            continue
        kept = [x if ascii_only else nfkc(x) for x, ascii_only in zip(texts.to_pylist(), plain.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(kept, texts.type) if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)


# Runs of texts without Han, kana and characters on which engines might differ are cut by Arrow.  A piece between
# other characters may begin or end with a dot, which no run does.
_OTHER_SCRIPT = r"[^\x00-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}]"
_BETWEEN = r"[^\p{L}\p{N}\p{M}_$.]+|\.{2,}"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of text; a longer text is a part of its own."""
    held = begin = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


class _Column:
    """Terms of one column as numbers, in the order of documents and places."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []

    def add(self, docs: np.ndarray, terms: np.ndarray) -> None:
        self.docs.append(docs)
        self.terms.append(terms)

    def postings(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and number of places of each posting, all places, and the documents' lengths."""
        none = np.zeros(0, np.int64)
        docs, terms = np.concatenate([none, *self.docs]), np.concatenate([none, *self.terms])
        order = np.argsort(docs, kind="stable")
        docs, terms = docs[order], terms[order]
        lengths = np.bincount(docs, minlength=count)
        places = np.arange(len(docs)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # By document and term, places staying in order.
        keys = docs * (int(terms.max(initial=0)) + 1) + terms
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else none
        sizes = np.diff(np.r_[first, len(keys)])
        return docs[order][first], terms[order][first], sizes, places[order].astype(np.int32), lengths


def _gather(code: np.ndarray, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists of each code one after another, and their sizes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum()))
    firsts, lengths = np.cumsum(sizes) - sizes, sizes[code]
    ends = np.cumsum(lengths)
    at = np.repeat(firsts[code] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], lengths


def _postings(batches: Iterable[pa.RecordBatch], terms: Callable[[str], list[str]] | None = None) -> Iterator[pa.RecordBatch]:
    cut = (lambda text: (terms(text), [])) if terms else None
    for batch in batches:
        for part in _slices(batch):
            yield from _part_postings(part, cut)


def _part_postings(part: pa.RecordBatch, cut: Callable[[str], tuple[list[str], list[str]]] | None = None) -> Iterator[pa.RecordBatch]:
    texts = part.column("text")
    number: dict[str, int] = {}
    named = lambda terms: [number.setdefault(t, len(number)) for t in terms]
    columns = {TOKENS: _Column(), STEMS: _Column()}
    if cut is None:
        other = pc.match_substring_regex(texts, _OTHER_SCRIPT).to_numpy(zero_copy_only=False).astype(bool)
    else:
        other = np.ones(part.num_rows, bool)
    plain = np.flatnonzero(~other)
    pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(texts.take(pa.array(plain)), _BETWEEN, " "))
    # A run that comes often is cut and stemmed once.
    coded = pc.dictionary_encode(pc.ascii_trim(pieces.flatten(), "."))
    runs = [run_tokens(x) for x in coded.dictionary.to_pylist()]
    code, offsets = coded.indices.to_numpy(), pieces.offsets.to_numpy()
    doc = np.repeat(plain, np.diff(offsets))
    for col in (TOKENS, STEMS):
        terms, lengths = _gather(code, [named(r[col]) for r in runs])
        columns[col].add(np.repeat(doc, lengths), terms)
    for row in np.flatnonzero(other).tolist():
        for col, found in zip((TOKENS, STEMS), (cut or index_tokens)(texts[row].as_py()), strict=True):
            columns[col].add(np.full(len(found), row), np.array(named(found), np.int64))
    found = {col: columns[col].postings(part.num_rows) for col in (TOKENS, STEMS)}
    length = sum(found[col][4] for col in (TOKENS, STEMS))
    terms = pa.array(list(number), pa.string())
    for col in (TOKENS, STEMS):
        docs, own, sizes, places, _ = found[col]
        row = pa.array(docs)
        # A document with stems has tokens, so its first token is its head.
        head = np.diff(docs, prepend=-1) > 0 if col == TOKENS else np.zeros(len(docs), bool)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("branch_id").take(row),
                part.column("rowid").take(row),
                part.column("recency").take(row),
                terms.take(pa.array(own)),
                pa.array(np.full(len(docs), col, np.int32)),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(places)),
                pa.array(length[docs].astype(np.int32)),
                pa.array(head),
            ],
            names=PARTS.names,
        )


def vocabulary(index: Index) -> DataFrame:
    """Terms by branch and column with document count and occurrences."""
    return index.postings.groupBy("branch_id", "term", "col").agg(F.count("*").alias("docs"), F.sum(F.size("places")).alias("occurrences"))


def statistics(index: Index) -> DataFrame:
    """One row for the whole: documents, postings, terms and contents."""
    sizes = index.postings.agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))
    return index.documents.agg(F.count("*").alias("documents"), F.count_distinct("content_hash").alias("contents")).crossJoin(sizes)  # one row each


def stored(path: str, spark: SparkSession) -> dict[str, int]:
    """Files and bytes that a saved index takes, by kind of rows."""
    out = {}
    for kind in ("documents", "postings", "stats"):
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        summary = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(target)
        out |= {f"{kind}_files": summary.getFileCount(), f"{kind}_bytes": summary.getLength()}
    return out


def working_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def spread(table: DataFrame) -> DataFrame:
    """A table that is read, dealt out to all cores if its files make fewer tasks; a large one never is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def corpus_documents(table: DataFrame, id_col: str = "doc_id", text_col: str = "text", branch: str = "corpus") -> DataFrame:
    """Rows for :func:`build` from a table of documents with integer ids: one branch, in the order of the ids."""
    return table.select(
        F.lit(branch).alias("branch_id"),
        F.col(id_col).cast("long").alias("pos"),
        F.col(id_col).cast("string").alias("id"),
        F.lit("user").alias("role"),
        F.lit("").alias("ts"),
        F.col(text_col).alias("text"),
    )
