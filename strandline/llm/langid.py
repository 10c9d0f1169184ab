"""Operator 4: language identification with string kernels.

The kernel of two texts is the number of character n-grams (n from 1 to
``ORDERS``, blended) that are present in both, divided by the root of the product
of how many each has: a presence kernel, so how often an n-gram occurs doesn't
matter.  Nyström features come from landmark texts, and one kernel ridge
regression per language (one against the rest) is fitted to them.

Every n-gram of every landmark is a feature and every n-gram of a text counts for
its size; none is left out or merged.  Since a text's regression values are linear
in its presence vector, landmarks, Nyström map and ridge weights are multiplied
out once into a matrix of n-grams by languages, and a batch of texts is scored by
the product of its sparse presence matrix with that.

The score is the softmax share of the language times the share of the text's
n-grams that any landmark has.  So a text in a script or language that nothing was
learned of has a score near 0, whatever language comes out best;
:func:`known_language` rejects those below a limit found on the labelled rows.

Everything else looks at whole texts; only the fit takes a bounded sample:
``SAMPLE_ROWS`` different labelled texts and ``SAMPLE_CHARS`` characters at most,
in the order of a hash of the text, spread over the languages.

A text without letters, or null, is ``und`` with score 0; so is every text where
nothing could be learned (no labelled rows, or an empty table).  Ties go to the
language that sorts first.  Repeated rows and ids are each judged; copies of a text
are learned from once.  n-grams are taken from the lower-cased text, with each
character that isn't a letter as a space.  Only id, text and language are read, so
further columns don't matter.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import keep_rows, map_text

ORDERS = 3
LANDMARKS = 240
SAMPLE_ROWS = 4_000
SAMPLE_CHARS = 24_000_000
LANDMARK_CHARS = 3_000
RIDGE = 1e-3
UNKNOWN = "und"
#: Characters of the texts that one product of a presence matrix scores, about, and characters of a text that are cut at once.
BATCH_CHARS = 1 << 19
#: Cells of the dense presence matrices that the fit multiplies.
DENSE_CELLS = 1 << 23
PIECE = 1 << 20
#: A text is rejected below this part of the score that all but ``LEAST_SHARE`` of the labelled sample reach.
LEAST_SHARE, LEAST_PART = 0.002, 0.5


@functools.cache
def _letter_codes() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    return np.array([p if chr(p).isalpha() else 0x20 for p in range(0x110000)], np.int64)


def grams(text: str) -> np.ndarray:
    """The different n-grams of a text, in order: their code points side by side, none of which is 0."""
    low = f" {text.lower()} "
    out = []
    for at in range(0, max(1, len(low) - ORDERS + 1), PIECE):
        codes = _letter_codes()[np.frombuffer(low[at : at + PIECE + ORDERS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)]
        found, longer = [codes], codes
        for order in range(1, ORDERS):
            longer = longer[:-1] | codes[order:] << (21 * order)
            found.append(longer)
        out.append(np.unique(np.concatenate(found)))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


class Presence:
    """Texts as rows of a sparse matrix over some n-grams: columns that are present, row by row, and sizes."""

    def __init__(self, texts: list[str], keys: np.ndarray):
        columns, self.sizes = [], np.zeros(len(texts), np.int64)
        for row, text in enumerate(texts):
            own = grams(text)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            columns.append(at[keys[at] == own])
            self.sizes[row] = len(own)
        self.known = np.array([len(x) for x in columns], np.int64)
        self.columns = np.concatenate(columns) if columns else np.zeros(0, np.int64)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The product with a matrix that has a row for each n-gram."""
        out = np.zeros((len(self.sizes), matrix.shape[1]))
        some = np.flatnonzero(self.known)
        if len(some):
            begins = np.cumsum(self.known[some]) - self.known[some]
            out[some] = np.add.reduceat(matrix[self.columns], begins, axis=0, dtype=np.float64)
        return out


def _batches(texts: list[str]) -> list[tuple[int, int]]:
    """Ranges of texts with about ``BATCH_CHARS`` characters, one text at least."""
    out, begin, held = [], 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > BATCH_CHARS:
            out.append((begin, i))
            begin, held = i, 0
        held += len(text)
    return [*out, (begin, len(texts))] if texts else []


class Kernel:
    """A fitted classifier: plain arrays, so that it is broadcast as it is."""

    def __init__(self, landmarks: list[str]):
        present = [grams(x) for x in landmarks]
        self.keys = np.unique(np.concatenate(present))
        self.marks = np.zeros((len(self.keys), len(landmarks)), np.uint8)
        for number, own in enumerate(present):
            self.marks[np.searchsorted(self.keys, own), number] = 1
        self.mark_sizes = np.array([len(x) for x in present], np.float64)

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values of texts (rows) and landmarks (columns)."""
        out = np.zeros((len(texts), len(self.mark_sizes)))
        marks = self.marks.astype(np.float32)
        step = max(1, DENSE_CELLS // len(self.keys))
        for at in range(0, len(texts), step):
            rows = Presence(texts[at : at + step], self.keys)
            dense = np.zeros((len(rows.sizes), len(self.keys)), np.float32)
            dense[np.repeat(np.arange(len(rows.sizes)), rows.known), rows.columns] = 1
            out[at : at + step] = dense @ marks / np.sqrt(rows.sizes[:, None] * self.mark_sizes)
        return out

    def fit(self, texts: list[str], languages: list[str], landmarks: list[str]) -> Kernel:
        self.languages = sorted(set(languages))
        values, vectors = np.linalg.eigh(self.kernel(landmarks))
        kept = values > 1e-6 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])  # the Nyström map
        features = self.kernel(texts) @ root
        target = np.array([[1.0 if x == y else -1.0 for y in self.languages] for x in languages])
        mean = target.mean(0)
        weights = np.linalg.solve(features.T @ features + RIDGE * len(texts) * np.eye(features.shape[1]), features.T @ (target - mean))
        self.bias = mean
        # n-grams by languages: what a landmark weighs, for each n-gram that it has.
        weighed = (root @ weights) / np.sqrt(self.mark_sizes)[:, None]
        self.weights = np.concatenate([self.marks[at : at + 65_536] @ weighed for at in range(0, len(self.keys), 65_536)])
        del self.marks  # only the fit needs it
        scores = np.array(self.predict(texts)[1])
        self.least = LEAST_PART * float(np.quantile(scores, LEAST_SHARE))
        return self

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Regression values by language (targets are 1 and -1), and the share of each text's n-grams that landmarks have."""
        values, known = [], []
        for begin, end in _batches(texts):
            rows = Presence(texts[begin:end], self.keys)
            values.append(rows.times(self.weights) / np.sqrt(rows.sizes)[:, None] + self.bias)
            known.append(rows.known / rows.sizes)
        return np.concatenate(values), np.concatenate(known)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, x in enumerate(texts) if x and _letters().search(x)]
        if rows:
            values, known = self.values([texts[i] for i in rows])
            powers = np.exp(np.clip(4 * values, -40, 40))
            shares = powers / powers.sum(1, keepdims=True)
            for i, best, score in zip(rows, shares.argmax(1), shares.max(1) * known, strict=True):
                languages[i], scores[i] = self.languages[best], float(score)
        return languages, scores


@functools.cache
def _letters():
    import regex

    return regex.compile(r"\p{L}")


def sample(docs: DataFrame, rows: int, chars: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Texts and languages of a bounded sample: as many of each language as the bounds allow, in hash order.

    Texts are drawn by a hash of themselves and copies count as one, so that an id
    or a text that holds most of the rows neither fills the sample nor starves it.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    named = labelled.select(F.col(lang_col).alias("g"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    counted = {r["g"]: r["n"] for r in named.groupBy("g").agg(F.approx_count_distinct("h").alias("n")).toLocalIterator()}
    if not counted:
        return []
    share = max(1, rows // len(counted))
    # A threshold on the hash keeps about twice the share of each language.
    most = F.create_map(*[x for g, n in counted.items() for x in (F.lit(g), F.lit(min(1.0, 2 * share / max(1, n))))])
    near = named.where((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) <= most[F.col("g")])
    sizes = near.groupBy("g", "h").agg(F.max(F.length("t")).alias("n"))
    chosen, taken, held = [], dict.fromkeys(counted, 0), dict.fromkeys(counted, 0)
    for r in sizes.orderBy("h", "g").limit(8 * rows).collect():
        if taken[r["g"]] < share and held[r["g"]] + r["n"] <= chars // len(counted):
            taken[r["g"]] += 1
            held[r["g"]] += r["n"]
            chosen.append((r["g"], r["h"]))
    if not chosen:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "g string, h long"))  # as many rows as the bound
    texts = near.join(wanted, ["g", "h"]).groupBy("g", "h").agg(F.first("t").alias("t"))
    found = sorted((r["h"], r["g"], r["t"]) for r in texts.limit(rows + len(counted)).collect())
    return [(t, g) for _, g, t in found if _letters().search(t)]


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
    landmarks: int = LANDMARKS,
) -> Kernel | None:
    """A classifier from labelled rows of the training fold, crc32(id) mod 3 other than 1."""
    labelled = sample(docs, rows, chars, id_col, text_col, lang_col)
    return fit(labelled, landmarks)


def fit(labelled: list[tuple[str, str]], landmarks: int = LANDMARKS) -> Kernel | None:
    """A classifier from (text, language) pairs; landmarks are dealt evenly to the languages."""
    if not labelled:
        return None
    texts, languages = [x for x, _ in labelled], [y for _, y in labelled]
    marks = []
    for language in sorted(set(languages)):
        own = sorted((x for x, y in labelled if y == language), key=lambda x: abs(len(x) - LANDMARK_CHARS))
        marks += own[: max(1, landmarks // len(set(languages)))]
    return Kernel(marks).fit(texts, languages, marks)


def languages(df: DataFrame, model: Kernel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``lang_pred`` and ``score`` of each row."""
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make() -> Callable:
        kernel = pickle.loads(shipped.value)

        def work(texts: list[str]) -> list[pa.Array]:
            found, scores = kernel.predict(texts) if kernel else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

        return work

    return map_text(df, make, [("lang_pred", T.StringType()), ("score", T.DoubleType())], id_col, text_col)


def known_language(df: DataFrame, model: Kernel | None, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that are in a learned language: with a score of ``least`` or more.

    Unless told, ``least`` is the model's own, from its labelled sample.  Without a
    model nothing is known of any language and all rows with a letter stay.
    """
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make() -> Callable:
        kernel = pickle.loads(shipped.value)

        def work(texts: list[str | None]) -> list[bool]:
            if kernel is None:
                return [bool(x and _letters().search(x)) for x in texts]
            limit = kernel.least if least is None else least
            found, scores = kernel.predict([x or "" for x in texts])
            return [x != UNKNOWN and s >= limit for x, s in zip(found, scores, strict=True)]

        return work

    return keep_rows(df, make, text_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row is outside the training fold."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3).eqNullSafe(1)


def predictions(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Id, ``held_out``, ``lang_pred`` and ``score`` of each row, learned from the training fold."""
    found = languages(docs, train(docs, id_col=id_col, **options), id_col, options.get("text_col", "text"))
    return found.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
