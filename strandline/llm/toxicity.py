"""Operator 9: toxicity by a weighted lexicon over folded text.

Text is folded character by character: upper case, wide and styled letters, letters
with marks, letters of other scripts that look like Latin ones, and digits or signs
put for letters become the plain letter; marks of their own, format characters
(such as zero-width spaces) and the signs between spelled-out letters (``i-d-i-o-t``)
are dropped; what else is no letter becomes a space.  Where characters were dropped a
table leads from folded places back to those of the text.  One Aho-Corasick automaton
finds the entries of the lexicon at the beginnings of words (a stem, with whatever
ending) or as whole words, and the exception phrases that void an entry inside them.
Of the characters of a matched word a third have to be letters in the original, so
that a number isn't read as a word.

The evidence of a text is the sum of the weights of its matches; the score is a
logistic function of the evidence and of the evidence by length.

Entries are a small list of insults and what the labelled rows teach: stems and
words that toxic rows have far more often than clean ones, weighted by log odds.
The fit takes a bounded sample of the training fold, ``SAMPLE_ROWS`` different
labelled texts and ``SAMPLE_CHARS`` characters; the sample is written to the shared
folder, and entries and evidence are counted by the executors.  Every text is scored
whole.

Null and empty texts have no evidence and get the score of that, and so do texts of
an empty table's kind: without labels the list and its prior weights judge alone.
Labels that are null are left out; a document labelled twice is toxic if one label
says so.  Repeated rows and ids are each scored, and copies of a text are learned
from once.  Only id, text and label are read, so further columns don't matter.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import dropped, keep_rows, map_text, written

SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 24_000_000
#: An entry is learned from this many toxic rows at least, if they have it this many times as often as clean rows.
SUPPORT = 5
LIFT = 10.0
STEMS = range(4, 9)
SEED_WEIGHT = 4.0
#: What is known before any label: bias, weight of the evidence, weight of the evidence by length.
PRIOR = (-3.0, 1.5, 1.0)

# Insults, phrases in which such a word insults nobody, and characters put for letters.
INSULTS = (
    "idiot idiots idiotic moron morons moronic imbecile imbeciles stupid stupidity dumbass loser losers pathetic worthless "
    "scum scumbag scumbags trash clown clowns disgusting bastard bastards bitch bitches asshole assholes shithead "
    "fuck fucking fucker fuckers motherfucker cunt whore slut retard retarded douchebag jackass dipshit wanker"
)
EXCEPTIONS = (
    "clown fish", "clown car", "class clown", "rodeo clown", "circus clown", "trash can", "trash cans", "trash bin", "trash bag",
    "trash bags", "trash collection", "trash compactor", "pathetic fallacy", "pond scum", "soap scum", "sore loser rule",
    "stupid question", "fire retarded", "flame retarded",
)
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ո": "n", "ս": "u", "օ": "o",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


#: What a dropped character becomes before it is taken out.
DROPPED = "\0"
#: Signs that stand for a letter only inside a word, and letters spelled out with a sign between any two.
_INNER = re.compile(r"(?<=\w)[!|](?=\w)")
_HINT = re.compile(r"([-._*~])\w\1\w")
_SPELLED = re.compile(r"(?<!\w)\w([-._*~])\w(?:\1\w)+(?!\w)")


class _Folding(dict):
    """A table for str.translate that works a character out when it first comes."""

    def __missing__(self, point: int) -> int:
        char = chr(point)
        if unicodedata.category(char) in ("Mn", "Me", "Cf"):
            self[point] = ord(DROPPED)
            return self[point]
        bare = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.category(c).startswith("M"))
        plain = next((x for x in (bare.lower(), char.lower()) if len(x) == 1), char)
        plain = LOOKALIKES.get(plain, DIGITS.get(plain, plain))
        self[point] = ord(plain) if plain.isalpha() else 32
        return self[point]


_TABLE = _Folding()


def _folded(text: str) -> tuple[str, np.ndarray | None]:
    """The folded text, and for each of its characters the place in the text if characters were dropped."""
    if "!" in text or "|" in text:
        text = _INNER.sub("i", text)
    out = text.translate(_TABLE)
    spelled = [m.start() + i for m in _SPELLED.finditer(text) for i in range(1, m.end() - m.start(), 2)] if _HINT.search(text) else []
    if not spelled and DROPPED not in out:
        return out, None
    points = np.frombuffer(out.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = points != ord(DROPPED)
    kept[spelled] = False
    return points[kept].tobytes().decode("utf-32-le", "surrogatepass"), np.flatnonzero(kept)


def fold(text: str) -> str:
    """The folded text."""
    return _folded(text)[0]


def _entries_of(folded: str) -> set[str]:
    """Stems and whole words of a folded text, as the lexicon writes them: ' stem' and ' word '."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if len(word) >= n)
    return out


class Lexicon:
    """Entries with weights, and the function from evidence to score."""

    def __init__(self, weights: dict[str, float], parameters: tuple[float, float, float] = PRIOR):
        self.weights, self.parameters = weights, parameters

    @functools.cached_property
    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            out.add_word(entry, (len(entry), weight))
        for phrase in EXCEPTIONS:
            out.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        out.make_automaton()
        return out

    def __getstate__(self):
        return {"weights": self.weights, "parameters": self.parameters}

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """Beginning, end and weight of the heaviest entry at each word that has one."""
        best: dict[int, tuple[int, float]] = {}
        voided = []
        plain, places = _folded(text)
        folded = f" {plain} "
        for end, (size, weight) in self.automaton.iter(folded):
            begin = end - size + 1  # of the blank before the word, that is the word's place
            if weight == 0.0:
                voided.append((begin, end))
            elif weight > best.get(begin, (0, 0.0))[1]:
                best[begin] = (end, weight)
        out = []
        for begin, (end, weight) in sorted(best.items()):
            if any(a <= begin and end <= b for a, b in voided):
                continue
            last = folded.index(" ", begin + 1) - 2  # of the word
            until = min(end - 1, last)  # of the match
            at = range(begin, last + 1) if places is None else places[begin : last + 1]
            if 3 * sum(text[i].isalpha() for i in at) >= len(at):
                out.append((int(at[0]), int(at[until - begin]) + 1, weight))
        return out

    def features(self, text: str) -> tuple[float, float]:
        found = self.matches(text)
        if not found:
            return 0.0, 0.0
        evidence = sum(weight for _, _, weight in found)
        return math.log1p(evidence), math.log1p(100 * evidence / (20 + len(text.split())))

    def score(self, text: str) -> float:
        bias, by_evidence, by_length = self.parameters
        evidence, rate = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + by_evidence * evidence + by_length * rate))))


class Counted:
    """In how many rows of each half of the sample, toxic and clean, each entry stands: two numbers by label and half."""

    def __init__(self, rows: np.ndarray, entries: dict[str, np.ndarray]):
        self.rows, self.entries = rows, entries

    def learned(self, halves: tuple[int, ...] = (0, 1)) -> dict[str, float]:
        """Entries that toxic rows of these halves have far more often than clean rows, and their log odds."""
        clean, toxic = (int(self.rows[label, list(halves)].sum()) for label in (0, 1))
        if not toxic or not clean:
            return {}
        out = {}
        for entry, counts in self.entries.items():
            seldom, often = (int(counts[label, list(halves)].sum()) for label in (0, 1))
            if often >= SUPPORT and often / toxic >= LIFT * (seldom + 1) / clean:
                out[entry] = math.log((often + 0.5) / (toxic + 1)) - math.log((seldom + 0.5) / (clean + 1))
        return out


def _lexicon(learned: dict[str, float]) -> dict[str, float]:
    """Learned entries and the list, without those that a stem of theirs outweighs."""
    weights = dict(learned)
    for word in INSULTS.split():
        weights[f" {word} "] = max(SEED_WEIGHT, weights.get(f" {word} ", 0.0))
    kept = {}
    for entry in sorted(weights, key=lambda x: (-weights[x], x)):
        word = entry.rstrip()
        if weights[entry] > max((weights.get(word[: n + 1], 0.0) for n in STEMS if n + 1 < len(entry)), default=0.0):
            kept[entry] = weights[entry]
    return kept


def _logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Bias and weights by Newton steps, drawn towards the prior."""
    design = np.c_[np.ones(len(rows)), rows]
    prior = np.array(PRIOR)
    weights, pull = prior.copy(), np.diag([0.5, 2.0, 2.0])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (chance - labels) + pull @ (weights - prior)
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + pull
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(x) for x in weights)


def signature(text: str) -> tuple[int, int]:
    """The two least hashes of a text's runs of five words, as signed longs; the same twice if there is one."""
    import xxhash

    words = text.lower().split()
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 4))}
    least = sorted(hashes)[:2]
    return tuple(int(x) for x in np.array([least[0], least[-1]], np.uint64).view(np.int64))


def halves_of(rows: Iterable[tuple[object, int, tuple[int, int]]]) -> dict[object, tuple[int, int]]:
    """Label and half of the rows (key, label, signature) that stay, in their order: of copies, which share a hash, the first."""
    seen, out = set(), {}
    for key, label, hashes in rows:
        if not seen & set(hashes):
            out[key] = (label, len(out) % 2)
        seen.update(hashes)
    return out


def _rows_of(halves: dict[object, tuple[int, int]]) -> np.ndarray:
    out = np.zeros((2, 2), np.int64)
    for label, half in halves.values():
        out[label, half] += 1
    return out


def _parameters(lexicons: list[Lexicon], features: Iterable[tuple[float, float, int]]) -> tuple[float, float, float]:
    """The score's parameters from the evidence of each half by the other half's entries."""
    rows = list(features)
    if len({y for _, _, y in rows}) < 2 or len(rows) < 40:
        return PRIOR
    return _logistic(np.array([r[:2] for r in rows]), np.array([r[2] for r in rows], float))


def fit(labelled: Iterable[tuple[str, int]]) -> Lexicon:
    """A lexicon from (text, label) pairs, in one process; :func:`train` does the same with the executors.

    The score's parameters come from two halves, each scored with the entries
    that the other half taught, so that they don't trust what was learned by heart.
    """
    rows = list(labelled)
    halves = halves_of((i, y, signature(text)) for i, (text, y) in enumerate(rows))
    counts: dict[str, np.ndarray] = {}
    for i, (label, half) in halves.items():
        for entry in _entries_of(fold(rows[i][0])):
            counts.setdefault(entry, np.zeros((2, 2), np.int64))[label, half] += 1
    counted = Counted(_rows_of(halves), counts)
    taught = [Lexicon(_lexicon(counted.learned((1 - half,)))) for half in (0, 1)]
    features = [(*taught[half].features(rows[i][0]), label) for i, (label, half) in halves.items()]
    return Lexicon(_lexicon(counted.learned()), _parameters(taught, features))


def _hashed(column: str):
    return F.xxhash64(F.col(column).cast("string"))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, chars: int) -> DataFrame | None:
    """A written table (h, y, t) of different labelled texts of the training fold, within both bounds, in the order of a hash of the id."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    named = named.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    # The sample has `rows` rows at most, so it may be broadcast.
    some = F.broadcast(named.orderBy(_hashed("i"), "i").limit(rows))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL").join(some, "i")
    sizes = texts.groupBy(_hashed("i").alias("o"), F.xxhash64("t").alias("h"), "y").agg(F.max(F.length("t")).alias("n")).orderBy("o", "h", "y").limit(2 * rows)
    chosen, held = {}, 0
    for r in sizes.collect():
        key = (r["h"], r["y"])
        if key not in chosen and len(chosen) < rows and held + r["n"] <= chars:
            held += r["n"]
            chosen[key] = len(chosen)
    if not chosen:
        return None
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(h, y, at) for (h, y), at in chosen.items()], "h long, y int, place int"))
    found = texts.withColumn("h", F.xxhash64("t")).join(wanted, ["h", "y"]).groupBy("place", "y").agg(F.first("t").alias("t"))
    return written(found.repartition(spark.sparkContext.defaultParallelism), "labelled")


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> Lexicon:
    """A lexicon from labelled rows of the training fold, crc32(id) mod 5 other than 0, in the order of a hash of the id.

    What comes to the driver is a few numbers for each row of the sample, and the
    entries that ``SUPPORT`` toxic rows have.
    """
    table = sample(docs, labels, id_col, text_col, label_col, rows, chars)
    if table is None:
        return fit([])
    context = docs.sparkSession.sparkContext

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signature(x) for x in batch.column("t").to_pylist()]
            columns = [batch.column("place"), batch.column("y"), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "y", "a", "b"])

    places = sorted(tuple(r) for r in table.mapInArrow(signed, "place int, y int, a long, b long").collect())
    halves = halves_of((place, y, (a, b)) for place, y, a, b in places)

    def entries(known: frozenset | None) -> Callable:
        """Rows (entry, label, half), counted by task: of toxic rows, or of clean rows those that are known."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for place, text in zip(batch.column("place").to_pylist(), batch.column("t").to_pylist(), strict=True):
                    label, half = halves.get(place, (None, None))
                    if label == (0 if known is not None else 1):
                        own = _entries_of(fold(text))
                        counts.update((x, half) for x in (own if known is None else own & known))
            names, kinds = ["entry", "half", "n"], [pa.string(), pa.int32(), pa.int64()]
            values = [(x, half, n) for (x, half), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in values], kind) for k, kind in enumerate(kinds)], names=names)

        return run

    def counts_of(known: frozenset | None, least: int) -> list:
        found = table.select("place", "t").mapInArrow(entries(known), "entry string, half int, n long").groupBy("entry").agg(
            *(F.coalesce(F.sum(F.when(F.col("half") == half, F.col("n"))), F.lit(0)).alias(f"h{half}") for half in (0, 1))
        )
        return found.where(F.col("h0") + F.col("h1") >= least).collect()

    toxic = {r["entry"]: (r["h0"], r["h1"]) for r in counts_of(None, SUPPORT)}
    clean = {r["entry"]: (r["h0"], r["h1"]) for r in counts_of(frozenset(toxic), 0)} if toxic else {}
    counted = Counted(_rows_of(halves), {x: np.array([clean.get(x, (0, 0)), n], np.int64) for x, n in toxic.items()})
    taught = [Lexicon(_lexicon(counted.learned((1 - half,)))) for half in (0, 1)]
    shipped = context.broadcast(pickle.dumps(taught))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shipped.value)
        for batch in batches:
            kept = [(p, x) for p, x in zip(batch.column("place").to_pylist(), batch.column("t").to_pylist(), strict=True) if p in halves]
            found = [own[halves[p][1]].features(x) for p, x in kept]
            columns = [pa.array([p for p, _ in kept], pa.int32()), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "a", "b"])

    features = sorted(tuple(r) for r in table.select("place", "t").mapInArrow(judged, "place int, a double, b double").collect())
    dropped(table)
    return Lexicon(_lexicon(counted.learned()), _parameters(taught, [(a, b, halves[place][0]) for place, a, b in features]))


def scores(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` and ``matches`` (begin, end, weight; places in the text) of each row."""
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))
    match = pa.struct([pa.field("begin", pa.int64()), pa.field("end", pa.int64()), pa.field("weight", pa.float64())])

    def make() -> Callable:
        own = pickle.loads(shipped.value)

        def work(texts: list[str]) -> list[pa.Array]:
            found = [[{"begin": a, "end": b, "weight": w} for a, b, w in own.matches(x)] for x in texts]
            return [pa.array([own.score(x) for x in texts], pa.float64()), pa.array(found, pa.list_(match))]

        return work

    fields = [T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("weight", T.DoubleType())]
    return map_text(df, make, [("score", T.DoubleType()), ("matches", T.ArrayType(T.StructType(fields)))], id_col, text_col)


def not_toxic(df: DataFrame, lexicon: Lexicon, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with a score below ``limit``."""
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def make() -> Callable:
        own = pickle.loads(shipped.value)
        return lambda texts: [own.score(x or "") < limit for x in texts]

    return keep_rows(df, make, text_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row is outside the training fold; rows without an id are in it."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5).eqNullSafe(0)


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Id, ``held_out``, ``score`` and ``predicted`` of each row, learned from the training fold."""
    found = scores(docs, train(docs, labels, id_col=id_col, **options), id_col, options.get("text_col", "text"))
    return found.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
