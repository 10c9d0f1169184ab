"""Automatic queries: the words of a message, and of earlier ones if it has none of use."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.operators import recall
from strandline.operators.index import Index
from strandline.plans.query import Plan, word_branches

# The largest weighted length of a message, bytes that a message must exceed, bytes that an
# earlier one must stay below, words taken from it, and rows shown.
GATE, LEAST_BYTES, BORROW_BYTES, BORROWED_WORDS, ROWS = 280, 10, 240, 4, 5


class Segmenter:
    """Cuts a run of Han into words by the longest match in a lexicon; what it doesn't know are single characters."""

    def __init__(self, lexicon: Sequence[str] = ()):
        self.words = {w for w in (*tx.STOPWORDS, *lexicon) if tx.has_han(w)}
        self.longest = max(map(len, self.words), default=1)

    def __call__(self, run: str) -> list[str]:
        out, at = [], 0
        while at < len(run):
            size = next((n for n in range(min(self.longest, len(run) - at), 1, -1) if run[at : at + n] in self.words), 1)
            out.append(run[at : at + size])
            at += size
        return out


@dataclass(frozen=True)
class Word:
    """A word of a message: its terms, joined by blanks, and what was written."""

    term: str
    surface: str


def surfaces(text: str, segment: Callable[[str], list[str]]) -> Iterator[Word]:
    """What a message is cut into: terms outside Han; in Han the segmenter's words, single characters in a row as one."""
    for part, han in tx.han_runs(tx.nfkc(text)):
        if not han:
            yield from (Word(term, term) for term in tx.terms(part))  # pairs of kana are words of their own here
            continue
        for single, found in itertools.groupby(segment(part), lambda word: len(word) == 1):
            for surface in ["".join(found)] if single else found:
                yield Word(" ".join(tx.terms(surface)), surface)


def words_of(text: str, segment: Callable[[str], list[str]]) -> list[Word]:
    """The different words of a message, each at its first place, with its last surface."""
    last = {word.term: word for word in surfaces(text, segment) if word.term}  # a dict keeps first places
    return list(last.values())


@dataclass
class Message:
    """A message and the user's texts before it, the nearest first."""

    text: str
    recent: Sequence[str] = ()


@dataclass
class Automatic:
    """What came of a message: whether it was passed over, its plan, or none."""

    skipped: bool
    plan: Plan | None = None
    query_terms: list[str] = field(default_factory=list)


def _bytes(text: str) -> int:
    return len(text.strip(tx.SPACES).encode("utf-8", "surrogatepass"))


def document_frequencies(index: Index, terms: Sequence[str], eligible: int | None = None) -> dict[str, int]:
    """In how many documents each word stands, by itself or by its stem."""
    if not terms:
        return {}
    plans = {term: Plan([word_branches(term)]) for term in terms}
    found = recall.hits(index, plans, eligible).groupBy("query_id").agg(F.count("*").alias("n"))
    return {r["query_id"]: r["n"] for r in found.collect()}


def prepare(
    index: Index,
    messages: Mapping[str, Message],
    segment: Callable[[str], list[str]] | None = None,
    gate: int = GATE,
    eligible: int | None = None,
) -> dict[str, Automatic]:
    """The plans of messages.

    A message longer than the gate, or with few bytes, is passed over.  Its words but
    the stopwords make the query if one of them is known to the index; else the
    nearest earlier text with a known word lends its rarest ones.  All words of all
    messages are looked up in one job.
    """
    segment = segment or Segmenter()
    out: dict[str, Automatic] = {}
    words: dict[str, list[list[Word]]] = {}
    for name, message in messages.items():
        if tx.weighted_length(message.text) > gate or _bytes(message.text) <= LEAST_BYTES:
            out[name] = Automatic(True)
            continue
        texts = [message.text, *(t for t in list(message.recent)[:2] if LEAST_BYTES < _bytes(t) < BORROW_BYTES)]
        words[name] = [[w for w in words_of(t, segment) if w.surface not in tx.STOPWORDS] for t in texts]
    known = document_frequencies(index, list(dict.fromkeys(w.term for found in words.values() for own in found for w in own)), eligible)
    for name, (own, *earlier) in words.items():
        usable = [w for w in own if known.get(w.term)]
        all_words = list(own)
        if not usable:
            for other in earlier:
                usable = sorted((w for w in other if known.get(w.term)), key=lambda w: known[w.term])[:BORROWED_WORDS]
                if usable:
                    all_words += usable
                    break
        terms = list(dict.fromkeys(w.term for w in all_words))
        plan = None
        if usable:
            pieces = dict.fromkeys(piece for term in terms for piece in term.split(" "))
            plan = Plan([[b for w in usable for b in word_branches(w.term)]], snippet_terms=[(p, True) for p in pieces])
        out[name] = Automatic(False, plan, terms)
    return out


def lookup(
    index: Index,
    messages: Mapping[str, Message],
    segment: Callable[[str], list[str]] | None = None,
    gate: int = GATE,
    limit: int = ROWS,
    eligible: int | None = None,
) -> DataFrame | None:
    """The best rows of each message, with snippets; None if no message asks for anything."""
    plans = {name: a.plan for name, a in prepare(index, messages, segment, gate, eligible).items() if a.plan}
    if not plans:
        return None
    page = recall.top(recall.representatives(index, recall.hits(index, plans, eligible)), limit)
    return recall.with_snippets(index, page, plans, limit=limit)
