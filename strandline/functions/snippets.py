"""Snippets: the window of a text that shows most of a query."""

from __future__ import annotations

import re

import numpy as np

from strandline.functions.text import SPACE_CLASS, has_han

BUDGET = 240
#: What a term that a window shows counts, next to one for each hit.
TERM_WEIGHT = 999
_SENTENCE = re.compile(rf"""(?:[.:!?]["'”’」』）)\]]*{SPACE_CLASS}+|[。！？：\n\r]["'”’」』）)\]]*{SPACE_CLASS}*)""")


def sentence_starts(text: str) -> list[int]:
    """Places where sentences begin, 0 first."""
    return [0, *(m.end() for m in _SENTENCE.finditer(text) if m.end() < len(text))]


def select_window(text: str, hits: list[tuple[str, int, int]], budget: int = BUDGET) -> tuple[int, int]:
    """First place and the place after the last of the best window.

    Budget and places inside are weighted, a Han character counting two.  A window
    counts ``TERM_WEIGHT`` for each different term and one for each hit that begin
    in it.  Candidates begin at each hit, then (in a text longer than the budget)
    at the sentence start before it, and last at every sentence start; the first of
    the best wins.  A window chosen for a hit is then centred on its hits.  No hit
    gives the beginning of the text.
    """
    weights = [2 if not c.isascii() and has_han(c) else 1 for c in text] if not text.isascii() else [1] * len(text)
    place = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    length = int(place[-1])
    begin = 0
    if hits:
        ordered = sorted(hits, key=lambda h: h[1])
        starts = place[[h[1] for h in ordered]]
        ends = place[[h[2] for h in ordered]]
        sentences = place[sentence_starts(text)] if length > budget else np.zeros(0, np.int64)
        candidates: list[tuple[int, bool]] = []
        if len(sentences):
            before = sentences[np.searchsorted(sentences, starts, "right") - 1]
            for hit, sentence in zip(starts.tolist(), before.tolist(), strict=True):
                candidates.append((hit, True))
                if sentence < hit:
                    candidates.append((sentence, False))
            candidates += [(s, False) for s in sentences.tolist()]
        else:
            candidates = [(s, True) for s in starts.tolist()]
        at = np.array([c for c, _ in candidates])
        first, last = np.searchsorted(starts, at, "left"), np.searchsorted(starts, at + budget, "left")
        score = last - first
        for term in {h[0] for h in ordered}:
            own = starts[[h[0] == term for h in ordered]]
            score = score + TERM_WEIGHT * (np.searchsorted(own, at, "left") < np.searchsorted(own, at + budget, "left"))
        best = int(np.argmax(score))
        begin, centred = candidates[best]
        if centred:
            low, high = int(starts[first[best]]), int(ends[last[best] - 1])
            begin = max(0, min(low - int((budget - (high - low)) / 2), length - budget))
    end = min(length, begin + budget)
    # A Han character that the window cuts in half stays outside.
    return int(np.searchsorted(place, begin, "left")), int(np.searchsorted(place, end, "right")) - 1


def render(text: str, window: tuple[int, int]) -> str:
    """The window's text, with an ellipsis on each side where the text goes on."""
    begin, end = window
    return ("…" if begin else "") + text[begin:end] + ("…" if end < len(text) else "")
