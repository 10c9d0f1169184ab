r"""Tokens and their places.

Text is NFKC.  A run is either Han, kana and the prolonged sound mark, which gives
overlapping pairs of characters, or letters, digits, marks, ``_`` and ``$`` joined
by single dots, which gives the words inside it (split at dots, ``_``, ``$``, case
changes; one character is no word) and, if it has a dot, the run itself.

The index sees the terms of a text in that order, with a barrier after each Han or
kana run; its own tokenizer then cuts terms at ASCII signs other than the dot, so
``config_x.py`` is the two tokens ``config`` and ``x.py``.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.porter import stem

#: What counts as white space, for collapsing and trimming: as a set of characters, and as a class for patterns.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_CLASS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: A position that no phrase crosses.
BARRIER = "\ue000"

# Words that an automatic query leaves out.
STOPWORDS = frozenset(
    "a an and are as at be been but by can could did do does for from had has have how i if in is it its me my of on or our please so than that the "
    "their them then there these they this to us was we were what when where which who why will with would you your "
    "please tell help about find show recall remember previous earlier history "
    "我们 你们 他们 这个 那个 什么 怎么 为什么 可以 是否 之前 然后 以及 还有 一个 帮我 告诉 记得".split()
)

_PAIRED = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\u30fc"
_WORD = rf"[[\p{{L}}\p{{N}}\p{{M}}_$]--[{_PAIRED}]]+"
_RUN = regex.compile(rf"(?V1)(?P<paired>[{_PAIRED}]+)|{_WORD}(?:\.{_WORD})*")
_ASCII_RUN = re.compile(r"[A-Za-z0-9_$]+(?:\.[A-Za-z0-9_$]+)*")
_PAIR = regex.compile(rf"[{_PAIRED}]+")
_CUT = re.compile(r"[_$]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_TOKEN = re.compile(r"[0-9A-Za-z.\x80-\U0010ffff]+")
_STEMMED = re.compile(r"[A-Za-z0-9_$]+")
_HAN = regex.compile(r"\p{Script=Han}")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def is_paired(term: str) -> bool:
    """Whether a term is made of Han and kana."""
    return not term.isascii() and _PAIR.fullmatch(term) is not None


def _words(run: str, base: int) -> Iterator[tuple[str, int, int]]:
    """Words of a run without dots, with places."""
    begin = 0
    for cut in _CUT.finditer(run):
        if cut.start() - begin > 1:
            yield run[begin : cut.start()].lower(), base + begin, base + cut.start()
        begin = cut.end()
    if len(run) - begin > 1:
        yield run[begin:].lower(), base + begin, base + len(run)


def _run_spans(run: str, base: int) -> Iterator[tuple[str, int, int]]:
    at = base
    for part in run.split("."):
        yield from _words(part, at)
        at += len(part) + 1
    if "." in run:
        yield run.lower(), base, base + len(run)


def spans(text: str) -> list[tuple[str, int, int]]:
    """Terms of a text in order, with first place and the place after the last (code points)."""
    out: list[tuple[str, int, int]] = []
    if text.isascii():
        for run in _ASCII_RUN.finditer(text):
            out.extend(_run_spans(run.group(), run.start()))
        return out
    for run in _RUN.finditer(text):
        if run["paired"]:
            out.extend((text[i : i + 2], i, i + 2) for i in range(run.start(), run.end() - 1))
        else:
            out.extend(_run_spans(run.group(), run.start()))
    return out


def terms(text: str) -> list[str]:
    """Terms of a text in order."""
    return [term for term, _, _ in spans(text)]


@functools.lru_cache(maxsize=1 << 17)
def run_tokens(run: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Index tokens and stems of a run of words."""
    if run.isalpha() and (len(run) == 1 or run[1:].islower()):  # a word in lower case, or with a capital: nothing to cut
        low = run.lower()
        return ((low,), (stem(low),) if low.isascii() else ()) if len(run) > 1 else ((), ())
    found = [term for term, _, _ in _run_spans(run, 0)]
    return tuple(t for term in found for t in _TOKEN.findall(term)), tuple(s for term in found for s in stems(term))


def stems(term: str) -> list[str]:
    """Stems of a term of ASCII letters, digits, ``_`` and ``$``; other terms have none."""
    if not _STEMMED.fullmatch(term):
        return []
    return [stem(x) for x in _ASCII_WORD.findall(term.lower())]


def index_tokens(text: str) -> tuple[list[str], list[str]]:
    """The two columns of the index for a text: its tokens with barriers, and their stems."""
    tokens: list[str] = []
    stemmed: list[str] = []
    runs = ((m.group(), False) for m in _ASCII_RUN.finditer(text)) if text.isascii() else ((m.group(), bool(m["paired"])) for m in _RUN.finditer(text))
    for run, paired in runs:
        if paired:
            if len(run) > 1:
                tokens.extend(run[i : i + 2] for i in range(len(run) - 1))
                tokens.append(BARRIER)
        else:
            found, other = run_tokens(run)
            tokens.extend(found)
            stemmed.extend(other)
    return tokens, stemmed


def atom_tokens(atom: str) -> tuple[str, ...]:
    """The tokens of a query's atom, as the index cuts it."""
    return tuple(_TOKEN.findall(atom))


def weighted_length(text: str) -> int:
    """Characters, Han counted twice."""
    return len(text) if text.isascii() else len(text) + len(_HAN.findall(text))


def has_han(text: str) -> bool:
    return _HAN.search(text) is not None


def han_runs(text: str) -> list[tuple[str, bool]]:
    """The text cut into runs of Han (True) and what is between them (False)."""
    parts = regex.split(r"(\p{Script=Han}+)", text)
    return [(part, bool(i % 2)) for i, part in enumerate(parts) if part]


# ---------------------------------------------------------------- columns


@F.pandas_udf(T.StringType())
def nfkc_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else nfkc(x))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def spans_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else [{"term": t, "start": a, "end": b} for t, a, b in spans(nfkc(x))])


@F.pandas_udf(T.StringType())
def stem_udf(word: pd.Series) -> pd.Series:
    return word.map(lambda x: None if x is None else " ".join(stems(x)) or None)


def collapsed(text: Column) -> Column:
    """The text with each run of white space as one space, and none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256, in hexadecimal, of the collapsed text."""
    return F.sha2(collapsed(text), 256)


def weighted_length_col(text: Column) -> Column:
    """:func:`weighted_length` as an expression."""
    return F.length(text) + F.regexp_count(text, F.lit(r"\p{IsHan}"))


def plain_terms_col(text: Column) -> Column:
    """:func:`terms` without Python, for text in which no Han and no kana occur (whole dotted runs come at the end)."""
    word = r"[\p{L}\p{N}\p{M}_$]+"
    runs = F.regexp_extract_all(text, F.lit(rf"{word}(?:\.{word})*"), F.lit(0))
    spaced = F.regexp_replace(F.regexp_replace(F.array_join(runs, " "), r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2")
    parts = F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[_$.\s]+", " ")), " "), lambda x: F.length(x) >= 2)
    return F.concat(parts, F.transform(F.filter(runs, lambda x: F.contains(x, F.lit("."))), lambda x: F.lower(x)))
