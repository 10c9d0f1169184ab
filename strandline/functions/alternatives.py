"""Other ways to cut texts and queries than :mod:`strandline.functions.text`: whole identifiers, dictionary words, pairs with singles, raw operands."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text as tx

_PART = regex.compile(r"(?P<han>\p{Script=Han}+)|[A-Za-z0-9_]+")
_JOINED = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\U00020000-\U0002ffff"
_JOINED_RUN = re.compile(f"[{_JOINED}]+")
#: The English words of the stopwords; whole-identifier indexes leave out these alone.
ENGLISH = frozenset(w for w in tx.STOPWORDS if w.isascii())


def dictionary_words(run: str, lexicon: Collection[str]) -> Iterator[tuple[str, int, int]]:
    """Every word of three characters or more of a lexicon that stands in a run of Han, with places."""
    sizes = sorted({len(w) for w in lexicon if len(w) >= 3})
    for at in range(len(run)):
        for size in sizes:
            if at + size <= len(run) and run[at : at + size] in lexicon:
                yield run[at : at + size], at, at + size


def han_terms(run: str, lexicon: Collection[str] = ()) -> list[tuple[str, int, int]]:
    """Pairs of a run's characters and its dictionary words, by beginning, the shorter first."""
    found = [(run[i : i + 2], i, i + 2) for i in range(len(run) - 1)]
    return sorted([*found, *dictionary_words(run, lexicon)], key=lambda s: (s[1], s[2]))


def whole_terms(text: str, lexicon: Collection[str] = ()) -> list[str]:
    """Identifiers as they are, in lower case and without English stopwords; pairs and dictionary words of Han."""
    out: list[str] = []
    for part in _PART.finditer(text):
        if part["han"]:
            out += [term for term, _, _ in han_terms(part.group(), lexicon)]
        elif (term := part.group().lower()) not in ENGLISH:
            out.append(term)
    return out


def whole_terms_col(text: Column) -> Column:
    """:func:`whole_terms` without Python, for text without Han."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda x: F.lower(x))
    return F.filter(runs, lambda x: ~x.isin(*sorted(ENGLISH)))


def paired_text(text: str) -> str:
    """The text with each run of Han, kana and Hangul as its overlapping pairs, between blanks; a single character stays."""
    return _JOINED_RUN.sub(lambda m: f" {' '.join(_pairs(m.group()))} ", text)


def single_text(text: str) -> str:
    """The characters of all runs of Han, kana and Hangul, each by itself."""
    return " ".join(c for run in _JOINED_RUN.findall(text) for c in run)


def _pairs(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(len(run) - 1)] or [run]


@F.pandas_udf(T.StringType())
def paired_text_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else paired_text(x))


# ---------------------------------------------------------------- queries

_SPAN = re.compile(r'"([^"]+)"|(\S+)')
_HAS_WORD = regex.compile(r"[\p{L}\p{N}]")


def span_terms(query: str) -> list[str]:
    """Terms between blanks, a quoted span being one; those without a letter or digit are left out."""
    found = (next(g for g in m.groups() if g is not None).strip() for m in _SPAN.finditer(query))
    return [t for t in found if t and _HAS_WORD.search(t)]


@dataclass(frozen=True)
class Route:
    """Which terms a tier looks for: all in the lexical one, the long ones among trigrams, and the short ones that then have to be there too."""

    lexical: tuple[str, ...]
    trigram: tuple[str, ...]
    required: tuple[str, ...]


def route(terms: list[str]) -> Route:
    """Terms by length: trigrams find those of three characters or more; short ones beside long ones filter what trigrams find."""
    long = tuple(t for t in terms if len(t) >= 3)
    return Route(tuple(terms), long, tuple(t for t in terms if len(t) < 3) if long else ())


@dataclass(frozen=True)
class Operand:
    """A term of a raw match expression; ``prefix`` if a star follows it."""

    term: str
    prefix: bool


_LEXEME = re.compile(r'"(?:[^"]|"")*"|[(){}:,^*]|[^\s(){}:,^*]+')
_OPERATORS = {"AND", "OR", "NOT"}
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def operands(expression: str) -> list[Operand]:
    """The terms of a raw match expression, in order.

    Operators, columns (before a colon, or in braces) and the distance of NEAR are no
    terms.  Quoted phrases are cut into words; of one with a star the last is a prefix.
    """
    lexemes = _LEXEME.findall(expression)
    following = [*lexemes[1:], ""]
    preceding = ["", *lexemes[:-1]]
    out: list[Operand] = []
    in_columns, groups = False, []  # of each open group whether it is NEAR's
    for before, lexeme, after in zip(preceding, lexemes, following, strict=True):
        if lexeme in "{}":
            in_columns = lexeme == "{"
        elif lexeme == "(" and not in_columns:
            groups.append(before == "NEAR")
        elif lexeme == ")" and not in_columns:
            groups[-1:] = []
        elif not (in_columns or after == ":" or lexeme in _OPERATORS or (lexeme == "NEAR" and after == "(")):
            distance = bool(groups and groups[-1]) and before == "," and lexeme.isdecimal()
            words = [] if distance else _WORD.findall(lexeme[1:-1].replace('""', '"') if lexeme.startswith('"') else lexeme)
            out += [Operand(w.lower(), after == "*" and i == len(words) - 1) for i, w in enumerate(words)]
    return out
