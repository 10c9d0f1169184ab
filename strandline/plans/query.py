"""Concept queries: validated, analysed, and compiled to phrases.

A query has groups of surfaces (alternative wordings), ``match`` any or all of the
groups, and surfaces to exclude.  A surface becomes branches, a branch is phrases
that must all occur; there is no query syntax in surfaces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import regex

from strandline.functions import text as tx
from strandline.operators.index import STEMS, TOKENS

# Limits of a query.
GROUPS, ALTERNATIVES, EXCLUSIONS = 5, 8, 5
SURFACE_CHARS, TOTAL_CHARS = 256, 2_048
BRANCHES, BRANCH_ATOMS, ATOM_CHARS, ALL_ATOMS, MATCH_UNITS = 4, 16, 4_096, 256, 32_768
# The warnings that a page shows.
CLAMPED = "Warning: {path} has more than {most} items; ignored {ignored}."
DROPPED = "Warning: {surfaces} produced no searchable terms and {verb} ignored. Suggestion: use other words or history_grep."
UNCOVERED = "Warning: {surface} → {terms}. Suggestion: revise query terms or use history_grep."

BOTH = (TOKENS, STEMS)
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_SURROGATE = re.compile("[\ud800-\udfff]")
_MEANINGFUL = regex.compile(r"[\p{L}\p{N}\p{M}]")


class QueryError(ValueError):
    """A query that can't be run; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Phrase:
    """Tokens that stand one after the other in one of the columns; ``atom`` is how the query wrote them."""

    atom: str
    columns: tuple[int, ...] = BOTH

    @property
    def tokens(self) -> tuple[str, ...]:
        return tx.atom_tokens(self.atom)

    def text(self) -> str:
        quoted = '"' + self.atom.replace('"', '""') + '"'
        names = {(TOKENS,): "tokens : ", (STEMS,): "stems : ", BOTH: ""}[self.columns]
        return names + quoted


Branch = tuple[Phrase, ...]


@dataclass
class Plan:
    """Groups of branches of phrases.  A phrase counts for the score only through a branch that a document has whole."""

    groups: list[list[Branch]]
    exclude: list[Branch] = field(default_factory=list)
    match: str = "any"
    snippet_terms: list[tuple[str, bool]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    expression: str = ""


@dataclass
class Query:
    """A validated query, and what was left out because there was too much of it."""

    concepts: list[list[str]]
    match: str = "any"
    exclude: list[str] = field(default_factory=list)
    clamped: list[tuple[str, int, list]] = field(default_factory=list)


def _unique(values: Iterable) -> list:
    return list(dict.fromkeys(values))


def _units(text: str) -> int:
    """UTF-16 units."""
    return len(text) + sum(c > "\uffff" for c in text)


def checked_text(value: object, path: str, most: int) -> str:
    """A trimmed text of bounded length without control characters."""
    if not isinstance(value, str):
        raise QueryError("INVALID_TEXT", f"{path} is no text")
    if _units(value) > 2 * most:
        raise QueryError("LIMIT_EXCEEDED", f"{path} is longer than {most} characters")
    if _SURROGATE.search(value):
        raise QueryError("INVALID_TEXT", f"{path} has half of a character")
    if _CONTROL.search(value):
        raise QueryError("INVALID_TEXT", f"{path} has a control character")
    value = value.strip(tx.SPACES)
    if not value:
        raise QueryError("EMPTY_TEXT", f"{path} is blank")
    if len(value) > most:
        raise QueryError("LIMIT_EXCEEDED", f"{path} is longer than {most} characters")
    return value


def parse(source: object, clamp: bool = False) -> Query:
    """Validate a query; ``clamp`` leaves out items beyond a count instead of failing, and notes them."""
    if not isinstance(source, dict):
        raise QueryError("INVALID_QUERY", "a query is an object with concepts")
    for name in source:
        if name not in ("concepts", "match", "exclude"):
            raise QueryError("UNKNOWN_FIELD", f"a query has no field {name}")
    match = source.get("match") if source.get("match") is not None else "any"
    if match not in ("any", "all"):
        raise QueryError("INVALID_MODE", f"match is any or all, not {match!r}")
    clamped: list[tuple[str, int, list]] = []
    used = 0

    def items(value: object, path: str, least: int, most: int) -> list:
        if not isinstance(value, (list, tuple)) or len(value) < least or (len(value) > most and not clamp):
            raise QueryError("INVALID_ARRAY", f"{path} takes {least} to {most} items")
        if len(value) > most:
            clamped.append((path, most, list(value[most:])))
        return list(value[:most])

    def surface(value: object, path: str) -> str:
        nonlocal used
        found = checked_text(value, path, SURFACE_CHARS)
        used += len(found)
        if used > TOTAL_CHARS:
            raise QueryError("LIMIT_EXCEEDED", f"all surfaces together are longer than {TOTAL_CHARS} characters")
        return found

    concepts = [
        _unique(surface(s, f"concepts[{i}][{j}]") for j, s in enumerate(items(group, f"concepts[{i}]", 1, ALTERNATIVES)))
        for i, group in enumerate(items(source.get("concepts"), "concepts", 1, GROUPS))
    ]
    excluded = source.get("exclude") if source.get("exclude") is not None else []
    exclude = _unique(surface(s, f"exclude[{i}]") for i, s in enumerate(items(excluded, "exclude", 0, EXCLUSIONS)))
    return Query(concepts, match, exclude, clamped)


# ---------------------------------------------------------------- analysis

Span = tuple[str, int, int]


def atoms_of(found: list[Span], phrases: bool = True) -> list[str]:
    """Atoms of spans: pairs of one Han or kana run are one phrase, other terms stand alone."""
    out: list[str] = []
    after = None  # the place at which a pair goes on with the last atom
    for term, start, _ in found:
        paired = phrases and tx.is_paired(term)
        if paired and after == start:
            out[-1] += f" {term}"
        else:
            out.append(term)
        after = start + 1 if paired else None
    return out


def branches_of(found: list[Span], phrases: bool = True) -> list[list[str]]:
    """Branches of a surface: its fragments, and beside them its whole dotted runs if it has any."""
    runs = [s for s in found if "." in s[0]]
    fragments = [s for s in found if "." not in s[0]]
    if not runs:
        return [atoms_of(fragments, phrases)] if fragments else []
    outside = [s for s in found if s in runs or not any(r[1] <= s[1] and s[2] <= r[2] for r in runs)]
    exact = atoms_of(outside, phrases)
    return [atoms_of(fragments, phrases), exact] if fragments else [exact]


def _joined(word: str, parts: list[str]) -> str:
    parts = _unique(parts)
    if not parts:
        raise QueryError("EMPTY_ANALYSIS", "nothing is left to search for")
    return parts[0] if len(parts) == 1 else "(" + f" {word} ".join(parts) + ")"


class Compiler:
    """Compiles the surfaces of one query; each once."""

    def __init__(self, analyse=None):
        self.analyse = analyse or (lambda surface: branches_of(tx.spans(surface)))
        self.atoms = 0
        self.known: dict[str, tuple[str, list[Branch]]] = {}

    def surface(self, surface: str) -> tuple[str, list[Branch]]:
        """The expression of a surface, and its branches."""
        if surface not in self.known:
            try:
                analysis = self.analyse(surface)
            except Exception as error:
                raise QueryError("ANALYZER_FAILED", f"the analysis of {surface!r} failed") from error
            if not analysis:
                raise QueryError("EMPTY_ANALYSIS", f"{surface!r} has no terms")
            if len(analysis) > BRANCHES:
                raise QueryError("INVALID_ARRAY", f"{surface!r} has more than {BRANCHES} readings")
            branches = [self._branch(b) for b in analysis]
            texts = [_joined("AND", [p.text() for p in b]) for b in branches]
            own = {t: b for t, b in reversed(list(zip(texts, branches, strict=True)))}
            self.known[surface] = _joined("OR", texts), [own[t] for t in _unique(texts)]
        return self.known[surface]

    def _branch(self, atoms: list[str]) -> Branch:
        if not 1 <= len(atoms) <= BRANCH_ATOMS:
            raise QueryError("INVALID_ARRAY", f"a reading takes 1 to {BRANCH_ATOMS} atoms, not {len(atoms)}")
        out = []
        for atom in atoms:
            self.atoms += 1
            if self.atoms > ALL_ATOMS:
                raise QueryError("LIMIT_EXCEEDED", f"a query takes {ALL_ATOMS} atoms at most")
            if checked_text(atom, "an atom", ATOM_CHARS) != atom:
                raise QueryError("INVALID_ANALYSIS", f"the atom {atom!r} begins or ends with a blank")
            out.append(Phrase(atom))
        return tuple(_unique(out))

    def group(self, surfaces: list[str]) -> tuple[str, list[Branch]]:
        """Alternatives; equal expressions count once."""
        found = {}
        for surface in surfaces:
            text, branches = self.surface(surface)
            found.setdefault(text, branches)
        return _joined("OR", list(found)), [b for branches in found.values() for b in branches]


def compile_query(query: Query, analyse=None) -> Plan:
    """The plan of a validated query, with its expression as text."""
    compiler = Compiler(analyse)
    groups: dict[str, list[Branch]] = {}
    for surfaces in query.concepts:
        text, branches = compiler.group(surfaces)
        groups.setdefault(text, branches)
    expression = _joined("AND" if query.match == "all" else "OR", list(groups))
    exclude: list[Branch] = []
    if query.exclude:
        text, exclude = compiler.group(query.exclude)
        expression = f"({expression} NOT {text})"
    if _units(expression) > MATCH_UNITS:
        raise QueryError("LIMIT_EXCEEDED", f"the expression is longer than {MATCH_UNITS} units")
    return Plan(list(groups.values()), exclude, query.match, expression=expression)


def _data(value: object) -> str:
    plain = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return re.sub("[<>&\u2028\u2029]", lambda m: f"\\u{ord(m.group()):04x}", plain)


def plan(source: object) -> Plan:
    """The plan of a query as users give it: counts clamped, surfaces folded, those without terms left out, all with warnings."""
    raw = parse(source, clamp=True)
    concepts = [_unique(map(tx.nfkc, group)) for group in raw.concepts]
    exclude = _unique(map(tx.nfkc, raw.exclude))
    spans = {s: tx.spans(s) for s in [x for g in concepts for x in g] + exclude}
    kept = [g for g in ([s for s in group if spans[s]] for group in concepts) if g]
    query = Query(kept, raw.match, [s for s in exclude if spans[s]]) if kept else Query(concepts, raw.match, exclude)
    out = compile_query(query, lambda s: branches_of(spans[s]))
    out.warnings = [CLAMPED.format(path=path, most=most, ignored=_data(ignored)) for path, most, ignored in raw.clamped]
    dropped = [s for s in spans if not spans[s]]
    if dropped:
        out.warnings.append(DROPPED.format(surfaces=_data(dropped), verb="was" if len(dropped) == 1 else "were"))
    for surface, found in spans.items():
        covered = {i for _, a, b in found for i in range(a, b)}
        if found and any(_MEANINGFUL.match(c) and i not in covered for i, c in enumerate(surface)):
            terms = _unique(t for t, _, _ in found)
            out.warnings.append(UNCOVERED.format(surface=_data(surface), terms=_data(terms)))
    out.snippet_terms = [(t, False) for t in _unique(t for g in query.concepts for s in g for t, _, _ in spans[s])]
    return out


def word_branches(term: str) -> list[Branch]:
    """The branches of an automatic query's word: the term itself, and its stem where it has another."""
    stem = " ".join(tx.stems(term))
    if not stem:
        return [(Phrase(term, (TOKENS,)),)]
    if stem == term:
        return [(Phrase(term, BOTH),)]
    return [(Phrase(term, (TOKENS,)),), (Phrase(stem, (STEMS,)),)]
