r"""Operator 1: licence scans over a positional rare-token index, with DataFrame functions only.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.
Templates are runs of licence words with positions: the base phrases, short phrases
that name a licence, and the sentences of licence texts.  Over all documents, each
template word's document frequency gives its IDF; a template is indexed under its
``RARE`` words of highest IDF: the index is one map from a word to its postings,
(template, position).

A file looks up those of its words that the index has, which are the rarest licence
words.  Every occurrence of one votes, for each posting, for the template and the
place where it would begin, so that postings which agree in relative position vote
alike; what has the votes it needs (all for a base phrase, one less for others) is a
candidate, and is found if the template's mandatory key phrase stands at its place
word by word.  A base phrase is all key phrase, and all its rare words vote for any
place of it, so none is missed.  A label is given for a base or naming phrase, or if
``ENOUGH`` of the sentences of a licence text are found; so a copied licence may have
changed words.

All of it happens within the row and the work follows the file's words and their
postings, not the number of templates.  Documents aren't shuffled, and the words of a
file are only walked again if it has a word of the index.  One pass over the documents
counts words and rows; what is collected is a row for each template word.

Null text is empty.  A text without places has null for the first and last word and
empty labels.  The score is 1 with a label, else 0.9 times the largest share, by IDF,
of a template's rare words that agree on a place.  Repeated rows and ids are all kept;
an empty table gives no rows; only id and text are read, so further columns don't
matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases with labels; phrases that name a licence; sentences of licence texts, in which brackets
# enclose the mandatory key phrase (all of it if there are none).
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
NAMES = (
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache-2", "www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc-nd", "cc by nc nd"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "cc0 1 0 universal"),
    ("epl-2", "eclipse public license version 2"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "mozilla public license version 2"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
TEXTS = {
    "apache-2": (
        "you may not use this file [except in compliance with the license] you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing [software distributed under the license] is distributed on an as is basis",
        "without warranties or conditions of any kind either express or implied",
        "see the license for the [specific language governing permissions] and limitations under the license",
    ),
    "bsd": (
        "redistributions of source code must [retain the above copyright notice] this list of conditions and the following disclaimer",
        "redistributions in binary form must [reproduce the above copyright notice] this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the [names of its contributors may be used] to endorse or promote products",
        "this software is provided by the [copyright holders and contributors] as is and any express or implied warranties",
        "in no event shall the copyright holder or contributors be [liable for any direct indirect incidental special]",
    ),
    "gpl": (
        "this program is free software you can [redistribute it and or modify] it under the terms of the gnu general public license",
        "this program is distributed in the hope that [it will be useful but without any warranty] without even the implied warranty",
        "you should have received a copy of the [gnu general public license along with] this program",
    ),
    "isc": (
        "with or without fee is hereby granted provided that the [above copyright notice and this permission notice] appear in all copies",
        "the author [disclaims all warranties with regard to] this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special direct indirect or consequential damages or [any damages whatsoever resulting from loss of use]",
    ),
    "mit": (
        "permission is hereby granted [free of charge to any person] obtaining a copy of this software and associated documentation files",
        "to deal in the software [without restriction including without limitation] the rights to use copy modify merge publish distribute sublicense",
        "the above copyright notice and this permission notice shall be [included in all copies or substantial portions] of the software",
        "the software is provided [as is without warranty of any kind] express or implied including but not limited to",
        "in no event shall the authors or copyright holders be [liable for any claim damages or other liability]",
    ),
    "zlib": (
        "this software is provided as is [without any express or implied warranty] in no event will the authors be held liable",
        "the origin of this software [must not be misrepresented you must not claim] that you wrote the original software",
        "altered source versions must be [plainly marked as such and must not be] misrepresented as being the original software",
        "this notice [may not be removed or altered from any] source distribution",
    ),
}
#: Words of a template that it is indexed under, and the share of a text's sentences that give its label.
RARE = 3
ENOUGH = 0.6
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
KELVIN = "\u212a"


@dataclass
class Template:
    """A run of licence words: ``key`` are begin and size of its key phrase, ``group`` what its label needs ``enough`` of."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool
    group: int
    enough: int
    idf: tuple[float, ...] = ()
    rare: tuple[int, ...] = field(default=())

    @property
    def votes(self) -> int:
        """Rare words that have to agree on a place."""
        few = min(RARE, len(self.words))
        return few if self.base else max(1, few - 1)


def templates() -> list[Template]:
    groups = [(label, (text,), base) for base, some in ((True, BASE), (False, NAMES)) for label, text in some]
    groups += [(label, sentences, False) for label, sentences in TEXTS.items()]
    out = []
    for group, (label, sentences, base) in enumerate(groups):
        for sentence in sentences:
            before, _, rest = sentence.partition("[")
            inside = rest.partition("]")[0]
            words = tuple(sentence.replace("[", "").replace("]", "").split())
            key = (len(before.split()), len(inside.split())) if rest else (0, len(words))
            out.append(Template(label, words, key, base, group, math.ceil(ENOUGH * len(sentences))))
    return out


def words(text: Column) -> Column:
    """The words of a text, in order, for comparing with words of ASCII letters.

    Letters beyond A-Z are lower-cased too, which makes no word an ASCII word: of all
    letters only the Kelvin sign has an ASCII letter below it, so it is replaced before.
    (Translating A-Z alone is several times as dear.)
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("\u00e5"))), F.lit(WORD), F.lit(0))


def indexed(docs: DataFrame, text_col: str = "text") -> list[Template]:
    """The templates with IDF and rare positions, from word counts over all of ``docs``, in one pass."""
    known = templates()
    vocabulary = sorted({w for t in known for w in t.words})
    # The empty string, which is no word, counts the rows.
    own = F.array_append(F.array_intersect(words(F.col(text_col).cast("string")), F.array(*map(F.lit, vocabulary))), F.lit(""))
    counted = {r["w"]: r["n"] for r in docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counted.get("", 0)
    for t in known:
        t.idf = tuple(round(math.log((total + 1) / (counted.get(w, 0) + 0.5)), 6) for w in t.words)
        t.rare = tuple(sorted(range(len(t.words)), key=lambda i: (-t.idf[i], i))[:RARE])
    return known


def _array(values) -> str:
    return "array(" + ", ".join(map(str, values)) + ")"


def _postings(known: list[Template]) -> str:
    """The index as a map from a word to (template, position, IDF)."""
    index: dict[str, list[str]] = {}
    for number, t in enumerate(known):
        for i in t.rare:
            index.setdefault(t.words[i], []).append(f"named_struct('t', {number}L, 'p', {i}L, 'm', {t.idf[i]}D)")
    return "map(" + ", ".join(f"'{w}', {_array(found)}" for w, found in sorted(index.items())) + ")"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_words``, ``places`` (label, base, place, group of each find), ``labels`` and ``score`` of each row."""
    known = indexed(docs, text_col)
    vocabulary = _array(f"'{w}'" for w in sorted({t.words[i] for t in known for i in t.rare}))
    sizes, needs = _array(len(t.words) for t in known), _array(t.votes for t in known)
    masses = _array(f"{round(sum(t.idf[i] for i in t.rare), 6)}D" for t in known)
    keys = _array(_array(f"'{w}'" for w in t.words[t.key[0] : sum(t.key)]) for t in known)
    begins = _array(t.key[0] for t in known)
    labels, bases, groups = _array(f"'{t.label}'" for t in known), _array(str(t.base).lower() for t in known), _array(t.group for t in known)
    enough = {t.group: t.enough for t in known}
    label_of = {t.group: t.label for t in known}
    read = docs.select(F.col(id_col).alias("id"), words(F.col(text_col).cast("string")).alias("words"))
    present = read.selectExpr("id", "cast(size(words) AS long) AS n", "words", f"IF(arrays_overlap(words, {vocabulary}), array_intersect(words, {vocabulary}), array()) AS present")
    # Without a word of the index there is nothing to look for, and the words need not be kept.
    looked = present.selectExpr(
        "id", "n", "IF(size(present) = 0, array(), words) AS words",
        "IF(size(present) = 0, array(), filter(transform(words, (w, i) -> named_struct('w', w, 'i', cast(i AS long))), o -> array_contains(present, o.w))) AS occurrences",
    )
    # A vote is template and place in one number, with the word's IDF.
    vote = "named_struct('c', p.t * 4294967296L + (o.i - p.p), 'm', p.m)"
    fits = f"o.i >= p.p AND o.i - p.p + get({sizes}, cast(p.t AS int)) <= n"
    voted = looked.selectExpr(
        "id", "n", "words", f"array_sort(flatten(transform(occurrences, o -> transform(filter(element_at({_postings(known)}, o.w), p -> {fits}), p -> {vote})))) AS votes"
    )
    template, place = "cast(shiftright({0}, 32) AS int)", "({0} & 4294967295L)"
    ahead = lambda k: f"IF(get(votes, i + {k}).c <=> v.c, get(votes, i + {k}).m, 0D)"
    mass = " + ".join(["v.m", *(ahead(k) for k in range(1, RARE))])
    agreed = voted.selectExpr(
        "id", "n", "words",
        f"array_distinct(transform(filter(votes, (v, i) -> get(votes, i + get({needs}, {template.format('v.c')}) - 1).c <=> v.c), v -> v.c)) AS codes",
        f"coalesce(array_max(transform(votes, (v, i) -> ({mass}) / greatest(get({masses}, {template.format('v.c')}), 1e-9D))), 0D) AS share",
    )
    t = template.format("c")
    stands = f"slice(words, cast({place.format('c')} AS int) + get({begins}, {t}) + 1, size(get({keys}, {t}))) = get({keys}, {t})"
    find = f"named_struct('t', {t}, 'label', get({labels}, {t}), 'base', get({bases}, {t}), 'group', get({groups}, {t}), 'place', {place.format('c')})"
    placed = agreed.selectExpr("id", "n", "share", f"transform(filter(codes, c -> {stands}), c -> {find}) AS places")
    # A label needs as many different templates of its group as that says.
    found = "array_distinct(transform(places, p -> p.t * 1000L + p.group))"
    several = _array(f"named_struct('g', {g}L, 'label', '{label_of[g]}', 'n', {n})" for g, n in sorted(enough.items()))
    labelled = placed.selectExpr("*", f"IF(size(places) = 0, array(), {found}) AS found").selectExpr(
        "id", "n", "share", "places",
        f"IF(size(found) = 0, cast(array() AS array<string>), array_sort(array_distinct(transform(filter({several}, g -> size(filter(found, f -> f % 1000 = g.g)) >= g.n), g -> g.label)))) AS labels",
    )
    return labelled.selectExpr(
        f"id AS `{id_col}`", "n AS n_words", "transform(places, p -> named_struct('label', p.label, 'base', p.base, 'place', p.place)) AS places", "labels",
        "IF(size(labels) > 0, 1D, round(0.9D * share, 6)) AS score",
    )


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, first and last place and labels of the base phrases, and all labels and the score of each row."""
    return scan(docs, id_col, text_col).selectExpr(f"`{id_col}`", "n_words", "labels", "score", "filter(places, p -> p.base) AS base").selectExpr(
        f"`{id_col}`",
        "n_words",
        "cast(size(base) AS long) AS n_base",
        "array_min(transform(base, p -> p.place)) AS first_word",
        "array_max(transform(base, p -> p.place)) AS last_word",
        "array_join(array_sort(array_distinct(transform(base, p -> p.label))), ',') AS base_labels",
        "array_join(labels, ',') AS labels",
        "score",
    )
