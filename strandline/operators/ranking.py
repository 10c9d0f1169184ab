"""Further ways to search: ranking by rarity, must/prefer/exclude, prefixes, fuzzy words, n-gram tiers, lemmas, pools."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import alternatives
from strandline.functions import text as tx
from strandline.operators import recall
from strandline.operators.index import TOKENS, Index, build, sums
from strandline.plans.query import Branch, Phrase, Plan, atoms_of

# ---------------------------------------------------------------- rarity

# Characters and terms of a query that count.
QUERY_CHARS, QUERY_TERMS, WINDOW = 4_000, 24, 120
_LEX = regex.compile(r"(?P<han>\p{Script=Han}+)|[A-Za-z0-9_$]+")
_PIECE = re.compile(r"[_$]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def lex(text: str) -> list[tuple[str, int]]:
    """Terms with places: pairs of Han characters; words whole, and their parts if they have any; no stopwords."""
    out = []
    for run in _LEX.finditer(text):
        word, at = run.group(), run.start()
        if run["han"]:
            found = [(word[i : i + 2], at + i) for i in range(len(word) - 1)]
        else:
            whole = word.lower()
            found = [(whole, at)] if len(word) >= 2 else []
            begin = 0
            for cut in [*_PIECE.finditer(word), None]:
                part = word[begin : cut.start() if cut else None].lower()
                if len(part) >= 2 and part != whole:
                    found.append((part, at + begin))
                begin = cut.end() if cut else begin
        out += [f for f in found if f[0] not in tx.STOPWORDS]
    return out


def rarity_terms(query: str) -> list[str]:
    """The first different terms of a query."""
    return list(dict.fromkeys(t for t, _ in lex(query[:QUERY_CHARS])))[:QUERY_TERMS]


def rarity_matches(docs: DataFrame, queries: Mapping[str, str]) -> DataFrame:
    """Rows (query_id, branch_id, id, term, at) of the query terms in documents, each with its first place.

    Queries are few and go with the function, so a text is cut once for all of them.
    """
    wanted: dict[str, list[str]] = {}
    for name, query in queries.items():
        for term in rarity_terms(query):
            wanted.setdefault(term, []).append(name)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("at", T.IntegerType())])))
    def found(text: pd.Series) -> pd.Series:
        def one(value: str | None) -> list:
            first: dict[str, int] = {}
            for term, at in lex(value or ""):
                if term in wanted:
                    first.setdefault(term, at)
            return [{"term": t, "at": a} for t, a in first.items()]

        return text.map(one)

    spark = docs.sparkSession
    asked = spark.createDataFrame([(t, q) for t, names in wanted.items() for q in names], "term string, query_id string")
    rows = docs.select("branch_id", "id", "recency", F.explode(found("text")).alias("f")).select("branch_id", "id", "recency", "f.term", "f.at")
    return rows.join(recall.small(asked, len(wanted)), "term")


def rarity_scores(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """Score of each document: the sum over its terms of 1 + ln((N + 1) / (df + 1))."""
    total = documents.groupBy("branch_id").agg(F.count("*").alias("n"))
    df = matches.groupBy("query_id", "branch_id", "term").agg(F.count("*").alias("df"))
    known = df.join(total, "branch_id").withColumn("weight", 1 + F.log((F.col("n") + 1) / (F.col("df") + 1)))
    rarest = F.min(F.struct("df", "at", "term")).alias("rarest")
    return (
        matches.join(known, ["query_id", "branch_id", "term"])
        .groupBy("query_id", "branch_id", "id", "recency")
        .agg(F.sum("weight").alias("score"), F.count("*").alias("terms"), rarest)
    )


def term_window(text: Column, at: Column, term: Column, size: int = WINDOW) -> Column:
    """``size`` characters around the middle of a term, with an ellipsis on each side where the text goes on."""
    centre = at + F.floor(F.length(term) / 2)
    begin = F.greatest(F.lit(0), F.least(centre - size // 2, F.length(text) - size)).cast("int")
    cut = F.substr(text, begin + 1, F.lit(size))
    return F.concat(F.when(begin > 0, "…").otherwise(""), cut, F.when(begin + size < F.length(text), "…").otherwise(""))


def by_rarity(docs: DataFrame, queries: Mapping[str, str], limit: int = 5) -> DataFrame:
    """The best documents (branch_id, id, recency, ts, role, text; ids unique) of each query, by rarity.

    Of documents whose windows read alike the latest stands for all.
    """
    rows = docs.where("text <> ''")
    scored = rarity_scores(rarity_matches(rows, queries), rows).join(rows.select("branch_id", "id", "ts", "role", "text"), ["branch_id", "id"])
    shown = scored.withColumn("snippet", term_window(F.col("text"), F.col("rarest.at"), F.col("rarest.term")))
    latest = F.max(F.struct("recency", F.struct("id", "ts", "role", "score", "terms", "snippet").alias("r"))).alias("m")
    one = shown.groupBy("query_id", "branch_id", tx.collapsed(F.col("snippet")).alias("_same")).agg(latest).select("query_id", "branch_id", "m.recency", "m.r.*")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("terms").desc(), F.col("recency").desc())
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_same")


def pool(found: Sequence[DataFrame], limit: int = 50) -> DataFrame:
    """Candidates (query_id, id, score, recency) of several searches as one list: each id once, the best first."""
    rows = functools.reduce(DataFrame.unionByName, [f.select("query_id", "id", "score", "recency") for f in found])
    one = rows.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("recency").alias("recency"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("recency").desc(), "id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def reranked(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates in the order of scores from outside (query_id, id, model_score); those without one come last."""
    order = Window.partitionBy("query_id").orderBy(F.col("model_score").desc_nulls_last(), "rank")
    return candidates.join(scores, ["query_id", "id"], "left").withColumn("rank", F.row_number().over(order))


# ---------------------------------------------------------------- must, prefer, exclude


@dataclass
class Structured:
    """Groups that must match, groups that only order, texts that exclude; each text is one phrase."""

    must: list[list[str]] = field(default_factory=list)
    prefer: list[list[str]] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    limit: int = 20


def literal(text: str, path: str) -> Phrase:
    """A text as one phrase of tokens; what the index wouldn't have whole is an error."""
    if "\0" in text or tx.BARRIER in text:
        raise TypeError(f"{path} has a NUL or the index's barrier")
    # Barriers inside the text keep its runs apart; the last one is left out, as a run may go on in a document.
    tokens, _ = tx.index_tokens(tx.nfkc(text))
    if tokens and tokens[-1] == tx.BARRIER:
        tokens.pop()
    if not tokens:
        raise TypeError(f"{path} has no tokens")
    for run, paired in ((m.group(), bool(m["han"])) for m in _LEX.finditer(text)):
        parts = [run] if paired else [p for p in _PIECE.split(run) if p]
        if any(len(p) < 2 for p in parts):
            raise TypeError(f"{path} has a single character, which no index has")
    return Phrase(" ".join(tokens), (TOKENS,))


def structured_plans(query: Structured) -> tuple[Plan, list[Plan], Plan | None]:
    """The plan of the candidates, one for each preferred group, and that of the exclusions."""
    if not query.must and not query.prefer:
        raise TypeError("a query needs a group in must or prefer")
    if query.limit < 1:
        raise TypeError(f"{query.limit} rows can't be asked for")

    def groups(name: str, some: list[list[str]]) -> list[list[Branch]]:
        for i, group in enumerate(some):
            if not group:
                raise TypeError(f"{name}[{i}] is empty")
        return [[(literal(t, f"{name}[{i}].any_of[{j}]"),) for j, t in enumerate(group)] for i, group in enumerate(some)]

    must, prefer = groups("must", query.must), groups("prefer", query.prefer)
    candidates = Plan(must, match="all") if must else Plan([[b for g in prefer for b in g]])
    exclude = Plan([[(literal(t, f"exclude[{i}]"),) for i, t in enumerate(query.exclude)]]) if query.exclude else None
    return candidates, [Plan([g]) for g in prefer], exclude


def structured(index: Index, query: Structured) -> DataFrame:
    """Candidates without excluded documents, those with more preferred groups first, then by score; ``total`` is before the limit."""
    candidates, prefer, exclude = structured_plans(query)
    plans = {"c": candidates, **{f"p{i}": p for i, p in enumerate(prefer)}} | ({"x": exclude} if exclude else {})
    # One plan for all: a document's row for each part it matched, folded by document.
    hits = recall.hits(index, plans)
    folded = hits.groupBy("branch_id", "rowid").agg(
        F.max(F.when(F.col("query_id") == "c", F.col("score"))).alias("score"),
        F.count(F.when(F.col("query_id").startswith("p"), 1)).alias("prefer_groups"),
        F.max(F.col("query_id") == "x").alias("excluded"),
    )
    kept = folded.where("score IS NOT NULL AND NOT excluded").drop("excluded")
    total = kept.agg(F.count("*").alias("total"))  # one row
    best = kept.orderBy(F.col("prefer_groups").desc(), "score", "rowid").limit(query.limit)
    about = index.documents.select("branch_id", "rowid", "id", "text")
    return about.join(F.broadcast(best) if query.limit <= 10_000 else best, ["branch_id", "rowid"]).crossJoin(total)


def cooccurrence(index: Index, plans: Mapping[str, Plan], limit: int = 20) -> DataFrame:
    """The best documents of plans without one row for each content: by score, then order of documents."""
    found = recall.hits(index, plans)
    order = Window.partitionBy("query_id").orderBy("score", "rowid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def without_phrases(spans: list) -> list[list[str]]:
    """The one branch of a surface whose terms need only occur."""
    atoms = atoms_of(spans, phrases=False)
    return [atoms] if atoms else []


# ---------------------------------------------------------------- words of the vocabulary


def words(index: Index, col: int = TOKENS) -> DataFrame:
    """The different terms of a column."""
    return index.postings.where(F.col("col") == col).select("term").distinct()


def with_prefix(index: Index, prefixes: Mapping[str, str], least: int = 0) -> DataFrame:
    """Terms (query_id, term) that begin with a prefix; one shorter than ``least`` matches only itself."""
    conditions = []
    for name, prefix in prefixes.items():
        match = F.col("term").startswith(prefix) if len(prefix) >= least else F.col("term") == prefix
        conditions.append(F.when(match, F.lit(name)))
    named = words(index).select("term", F.explode(F.array_compact(F.array(*conditions))).alias("query_id"))
    return named.select("query_id", "term")


def fuzzy(index: Index, asked: Mapping[str, str], share: float = 0.2, most: int = 6) -> DataFrame:
    """Terms (query_id, term, distance) within an edit distance of ``share`` of a word's length.

    The vocabulary is compared with the few words asked for, each distance cut off at its bound.
    """
    found = []
    for name, word in asked.items():
        bound = min(most, round(len(word) * share))
        near = F.levenshtein(F.col("term"), F.lit(word), bound)
        # Lengths can't differ by more than the bound, which is checked first.
        length = F.length("term").between(len(word) - bound, len(word) + bound)
        found.append(F.when(length & (near >= 0), F.struct(F.lit(name).alias("query_id"), near.alias("distance"))))
    return words(index).select("term", F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.query_id", "term", "f.distance")


# Parameters of the ranking of fuzzy searches, and weights of terms found by prefix and by distance.
FUZZY_K, FUZZY_B, FUZZY_D, PREFIX_WEIGHT, FUZZY_WEIGHT = 1.2, 0.7, 0.5, 0.375, 0.45


def fuzzy_search(index: Index, queries: Mapping[str, str], limit: int = 20, cut: Callable[[str], list[str]] = tx.terms) -> DataFrame:
    """Documents by words, prefixes and near words, ranked by BM25+ with a weight for how a term was found.

    The sum counts as many times as words of the query were found.  ``cut`` is the
    tokenizer that the index was built with.
    """
    asked = {f"{name}\x1f{word}": word for name, query in queries.items() for word in dict.fromkeys(cut(tx.nfkc(query)))}
    prefix = with_prefix(index, asked).withColumn("longer", F.length("term"))
    spark = index.postings.sparkSession
    own = spark.createDataFrame(list(asked.items()), "query_id string, word string")
    starts = prefix.join(recall.small(own, len(asked)), "query_id").select(
        "query_id", "term", F.when(F.col("term") == F.col("word"), 1.0).otherwise(
            PREFIX_WEIGHT * F.length("term") / (F.length("term") + 0.3 * (F.length("term") - F.length("word")))
        ).alias("w"),
    )
    near = fuzzy(index, asked).where("distance > 0").select("query_id", "term", (FUZZY_WEIGHT * F.length("term") / (F.length("term") + F.col("distance"))).alias("w"))
    # A term that is found both ways counts by its prefix.
    terms = starts.unionByName(near.join(starts.select("query_id", "term"), ["query_id", "term"], "left_anti"))
    postings = index.postings.where(F.col("col") == TOKENS).select("branch_id", "rowid", "term", "dl", F.size("places").alias("tf"))
    found = postings.join(terms, "term")
    df = found.groupBy("branch_id", "query_id", "term").agg(F.count("*").alias("df"))
    branch = index.stats.select("branch_id", "n", (F.col("length") / F.col("n")).alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = F.col("w") * idf * (FUZZY_D + F.col("tf") * (FUZZY_K + 1) / (F.col("tf") + FUZZY_K * (1 - FUZZY_B + FUZZY_B * F.col("dl") / F.col("avgdl"))))
    summed = (
        found.join(df, ["branch_id", "query_id", "term"]).join(branch, "branch_id").withColumn("s", score)
        .groupBy(F.substring_index("query_id", "\x1f", 1).alias("query_id"), "branch_id", "rowid").agg((F.sum("s") * F.count_distinct("query_id")).alias("score"))
    )
    named = summed.join(index.documents.select("branch_id", "rowid", "id"), ["branch_id", "rowid"])
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def whole_word_index(docs: DataFrame, branches: int | None = None) -> Index:
    """The index of whole identifiers that :func:`fuzzy_search` ranks as its model does: a document is as long as it has different terms."""
    index = build(docs, unique_ids=True, branches=branches, terms=alternatives.whole_terms)
    different = F.count("*").over(Window.partitionBy("branch_id", "rowid")).cast("int")  # terms of one document
    postings = index.postings.withColumn("dl", different)
    return Index(index.documents, postings, sums(index.documents, postings), branches)


_IRREGULAR = {"went": "go", "gone": "go", "ran": "run", "was": "be", "were": "be", "had": "have", "did": "do", "said": "say", "made": "make", "mice": "mouse", "feet": "foot", "men": "man", "women": "woman", "children": "child", "better": "good", "best": "good"}


def lemma(word: str) -> str:
    """A plain form of an English word: verb endings are tried first, then nouns', then adjectives'; the first change stands."""
    if not (word.isascii() and word.isalpha()):
        return word
    word = word.lower()
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    for rules in _LEMMA_RULES:
        for end, put, least in rules:
            if word.endswith(end) and len(word) - len(end) >= least:
                base = word[: -len(end)] + put
                if len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz" and end in ("ing", "ed", "er", "est"):
                    base = base[:-1]
                return base
    return word


#: Ending, what stands for it, letters that must stay: of verbs, nouns, adjectives.
_LEMMA_RULES = (
    (("ying", "y", 2), ("ing", "", 3), ("ied", "y", 2), ("ed", "", 3)),
    (("ies", "y", 2), ("sses", "ss", 1), ("xes", "x", 2), ("ches", "ch", 2), ("shes", "sh", 2), ("ss", "ss", 0), ("us", "us", 0), ("s", "", 3)),
    (("iest", "y", 2), ("ier", "y", 2), ("est", "", 4)),
)


@F.pandas_udf(T.StringType())
def lemma_udf(word: pd.Series) -> pd.Series:
    return word.map(lambda x: None if x is None else lemma(x))


def inflections(index: Index) -> DataFrame:
    """Words of the vocabulary by lemma: (lemma, words)."""
    plain = words(index).where(F.col("term").rlike("^[a-z]+$"))
    return plain.groupBy(lemma_udf("term").alias("lemma")).agg(F.sort_array(F.collect_set("term")).alias("words"))


def expanded(index: Index, asked: Mapping[str, str]) -> DataFrame:
    """For each word the words of the vocabulary with its lemma (query_id, term), itself included."""
    spark = index.postings.sparkSession
    rows = spark.createDataFrame([(n, w.lower(), lemma(w)) for n, w in asked.items()], "query_id string, word string, lemma string")
    more = inflections(index).join(recall.small(rows, len(asked)), "lemma").select("query_id", F.explode("words").alias("term"))
    return rows.select("query_id", F.col("word").alias("term")).union(more).distinct()


def long_words_first(index: Index, found: DataFrame, long_words: Mapping[str, Sequence[str]]) -> DataFrame:
    """Representatives with ``long_words``, how many of a query's Han words of three characters or more a document has whole."""
    asked = [(q, w) for q, some in long_words.items() for w in some if len(w) >= 3 and all(map(tx.has_han, w))]
    if not asked:
        return found.withColumn("long_words", F.lit(0).cast("long"))
    plans = {f"{q}\x1f{w}": Plan([[(Phrase(" ".join(tx.terms(w)), (TOKENS,)),)]]) for q, w in asked}
    have = recall.hits(index, plans).groupBy(F.substring_index("query_id", "\x1f", 1).alias("query_id"), "branch_id", "rowid").agg(F.count("*").alias("long_words"))
    return found.join(have, ["query_id", "branch_id", "rowid"], "left").withColumn("long_words", F.coalesce("long_words", F.lit(0)))


# ---------------------------------------------------------------- n-grams of characters

_TRIGRAM_LEAST = 3


def trigrams(text: Column) -> Column:
    """The different runs of three characters of the lower-cased text."""
    # A look-ahead takes them in one walk; by places, or in a lambda, the text would be cut anew for each.
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def substring_candidates(docs: DataFrame, grams: DataFrame, needles: Mapping[str, str]) -> DataFrame:
    """Documents (query_id, branch_id, id) that contain a needle, ignoring case.

    ``grams`` (branch_id, id, gram) is a table of trigrams: a document has to have all
    of a needle's before its text is looked at.  Needles of one or two characters
    have none, so all texts are looked at for them.
    """
    spark = docs.sparkSession
    low = {q: n.lower() for q, n in needles.items()}
    asked = [(q, n[i : i + 3]) for q, n in low.items() for i in {n[i : i + 3]: i for i in range(len(n) - 2)}.values()]
    named = spark.createDataFrame(list(low.items()), "query_id string, needle string")
    contains = F.contains(F.lower("text"), F.col("needle"))
    # Needles come from the caller, so for the short ones each text is looked at once, without a join.
    brief = [F.when(F.contains(F.lower("text"), F.lit(n)), F.lit(q)) for q, n in low.items() if len(n) < _TRIGRAM_LEAST]
    found = F.array_compact(F.array(*brief)) if brief else F.array().cast("array<string>")
    out = docs.select("branch_id", "id", F.explode(found).alias("query_id")).select("query_id", "branch_id", "id")
    if asked:
        table = spark.createDataFrame(asked, "query_id string, gram string")
        sizes = table.groupBy("query_id").agg(F.count("*").alias("size"))
        have = grams.join(recall.small(table, len(asked)), "gram").groupBy("query_id", "branch_id", "id").agg(F.count("*").alias("n"))
        full = have.join(sizes, "query_id").where("n = size").join(named, "query_id")
        out = out.union(full.join(docs, ["branch_id", "id"]).where(contains).select("query_id", "branch_id", "id"))
    return out


def tiers(primary: DataFrame, secondary: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, branch_id, id, score) of a first search, then those of a second that the first doesn't have; ``tier`` 0 and 1.

    With ``required``, rows that a search for the short terms found, the second search's have to be among them.
    """
    key = ["query_id", "branch_id", "id"]
    rest = secondary.join(primary.select(*key), key, "left_anti")
    if required is not None:
        rest = rest.join(required.select(*key).distinct(), key, "left_semi")
    return primary.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))


# ---------------------------------------------------------------- places

_ANSWER = regex.compile(r"[\p{L}\p{N}]+")
#: Words of an answer's phrases at least (if it has so many) and at most.
PHRASE = (2, 12)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def answer_words_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [{"word": m.group().lower(), "start": m.start(), "end": m.end()} for m in _ANSWER.finditer(x or "")])


def answer_phrases(answers: DataFrame) -> DataFrame:
    """The phrases (query_id, phrase) of answers (query_id, answer): runs of two to twelve words but of stopwords alone; a single word whole."""
    words = F.transform(answer_words_udf("answer"), lambda w: w["word"])
    rows = answers.select("query_id", words.alias("w")).where(F.size("w") > 0)
    sizes = F.sequence(F.least(F.size("w"), F.lit(PHRASE[0])), F.least(F.size("w"), F.lit(PHRASE[1])))
    sized = rows.select("query_id", "w", F.explode(sizes).alias("n"))
    runs = sized.select("query_id", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("phrase")).distinct()
    plain = F.array(*[F.lit(w) for w in sorted(tx.STOPWORDS)])
    return runs.where(F.size(F.array_except("phrase", plain)) > 0)


#: What each word goes on with: the few words ahead of it, itself first, and their ends; not the whole text.
_AHEAD = (
    T.StructField("word", T.StringType()),
    T.StructField("first", T.IntegerType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("words", T.ArrayType(T.StringType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
)
#: Words that a worker holds at once, besides a text's own Arrow batch.
HELD = 1 << 15


def _ahead(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *columns], names=["id", *(f.name for f in _AHEAD)])


def words_ahead(batches: Iterable[pa.RecordBatch], firsts: frozenset[str] | None = None, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows of each word (with ``firsts``, of those alone) of texts (id, text), however long a text is or many a batch has."""
    for batch in batches:
        rows: list[tuple] = []
        at: list[int] = []

        for row, value in enumerate(batch.column("text")):
            found = _ANSWER.finditer(value.as_py() or "")
            words: list[str] = []
            places: list[tuple[int, int]] = []
            passed = 0  # words before the first of `words`
            while True:
                more = list(itertools.islice(found, held))
                words += [m.group().lower() for m in more]
                places += [m.span() for m in more]
                # The last words wait for those ahead of them, if the text goes on.
                ready = len(words) if len(more) < held else max(0, len(words) - PHRASE[1] + 1)
                for i in range(ready) if firsts is None else [i for i in range(ready) if words[i] in firsts]:
                    end = i + PHRASE[1]
                    rows.append((words[i], passed + i, places[i][0], words[i:end], [e for _, e in places[i:end]]))
                    at.append(row)
                    if len(rows) * PHRASE[1] >= held:
                        yield _ahead(batch, at, rows)
                        at, rows = [], []
                passed += ready
                del words[:ready], places[:ready]
                if len(more) < held:
                    break
        if rows:
            yield _ahead(batch, at, rows)


def answer_places(docs: DataFrame, answers: DataFrame, answers_known: int | None = None) -> DataFrame:
    """Where phrases of answers (query_id, answer) stand in documents (id, text), none inside a longer one.

    Words of the documents join phrases by their first word, and the rest is compared
    where they met.  ``answers_known`` is a bound of the answers' words: if they are few,
    only words that begin a phrase leave the Python worker.  Rows: query_id, id, phrase, first (the number of its first word),
    start, end.
    """
    phrases = answer_phrases(answers).withColumn("word", F.element_at("phrase", 1))
    firsts = None
    # An answer of n words has fewer than 11 n phrases.
    if answers_known is not None and 11 * answers_known <= recall.BROADCAST_ROWS:
        firsts = frozenset(r["word"] for r in phrases.select("word").distinct().collect())
        phrases = F.broadcast(phrases)
    texts = docs.select("id", "text")
    schema = T.StructType([texts.schema["id"], *_AHEAD])
    there = texts.mapInArrow(functools.partial(words_ahead, firsts=firsts), schema)
    met = there.join(phrases, "word").where(F.slice("words", F.lit(1), F.size("phrase")) == F.col("phrase"))
    places = met.select("query_id", "id", F.array_join("phrase", " ").alias("phrase"), "first", "start", F.element_at("ends", F.size("phrase")).alias("end"))
    # In the order of beginnings, the longer first, a place is inside another if one before it reaches as far.
    before = Window.partitionBy("query_id", "id").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return places.withColumn("reached", F.max("end").over(before)).where("reached IS NULL OR reached < end").drop("reached")


def fixed_windows(text: Column, terms: Sequence[str], size: int = WINDOW, ahead: int = 40) -> Column:
    """:func:`fixed_window` as an expression: a struct of begin and end."""
    low = F.lower(text)
    places = F.filter(F.array(*[F.instr(low, t) for t in terms]), lambda p: p > 0)
    begin = F.greatest(F.lit(0), F.coalesce(F.array_min(places) - 1, F.lit(0)) - ahead)
    return F.struct(begin.alias("begin"), F.least(F.length(text), begin + size).alias("end"))


def fixed_window(text: str, terms: Sequence[str], size: int = WINDOW, ahead: int = 40) -> tuple[int, int]:
    """A window that begins ``ahead`` of the first place of any term, ignoring case."""
    low = text.lower()
    first = min((at for at in (low.find(t) for t in terms) if at >= 0), default=0)
    begin = max(0, first - ahead)
    return begin, min(len(text), begin + size)


def within(index: Index, first: str, second: str, distance: int) -> DataFrame:
    """Documents in which two tokens stand with at most ``distance`` tokens between them, in either order."""
    places = lambda t, name: index.postings.where((F.col("term") == t) & (F.col("col") == TOKENS)).select("branch_id", "rowid", F.col("places").alias(name))
    near = F.exists("a", lambda x: F.exists("b", lambda y: (F.abs(x - y) <= distance + 1) & (x != y)))
    return places(first, "a").join(places(second, "b"), ["branch_id", "rowid"]).where(near).select("branch_id", "rowid")


