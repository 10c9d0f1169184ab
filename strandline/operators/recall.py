"""Ranked recall: phrases, boolean groups, BM25, one row for each content, pages.

Any number of queries run in one plan.  Their phrases are a small table; postings
join it by term, so only the postings of query terms are read on.  A phrase of
several tokens intersects the places of its tokens, shifted; everything after that
are aggregates by query and document.

A phrase of a document scores ``idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))``
with ``idf = ln((N - n + 0.5) / (n + 0.5))``, at least ``LEAST_IDF``; ``f`` weighs
occurrences in tokens 1 and in stems 0.5; N, n and avgdl are over the whole branch.
Scores are negative sums, so the least is best.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import snippets
from strandline.functions import text as tx
from strandline.operators.index import STEMS, TOKENS, Index
from strandline.plans.query import Plan

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {TOKENS: 1.0, STEMS: 0.5}
#: Rows of query tables that are broadcast at most; more join by shuffle.
BROADCAST_ROWS = 200_000
#: Terms that go to the scan as a filter at most.
PUSHED_TERMS = 2_000
#: The order of results.
BEST_FIRST = ("score", "ts", "recency", "rowid")


def best_first() -> list:
    return [F.col("score").asc(), F.col("ts").desc(), F.col("recency").desc(), F.col("rowid").desc()]


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a hint to broadcast it if its known number of rows allows that."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class QueryTables:
    """Plans as tables: tokens of phrases, phrases of branches, and what a document needs."""

    tokens: DataFrame
    branches: DataFrame
    needs: DataFrame
    rows: int
    phrases: int
    terms: list[str]


def query_tables(spark: SparkSession, plans: Mapping[str, Plan]) -> QueryTables:
    """The tables of plans by query id.  Equal phrases, of whatever queries, are one."""
    phrases: dict[tuple, int] = {}
    tokens, branches, needs = [], [], []
    for query, plan in plans.items():
        sides = [(g, b, False) for g, group in enumerate(plan.groups) for b in group] + [(-1, b, True) for b in plan.exclude]
        for number, (group, branch, negative) in enumerate(sides):
            for phrase in branch:
                key = (phrase.tokens, phrase.columns)
                if key not in phrases:
                    phrases[key] = len(phrases)
                    tokens += [
                        (phrases[key], i, token, len(phrase.tokens), *(WEIGHTS[c] if c in phrase.columns else 0.0 for c in (TOKENS, STEMS)))
                        for i, token in enumerate(phrase.tokens)
                    ]
                branches.append((query, phrases[key], number, group, len(branch), negative))
        needs.append((query, len(plan.groups) if plan.match == "all" else 1))
    return QueryTables(
        spark.createDataFrame(tokens, "phrase int, i int, term string, k int, w0 double, w1 double"),
        spark.createDataFrame(branches, "query_id string, phrase int, branch int, grp int, size int, negative boolean"),
        spark.createDataFrame(needs, "query_id string, groups int"),
        len(tokens) + len(branches),
        len(phrases),
        sorted({row[2] for row in tokens}),
    )


def phrase_frequencies(index: Index, tables: QueryTables) -> DataFrame:
    """How often (weighted, ``f``) each phrase stands in each document that has it.

    The postings of the query terms are dealt out by document once; what follows by
    document, here and in :func:`hits`, is done where they are.
    """
    postings = index.postings
    if len(tables.terms) <= PUSHED_TERMS:
        # As a filter the terms reach the scan, which skips row groups (or cached batches) without any of them.
        postings = postings.where(F.col("term").isin(tables.terms))
    found = (
        postings.join(small(tables.tokens, tables.rows), "term")
        .withColumn("w", F.when(F.col("col") == TOKENS, F.col("w0")).otherwise(F.col("w1")))
        .where("w > 0")
        # Places are only needed where tokens have to stand side by side: shifted back to the phrase's start.
        .withColumn("s", F.when(F.col("k") > 1, F.transform("places", lambda p: p - F.col("i"))))
        .select("phrase", "branch_id", "rowid", "recency", "dl", "col", "w", "k", F.struct("i", "s", F.size("places").alias("n")).alias("t"))
        .repartition("branch_id", "rowid")
    )
    gathered = found.groupBy("phrase", "branch_id", "rowid", "recency", "dl", "col", "w", "k").agg(F.collect_list("t").alias("l"))
    common = F.aggregate(F.slice("l", 2, 1 << 30), F.element_at("l", 1)["s"], lambda a, x: F.array_intersect(a, x["s"]))
    times = F.when(F.col("k") == 1, F.element_at("l", 1)["n"]).otherwise(F.size(common))
    counted = gathered.where(F.size("l") == F.col("k")).select("phrase", "branch_id", "rowid", "recency", "dl", (F.col("w") * times).alias("f"))
    return counted.where("f > 0").groupBy("phrase", "branch_id", "rowid").agg(F.sum("f").alias("f"), F.first("dl").alias("dl"), F.first("recency").alias("recency"))


def weights(index: Index, frequencies: DataFrame, phrases: int) -> DataFrame:
    """The weight of each phrase in each document that has it."""
    counts = frequencies.groupBy("phrase", "branch_id").agg(F.count("*").alias("df"))
    branch = index.stats.select("branch_id", "n", (F.col("length") / F.col("n")).alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = counts.join(branch, "branch_id").select("phrase", "branch_id", "avgdl", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    if index.branches is not None:
        known = small(known, phrases * index.branches)
    length = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    return frequencies.join(known, ["phrase", "branch_id"]).select(
        "phrase", "branch_id", "rowid", "recency", (F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + length)).alias("weight")
    )


def summed(by: str, weight: Column) -> Column:
    """The sum of weights in the order of ``by``, whatever order rows come in: equal documents have equal scores to the last bit.

    Rows of a group are as few as a query's phrases.  Null weights don't count; of none the sum is null.
    """
    rows = F.array_sort(F.collect_list(F.when(weight.isNotNull(), F.struct(F.col(by).alias("by"), weight.alias("w")))))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda total, row: total + row["w"]))


def hits(index: Index, plans: Mapping[str, Plan], eligible: int | None = None) -> DataFrame:
    """Documents that match, by query, with ``score``.

    ``eligible`` leaves out documents from that recency on; they still count for the
    statistics.  An excluded surface drops its documents and scores nothing.
    """
    spark = index.postings.sparkSession
    tables = query_tables(spark, plans)
    scored = weights(index, phrase_frequencies(index, tables), tables.phrases)
    if eligible is not None and eligible >= 0:
        scored = scored.where(F.col("recency") < eligible)
    by_branch = (
        scored.join(small(tables.branches, tables.rows), "phrase")
        .groupBy("query_id", "branch_id", "rowid", "branch", "grp", "size", "negative")
        .agg(F.count("*").alias("have"), summed("phrase", F.col("weight")).alias("weight"))
        .where("have = size")
    )
    by_document = by_branch.groupBy("query_id", "branch_id", "rowid").agg(
        summed("branch", F.when(~F.col("negative"), F.col("weight"))).alias("weight"),
        F.count_distinct(F.when(~F.col("negative"), F.col("grp"))).alias("groups_met"),
        F.max("negative").alias("excluded"),
    )
    met = by_document.join(small(tables.needs, len(plans)), "query_id").where("NOT excluded AND groups_met >= groups")
    return met.select("query_id", "branch_id", "rowid", (-F.col("weight")).alias("score"))


def representatives(index: Index, found: DataFrame) -> DataFrame:
    """Of each query and content the best document: least score, then latest, then last.

    A maximum by group, which is aggregated before the shuffle, so a content that
    holds most of the documents is no hot task.
    """
    about = index.documents.select("branch_id", "rowid", "content_hash", "ts", "recency")
    best = F.max(F.struct((-F.col("score")).alias("s"), "ts", "recency", "rowid")).alias("b")
    groups = found.join(about, ["branch_id", "rowid"]).groupBy("query_id", "branch_id", "content_hash").agg(best)
    return groups.select("query_id", "branch_id", (-F.col("b.s")).alias("score"), F.col("b.ts").alias("ts"), F.col("b.recency").alias("recency"), F.col("b.rowid").alias("rowid"))


def totals(found: DataFrame) -> DataFrame:
    """How many contents each query found."""
    return found.groupBy("query_id").agg(F.count("*").alias("total"))


def top(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The rows of one page of each query, with ``rank`` from 1."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first())))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def recall(index: Index, plans: Mapping[str, Plan], limit: int = 50, offset: int = 0, eligible: int | None = None) -> DataFrame:
    """Pages of queries: query_id, rank, id, date, role, score, without texts."""
    page = top(representatives(index, hits(index, plans, eligible)), limit, offset)
    return _hydrated(index, page, limit * len(plans)).drop("text")


def _hydrated(index: Index, page: DataFrame, rows: int) -> DataFrame:
    """Pages of ``rows`` rows at most with what their documents say; few rows go to the texts, not the texts to them."""
    about = index.documents.select("branch_id", "rowid", "id", "date", "role", "text")
    return about.join(small(page.select("query_id", "branch_id", "rowid", "rank", "score"), rows), ["branch_id", "rowid"]).select(
        "query_id", "branch_id", "rowid", "rank", "id", "date", "role", "score", "text"
    )


def with_snippets(index: Index, page: DataFrame, plans: Mapping[str, Plan], budget: int = snippets.BUDGET, limit: int = 50) -> DataFrame:
    """Pages, of ``limit`` rows for each query, with a ``snippet`` for each row; only their texts are read for it."""
    asked = term_table({query: plan.snippet_terms for query, plan in plans.items()})

    @F.pandas_udf(T.StringType())
    def snippet(query: pd.Series, text: pd.Series) -> pd.Series:
        hits = term_hits(query, text, asked)
        return pd.Series([snippets.render(t, snippets.select_window(t, hits.get(row, []), budget)) for row, t in enumerate(text)])

    return _hydrated(index, page, limit * len(plans)).withColumn("snippet", snippet("query_id", "text")).drop("text")


def term_table(terms: Mapping[str, list[tuple[str, bool]]]) -> pd.DataFrame:
    """What counts as a hit of queries' terms, a row for each way: (query_id, number, term, kind, gram).

    A span is a hit of a term that it equals (kind ``text``), and of one whose alias,
    its stems or (of a term not so marked) itself, is among the span's stems in a row
    (kind ``stem``).
    """
    rows = [(query, i, term, "text", term) for query, own in terms.items() for i, (term, _) in enumerate(own)]
    rows += [(query, i, term, "stem", " ".join(tx.stems(term)) if stemmed else term) for query, own in terms.items() for i, (term, stemmed) in enumerate(own)]
    return pd.DataFrame([r for r in rows if r[4]], columns=["query_id", "number", "term", "kind", "gram"])


def term_hits(queries: Sequence[str], texts: Sequence[str], asked: pd.DataFrame) -> dict[int, list[tuple[str, int, int]]]:
    """Places of each query's terms in its text, by row: a join of spans with the terms over the vocabulary.

    Every different span is stemmed once, for all rows.
    """
    spans = pd.DataFrame([(row, *span) for row, text in enumerate(texts) for span in tx.spans(text)], columns=["row", "value", "start", "end"])
    widest = int(asked["gram"].str.count(" ").max()) + 1 if len(asked) else 0
    ways = []
    for value in spans["value"].unique():
        ways.append((value, "text", value))
        stems = tx.stems(value)
        ways += [(value, "stem", " ".join(stems[i:j])) for i in range(len(stems)) for j in range(i + 1, min(len(stems), i + widest) + 1)]
    known = pd.DataFrame(ways, columns=["value", "kind", "gram"]).merge(asked, on=["kind", "gram"])
    known = known[["query_id", "value", "number", "term"]].drop_duplicates()
    spans["query_id"] = pd.Series(list(queries), dtype=object).reindex(spans["row"]).to_numpy()
    found = spans.merge(known, on=["query_id", "value"]).sort_values(["row", "start", "end", "number"], kind="stable")
    return {row: list(zip(own["term"], own["start"], own["end"], strict=True)) for row, own in found.groupby("row")}


def snippet_of(text: str, terms: list[tuple[str, bool]], budget: int = snippets.BUDGET) -> str:
    """The snippet of a text for terms, which match by themselves or (if so marked) by their stems too."""
    hits = term_hits(["q"], [text], term_table({"q": terms})).get(0, [])
    return snippets.render(text, snippets.select_window(text, hits, budget))
