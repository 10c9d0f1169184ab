"""Measures of ranked results against relevant ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 20)


def ranked(results: DataFrame, by: Sequence[str] = ("query_id",), order: Sequence[Column] | None = None) -> DataFrame:
    """Results with ``rank`` from 1, by falling ``score`` and id unless an order is given."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*(order or [F.col("score").desc(), F.col("id")]))))


def measures(results: DataFrame, gold: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Of each query with relevant ids: mrr, and ndcg, recall and precision at cutoffs.

    ``results`` has query_id, id, rank; ``gold`` query_id, id.  A query without
    results has zeros.  The ideal order of nDCG has all relevant ids first.
    """
    relevant = gold.select("query_id", "id").distinct()
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("gold"))
    hits = results.join(relevant, ["query_id", "id"])
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    parts = [F.max(F.lit(1.0) / F.col("rank")).alias("mrr")]
    for k in cutoffs:
        inside = F.col("rank") <= k
        parts += [F.count(F.when(inside, 1)).alias(f"hits_{k}"), F.sum(F.when(inside, gain)).alias(f"dcg_{k}")]
    out = sizes.join(hits.groupBy("query_id").agg(*parts), "query_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    columns = ["query_id", "gold", zero("mrr").alias("mrr")]
    for k in cutoffs:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + F.lit(1.0) / F.log2(r + 1))
        columns += [
            (zero(f"dcg_{k}") / ideal).alias(f"ndcg_{k}"),
            (zero(f"hits_{k}") / F.col("gold")).alias(f"recall_{k}"),
            (zero(f"hits_{k}") / k).alias(f"precision_{k}"),
        ]
    return out.select(*columns)


def macro(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """The mean of each measure by groups, queries counting alike."""
    names = [c for c, kind in found.dtypes if kind == "double"]
    return found.groupBy(*by).agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])


def tool_recall(calls: DataFrame, gold: DataFrame, cutoff: int) -> DataFrame:
    """Recall over the first ``cutoff`` results of all calls of a question (query_id, call, id, rank) together."""
    relevant = gold.select("query_id", "id").distinct()
    found = calls.where(F.col("rank") <= cutoff).select("query_id", "id").distinct().join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("located"))
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("gold"))
    return sizes.join(found, "query_id", "left").select("query_id", F.coalesce("located", F.lit(0)).alias("located"), (F.coalesce("located", F.lit(0)) / F.col("gold")).alias("recall"))


def coverage(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """Relevant turns located by arm (arm, query_id, id) and whether all, or any, are; ``queries`` are all that have any."""
    relevant = gold.select("query_id", "id").distinct()
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("gold"))
    located = candidates.select("arm", "query_id", "id").distinct().join(relevant, ["query_id", "id"]).groupBy("arm", "query_id").agg(F.count("*").alias("located"))
    found = located.join(sizes, "query_id").groupBy("arm").agg(
        F.sum("located").alias("located"), F.count("*").alias("any"), F.count_if(F.col("located") == F.col("gold")).alias("all")
    )
    arms = candidates.select("arm").distinct().join(found, "arm", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return arms.crossJoin(sizes.agg(F.count("*").alias("queries"))).select("arm", zero("located"), zero("any"), zero("all"), "queries")  # one row


def overlap(base: DataFrame, other: DataFrame, cutoffs: Sequence[int] = (5, 50), page: str | None = None) -> DataFrame:
    """How much of one list's first ids another has (case, id, rank), over all cases; and hits where the first had none.

    ``exact`` is the share of cases whose lists are equal; ``same_pages`` that of cases
    with equal hashes in a column ``page``.
    """
    one = base.select("case", "id", F.col("rank").alias("a"), *([F.col(page).alias("p")] if page else []))
    two = other.select("case", "id", F.col("rank").alias("b"), *([F.col(page).alias("q")] if page else []))
    both = one.join(two, ["case", "id"], "full")
    counts = [F.count("a").alias("na"), F.count("b").alias("nb"), F.count_if(F.col("a") == F.col("b")).alias("same")]
    for k in cutoffs:
        counts += [F.count_if((F.col("a") <= k) & (F.col("b") <= k)).alias(f"s{k}"), F.count_if(F.col("a") <= k).alias(f"a{k}")]
    if page:
        counts += [F.max("p").alias("p"), F.max("q").alias("q")]
    cases = both.groupBy("case").agg(*counts)
    parts = [F.count("*").alias("cases"), F.count_if((F.col("na") == 0) & (F.col("nb") > 0)).alias("new_on_empty")]
    for k in cutoffs:
        shared, asked = F.sum(f"s{k}"), F.sum(f"a{k}")
        parts += [shared.alias(f"shared_{k}"), asked.alias(f"asked_{k}"), (shared / F.nullif(asked, F.lit(0))).alias(f"coverage_{k}")]
    parts.append(F.avg(((F.col("na") == F.col("same")) & (F.col("nb") == F.col("same"))).cast("double")).alias("exact"))
    if page:
        parts.append(F.avg(F.col("p").eqNullSafe(F.col("q")).cast("double")).alias("same_pages"))
    return cases.agg(*parts)
