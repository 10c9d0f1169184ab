"""Operator 10: URL filters, with DataFrame functions only.

A rule has a host, a path and a verdict; it fits URLs on its host and all its
subdomains whose path starts with its path.  Each URL is expanded into the
expressions under which a rule for it could stand: host suffixes by whole labels
times path prefixes, for the label counts and path lengths that any rule has, so
that no rule is missed.  Expressions join rules by a short prefix of their digest;
then the whole digests must agree, and the longest rule wins (of equally long
ones the one that sorts last; of a rule given twice, ``block``).

The verdict depends on the URL alone, so equal URLs are judged once: they are
counted before the expansion.  Rows come back by URL, and one that holds more than
1/4096 of them is broadcast on the way instead of shuffled, whether a rule fits it
or not.  Null URLs take no part in any of this.  Rules are broadcast up to
``BROADCAST_RULES`` and joined by shuffle beyond.

Null URLs and those without ``://`` have an empty host and path, and no rule fits.
An empty path starts with no path but the empty one.  Repeated pages and ids are
all kept; an empty table gives no rows, no rules give every page the default.  Only
id and URL are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import join_counted, written

#: Host, path and verdict.  Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
BROADCAST_RULES = 100_000
#: Hexadecimal digits of a digest that rules are joined by.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, with A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as a table: host, path, verdict."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    kind = "array<struct<host: string, path: string, verdict: string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of so many labels times path prefixes of so many characters, joined."""
    has = F.size(F.split(host, r"\."))
    suffixes = [F.when(has >= k, F.substring_index(host, ".", -k)) for k in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_distinct(F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes])))


def _numbered(rules: DataFrame, few: bool) -> DataFrame:
    """Rules with ``place``, their order of precedence: the longest last, of equally long ones the one that sorts last.

    Many rules are numbered range by range, and written, since the ranges of another run may differ.
    """
    order = [F.length("rule"), F.col("rule")]
    if few:
        return rules.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return written(rules.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "rules")


def judged(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """Id, ``host``, ``path``, ``rule`` (or null) and ``verdict`` of each row of ``pages``."""
    given = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    known = given.groupBy(F.concat("host", "path").alias("rule")).agg(
        F.max("verdict").alias("verdict"),  # of a rule given twice, block
        F.collect_set(F.struct(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))).alias("shapes"),
    )
    shape = known.select("rule", F.explode("shapes").alias("s")).agg(
        F.collect_set("s.labels").alias("labels"), F.collect_set("s.length").alias("lengths"), F.count_distinct("rule").alias("n")
    ).first()
    named = _numbered(known.select("rule", "verdict"), shape["n"] <= broadcast_rules)
    by_digest = named.select("place", F.sha2("rule", 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    by_place = named
    if shape["n"] <= broadcast_rules:
        by_digest, by_place = F.broadcast(by_digest), F.broadcast(by_place)
    ids = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("u"))
    counted = ids.where("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("n"))
    expanded = counted.select("u", "n", F.explode(expressions(host_of(F.col("u")), path_of(F.col("u")), sorted(shape["labels"]), sorted(shape["lengths"]))).alias("e"))
    hashed = expanded.select("u", "n", F.sha2("e", 256).alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    fits = hashed.join(by_digest, "short").where("full = digest").select("u", "n", "place")
    # URLs that no rule fits stay too, with place -1: a hot one of them has to be known as hot.
    best = fits.unionByName(counted.select("u", "n", F.lit(-1).cast("long").alias("place"))).groupBy("u").agg(F.max("n").alias("n"), F.max("place").alias("place"))
    total = ids.where("u IS NOT NULL").count()
    judged_ids = join_counted(ids.where("u IS NOT NULL"), best, "u", "n", total)
    ruled = judged_ids.where("place >= 0").join(by_place, "place").select("id", "u", "rule", "verdict")
    null = F.lit(None).cast("string")
    free = judged_ids.where("place < 0").select("id", "u").unionByName(ids.where("u IS NULL"))
    return ruled.unionByName(free.select("id", "u", null.alias("rule"), null.alias("verdict"))).select(
        F.col("id").alias(id_col),
        host_of(F.col("u")).alias("host"),
        path_of(F.col("u")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
