"""Registered queries of searches and texts, beside :mod:`strandline.plans.registry`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import alternatives, canonical
from strandline.functions import text as tx
from strandline.functions.patterns import Match
from strandline.metrics import retrieval
from strandline.operators import automatic, branch, grep, index, ranking, recall
from strandline.operators.index import TOKENS, Index, corpus_documents
from strandline.plans.query import plan
from strandline.plans.registry import _COUNTS, _HASH, _SPACE, _STATS, _TERMS, bm25, corpus_index, register, table

# ---------------------------------------------------------------- ranked pages

# A surface matches words and, as it is written, stems: the patterns are of words whose stem it is.
_PAGES = {
    "any": {"concepts": [["license", "apache"], ["version"]]},
    "one": {"concepts": [["version"]]},
    "without": {"concepts": [["the"]], "exclude": ["license"]},
}
_PAGE_PHRASES = ", ".join(
    f"('{q}', '{w}', '{w}', '{stems}', 1.0, {0.0 if stems == '^$' else 0.5})"
    for q, some in (("any", ("license", "apache", "version")), ("one", ("version",)), ("without", ("the",)))
    for w in some
    for stems in ({"version": "^versions?$", "the": "^the(s|ing)?$"}.get(w, "^$"),)
)


@register(
    f"""WITH {bm25(_PAGE_PHRASES)},
hits AS (SELECT query_id, doc_id, -sum(weight) AS score FROM weights GROUP BY ALL),
kept AS (SELECT * FROM hits WHERE query_id <> 'without' OR doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'license')),
one AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id, {_HASH} ORDER BY score, doc_id DESC) AS r FROM kept JOIN documents USING (doc_id)
),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id DESC) AS rank FROM one WHERE r = 1)
SELECT query_id, rank, doc_id::VARCHAR AS id, round(score, 6) AS score FROM ranked WHERE rank > 10 AND rank <= 60"""
)
def recall_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows from 11 to 60 of three concept queries, one for each content, in the order of a page."""
    found = recall.recall(corpus_index(spark, sf_dir), {q: plan(x) for q, x in _PAGES.items()}, limit=50, offset=10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


# What is shown of a row: its text where that fits, else a part of it (without the ellipses) that has a word of the query.
_SHOWN = "CASE WHEN length(text) <= 240 THEN md5(text) END AS whole, true AS inside, true AS shows"


def _shown(page: DataFrame, idx: Index, words: dict[str, str]) -> DataFrame:
    """Pages with what their snippets are like; ``words`` are patterns of what a query may match."""
    asked = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    part = F.regexp_replace("snippet", "^…|…$", "")
    rows = page.join(idx.documents.select("id", "text"), "id")
    return rows.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"), F.when(F.length("text") <= 240, F.md5(F.col("snippet").cast("binary"))).alias("whole"),
        (F.contains("text", part) & (F.length(part) <= 240)).alias("inside"), F.call_function("rlike", F.lower("snippet"), asked[F.col("query_id")]).alias("shows"),
    )


@register(
    f"""WITH {bm25(_PAGE_PHRASES)},
hits AS (SELECT query_id, doc_id, -sum(weight) AS score FROM weights GROUP BY ALL),
kept AS (SELECT * FROM hits WHERE query_id <> 'without' OR doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'license')),
one AS (
  SELECT query_id, doc_id, score, text, row_number() OVER (PARTITION BY query_id, {_HASH} ORDER BY score, doc_id DESC) AS r FROM kept JOIN documents USING (doc_id)
),
ranked AS (SELECT query_id, doc_id, score, text, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id DESC) AS rank FROM one WHERE r = 1)
SELECT query_id, rank, doc_id::VARCHAR AS id, round(score, 6) AS score, {_SHOWN} FROM ranked WHERE rank <= 50"""
)
def recall_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages of a batch of concept queries, and what their snippets show."""
    plans = {q: plan(x) for q, x in _PAGES.items()}
    idx = corpus_index(spark, sf_dir)
    page = recall.top(recall.representatives(idx, recall.hits(idx, plans)), 50)
    return _shown(recall.with_snippets(idx, page, plans), idx, {"any": "licen|apache|version", "one": "version", "without": "the"})


@register(
    f"""WITH {bm25("('q', 'version', 'version', '^versions?$', 1.0, 0.5), ('q', 'the', 'the', '^the(s|ing)?$', 1.0, 0.5)")}
SELECT doc_id::VARCHAR AS id, round(-sum(weight), 6) AS score FROM weights WHERE doc_id < 300 GROUP BY doc_id"""
)
def recall_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an early part of the corpus; the others count for the statistics alone."""
    idx = corpus_index(spark, sf_dir)
    found = recall.hits(idx, {"q": plan({"concepts": [["version", "the"]]})}, eligible=300)
    return found.join(idx.documents.select("branch_id", "rowid", "id"), ["branch_id", "rowid"]).select("id", F.round("score", 6).alias("score"))


# Words and what words of their stem look like; a word that is its own stem is one phrase of both columns.
_HINT_PHRASES = (
    "('known', 0, 'license', '^$', 1.0, 0.0), ('known', 1, '', '^licens(e|es|ed|ing|er|ers|ee|ees)$', 0.0, 0.5), "
    "('known', 2, 'version', '^versions?$', 1.0, 0.5), ('borrowed', 0, 'apache', '^$', 1.0, 0.0), ('borrowed', 1, '', '^apach(e|es|ed|ing)$', 0.0, 0.5)"
)


@register(
    f"""WITH {bm25(_HINT_PHRASES)},
hits AS (SELECT query_id, doc_id, -sum(weight) AS score FROM weights GROUP BY ALL),
one AS (SELECT query_id, doc_id, score, text, row_number() OVER (PARTITION BY query_id, {_HASH} ORDER BY score, doc_id DESC) AS r FROM hits JOIN documents USING (doc_id)),
ranked AS (SELECT query_id, doc_id, score, text, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id DESC) AS rank FROM one WHERE r = 1)
SELECT query_id, rank, doc_id::VARCHAR AS id, round(score, 6) AS score, {_SHOWN} FROM ranked WHERE rank <= 5"""
)
def automatic_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of a message whose words are known, of one that borrows from an earlier text; one that is too long and one too short have none."""
    messages = {
        "known": automatic.Message("which license version is it?"),
        "borrowed": automatic.Message("please tell us about that qqqxq", ["apache of zzzqz it"]),
        "long": automatic.Message("version " * 60),
        "short": automatic.Message("version"),
    }
    idx = corpus_index(spark, sf_dir)
    return _shown(automatic.lookup(idx, messages), idx, {"known": "licens|version", "borrowed": "apach"})


# ---------------------------------------------------------------- index


@register(
    f"""WITH {_STATS}
SELECT (SELECT count(*) FROM documents WHERE text <> '')::BIGINT AS documents, (SELECT count(DISTINCT {_HASH}) FROM documents WHERE text <> '')::BIGINT AS contents,
  (SELECT count(*) FROM tf)::BIGINT AS postings, (SELECT count(DISTINCT term) FROM tf)::BIGINT AS terms, (SELECT sum(dl) FROM dl)::BIGINT AS length"""
)
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, contents, postings and terms of the tokens, and the length of all."""
    idx = corpus_index(spark, sf_dir)
    tokens = Index(idx.documents, idx.postings.where(F.col("col") == TOKENS), idx.stats, 1)
    return index.statistics(tokens).crossJoin(idx.stats.select("length")).select("documents", "contents", "postings", "terms", "length")  # one row each


@register(
    """WITH d AS (SELECT doc_id, doc_id % 50 AS id, text, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) AS r, min(doc_id) OVER (PARTITION BY doc_id % 50) AS first FROM documents)
SELECT id::VARCHAR AS id, first AS rowid, doc_id AS recency, md5(text) AS digest FROM d WHERE r = 1 AND coalesce(text, '') <> ''"""
)
def latest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fifty ids that stand many times the last text, at the first place; an empty last text hides the others."""
    docs = corpus_documents(table(spark, sf_dir, "documents")).withColumns({"id": (F.col("pos") % 50).cast("string"), "recency": F.col("pos"), "text": F.coalesce("text", F.lit(""))})
    return index.latest_by_id(docs).where("text <> ''").select("id", "rowid", "recency", F.md5(F.col("text").cast("binary")).alias("digest"))


@register(
    f"""WITH {_TERMS} SELECT stem, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS occurrences FROM terms
JOIN (VALUES ('licens', '^licens(e|es|ed|ing|er|ers|ee|ees)$'), ('version', '^versions?$'), ('releas', '^releas(e|es|ed|ing|er|ers)$'), ('stupid', '^stupid(s|ity|ly)?$')) v(stem, pattern)
  ON regexp_matches(term, pattern) GROUP BY stem"""
)
def stem_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of four stems."""
    found = index.vocabulary(corpus_index(spark, sf_dir)).where((F.col("col") == index.STEMS) & F.col("term").isin("licens", "version", "releas", "stupid"))
    return found.select(F.col("term").alias("stem"), "docs", F.col("occurrences").cast("long").alias("occurrences"))


# ---------------------------------------------------------------- words


def _lemma_sql(word: str) -> str:
    """The rules for lemmas as SQL: irregular words, then the first ending of verbs, nouns, adjectives that leaves enough letters."""
    cases = [f"WHEN {word} = '{w}' THEN '{base}'" for w, base in ranking._IRREGULAR.items()]
    for rules in ranking._LEMMA_RULES:
        for end, put, least in rules:
            base = f"(left({word}, length({word}) - {len(end)}) || '{put}')"
            if end in ("ing", "ed", "er", "est"):
                base = f"CASE WHEN length({base}) > 3 AND right({base}, 1) = substr({base}, length({base}) - 1, 1) AND right({base}, 1) NOT IN ('l', 's', 'z') THEN left({base}, length({base}) - 1) ELSE {base} END"
            cases.append(f"WHEN ends_with({word}, '{end}') AND length({word}) - {len(end)} >= {least} THEN {base}")
    return f"CASE {' '.join(cases)} ELSE {word} END"


@register(
    f"""WITH {_TERMS}, plain AS (SELECT DISTINCT term FROM terms WHERE regexp_matches(term, '^[a-z]+$'))
SELECT lemma, count(*)::BIGINT AS n, string_agg(term, ',' ORDER BY term) AS words FROM (SELECT term, {_lemma_sql("term")} AS lemma FROM plain) GROUP BY lemma HAVING count(*) > 1"""
)
def inflected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of the vocabulary with several words."""
    found = ranking.inflections(corpus_index(spark, sf_dir)).where(F.size("words") > 1)
    return found.select("lemma", F.size("words").cast("long").alias("n"), F.array_join("words", ",").alias("words"))


_ENGLISH = ", ".join(f"'{w}'" for w in sorted(alternatives.ENGLISH))
_WHOLE = f"""raw AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM raw WHERE term NOT IN ({_ENGLISH}) GROUP BY ALL)"""


@register(f"WITH {_WHOLE} SELECT term, count(*)::BIGINT AS docs, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY term")
def whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of whole identifiers, English stopwords left out."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(alternatives.whole_terms_col(F.col("text"))).alias("term"))
    counted = rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return counted.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


@register(
    f"""WITH {_WHOLE}, asked(word) AS (VALUES ('licence'), ('versio')),
near AS (
  SELECT DISTINCT word, term, levenshtein(term, word) AS far, least(6, round(length(word) * 0.2)) AS bound FROM (SELECT DISTINCT term FROM tf), asked
),
ways AS (
  SELECT word, term, CASE WHEN term = word THEN 1.0 WHEN starts_with(term, word) THEN 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(word)))
    ELSE 0.45 * length(term) / (length(term) + far) END AS w FROM near WHERE starts_with(term, word) OR far <= bound
),
dl AS (SELECT doc_id, count(*) AS dl FROM tf GROUP BY doc_id),
n AS (SELECT count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM documents LEFT JOIN dl USING (doc_id) WHERE text <> ''),
df AS (SELECT word, term, count(*) AS df FROM tf JOIN ways USING (term) GROUP BY ALL),
scored AS (
  SELECT doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * (0.5 + tf * 2.2 / (tf + 1.2 * (0.3 + 0.7 * dl / avgdl)))) * count(DISTINCT word) AS score
  FROM tf JOIN ways USING (term) JOIN df USING (word, term) JOIN dl USING (doc_id), n GROUP BY doc_id
)
SELECT doc_id::VARCHAR AS id, round(score, 6) AS score FROM scored"""
)
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by whole words, prefixes and near words."""
    idx = ranking.whole_word_index(corpus_documents(table(spark, sf_dir, "documents")), branches=1)
    found = ranking.fuzzy_search(idx, {"q": "The licence of versio"}, 1 << 30, alternatives.whole_terms)
    return found.select("id", F.round("score", 6).alias("score"))


@register(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
m AS (
  SELECT doc_id, i, 2 AS size, 'mit license' AS phrase FROM p WHERE w[i] = 'mit' AND w[i + 1] = 'license'
  UNION ALL SELECT doc_id, i, 2, 'the mit' FROM p WHERE w[i] = 'the' AND w[i + 1] = 'mit'
  UNION ALL SELECT doc_id, i, 3, 'the mit license' FROM p WHERE w[i] = 'the' AND w[i + 1] = 'mit' AND w[i + 2] = 'license'
)
SELECT 'q' AS query_id, doc_id::VARCHAR AS id, phrase, (i - 1)::BIGINT AS first FROM m a
WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.doc_id = b.doc_id AND b.size > a.size AND b.i <= a.i AND a.i + a.size <= b.i + b.size)"""
)
def answer_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where phrases of an answer stand, the longest first and none inside another."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    answers = spark.createDataFrame([("q", "The MIT license")], "query_id string, answer string")
    return ranking.answer_places(docs, answers, 3).select("query_id", "id", "phrase", F.col("first").cast("long").alias("first"))


@register(
    """SELECT doc_id::VARCHAR AS id, b::BIGINT AS begin, least(length(text), b + 120)::BIGINT AS end FROM (
  SELECT doc_id, text, greatest(0, CASE WHEN v > 0 AND (l = 0 OR v < l) THEN v - 1 WHEN l > 0 THEN l - 1 ELSE 0 END - 40) AS b
  FROM (SELECT doc_id, text, instr(lower(text), 'version') AS v, instr(lower(text), 'license') AS l FROM documents))"""
)
def first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that begin shortly before the first of two words."""
    window = ranking.fixed_windows(F.col("text"), ["version", "license"])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), window.alias("w"))
    return docs.select("id", F.col("w.begin").cast("long").alias("begin"), F.col("w.end").cast("long").alias("end"))


# ---------------------------------------------------------------- regular expressions and shown text


@register(
    f"""SELECT doc_id::VARCHAR AS id, md5(regexp_replace(substr(text, greatest(0, p0 - 160) + 1, least(length(text), p0 + 7 + 160) - greatest(0, p0 - 160)), '{_SPACE}', ' ', 'g')) AS digest
FROM (SELECT doc_id, text, instr(lower(text), 'license') - 1 AS p0 FROM documents) WHERE p0 >= 0"""
)
def grep_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that a page of matches would show for the first one in each document."""

    @F.pandas_udf(T.StringType())
    def line(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([grep.snippet(t, Match(0, a, a + 7), grep.LINE)[0] for t, a in zip(text, at, strict=True)])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.instr(F.lower("text"), "license") - 1).alias("at")).where("at >= 0")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.md5(line("text", "at").cast("binary")).alias("digest"))


@register(
    r"""SELECT conv_id::VARCHAR || ':' || turn AS id,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('{"id":"' || conv_id || ':' || turn || '","text":' || to_json(coalesce(text, '')) || '}',
    '<', '\\u003c', 'g'), '>', '\\u003e', 'g'), '\[', '\\u005b', 'g'), '\]', '\\u005d', 'g'), '`', '\\u0060', 'g')) AS digest FROM conversations"""
)
def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as JSON that can't end a tag or a list."""

    @F.pandas_udf(T.StringType())
    def shown(name: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([canonical.safe_json({"id": n, "text": t}) for n, t in zip(name, text, strict=True)])

    rows = branch.projected(branch.conversation_entries(table(spark, sf_dir, "conversations")))
    return rows.select("id", F.md5(shown("id", "readable").cast("binary")).alias("digest"))


@register("""SELECT conv_id::VARCHAR || ':' || turn AS id, sha256('{"role":' || to_json(role) || ',"text":' || to_json(coalesce(text, '')) || ',"turn":' || turn || '}') AS hash FROM conversations""")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of messages as objects whose keys come in another order."""
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.to_json(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), "role")).alias("j")
    )
    return rows.select("id", canonical.canonical_hash_udf("j").alias("hash"))


@register(r"SELECT doc_id::VARCHAR AS id FROM documents WHERE regexp_matches(text, '(?i)capacity|overloaded|rate.?limit|too many requests|\b429\b|\b529\b|quota')")
def capacity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that read as if a provider had no room."""
    from strandline.metrics import reports

    return reports.capacity_errors(table(spark, sf_dir, "documents"), "text").select(F.col("doc_id").cast("string").alias("id"))


# ---------------------------------------------------------------- tiers and pools

_FOUND = "SELECT (doc_id % 3)::VARCHAR AS query_id, doc_id::VARCHAR AS id"


def _scored(spark: SparkSession, sf_dir: str, keep: str, score: str) -> DataFrame:
    """Documents as the rows of a search for three queries."""
    docs = table(spark, sf_dir, "documents").where(keep)
    return docs.select((F.col("doc_id") % 3).cast("string").alias("query_id"), F.lit("corpus").alias("branch_id"), F.col("doc_id").cast("string").alias("id"), F.expr(score).cast("double").alias("score"), F.col("doc_id").alias("recency"))


@register(
    f"""WITH a AS ({_FOUND} FROM documents WHERE doc_id % 5 = 0), b AS ({_FOUND} FROM documents WHERE doc_id % 2 = 0), s AS ({_FOUND} FROM documents WHERE n_chars > 1000)
SELECT query_id, id, 0 AS tier FROM a UNION ALL SELECT query_id, id, 1 FROM b WHERE id NOT IN (SELECT id FROM a) AND id IN (SELECT id FROM s)"""
)
def tiered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a first search, and those of a second that it lacks and a third one has."""
    found = ranking.tiers(_scored(spark, sf_dir, "doc_id % 5 = 0", "n_chars"), _scored(spark, sf_dir, "doc_id % 2 = 0", "n_chars"), _scored(spark, sf_dir, "n_chars > 1000", "n_chars"))
    return found.select("query_id", "id", "tier")


@register(
    """WITH f AS (SELECT doc_id % 3 AS q, doc_id, n_chars AS s FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id % 3, doc_id, 1000 + doc_id % 700 FROM documents WHERE doc_id % 4 <> 1),
one AS (SELECT q, doc_id, max(s) AS s FROM f GROUP BY ALL),
pool AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, doc_id DESC) AS r FROM one)
SELECT q::VARCHAR AS query_id, doc_id::VARCHAR AS id, r AS pooled, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN doc_id % 3 <> 0 OR doc_id % 6 = 0 THEN doc_id % 11 END DESC NULLS LAST, r) AS rank
FROM pool WHERE r <= 50"""
)
def reranked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best of two searches together, in the order of scores from outside, of which some lack."""
    pool = ranking.pool([_scored(spark, sf_dir, "doc_id % 2 = 0", "n_chars"), _scored(spark, sf_dir, "doc_id % 4 <> 1", "1000 + doc_id % 700")], 50).withColumn("pooled", F.col("rank"))
    outside = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0 OR doc_id % 6 = 0").select((F.col("doc_id") % 3).cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 11).cast("double").alias("model_score"))
    found = ranking.reranked(pool.drop("score"), outside)
    return found.select("query_id", "id", F.col("pooled").cast("long").alias("pooled"), F.col("rank").cast("long").alias("rank"))


@register(
    """WITH a AS (SELECT doc_id % 40 AS c, doc_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE doc_id % 40 <> 7),
b AS (SELECT doc_id % 40 AS c, doc_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY CASE WHEN doc_id % 40 < 20 THEN n_chars ELSE doc_id END DESC, doc_id) AS r FROM documents),
j AS (SELECT coalesce(a.c, b.c) AS c, a.r AS ra, b.r AS rb FROM a FULL JOIN b ON a.c = b.c AND a.doc_id = b.doc_id),
p AS (SELECT c, count(ra) AS na, count(rb) AS nb, count(*) FILTER (ra = rb) AS same, count(*) FILTER (ra <= 5 AND rb <= 5) AS s5, count(*) FILTER (ra <= 5) AS a5 FROM j GROUP BY c)
SELECT count(*)::BIGINT AS cases, count(*) FILTER (na = 0 AND nb > 0)::BIGINT AS new_on_empty, sum(s5)::BIGINT AS shared_5, sum(a5)::BIGINT AS asked_5, round(sum(s5) / sum(a5), 6) AS coverage_5,
  round(avg(CASE WHEN na = same AND nb = same THEN 1.0 ELSE 0 END), 6) AS exact FROM p"""
)
def overlap_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two orders of documents agree in forty cases, of which one is empty in the first."""
    case = F.col("doc_id") % 40
    docs = table(spark, sf_dir, "documents").select(case.alias("case"), F.col("doc_id").alias("id"), "n_chars", "doc_id")
    one = retrieval.ranked(docs.where("case <> 7").withColumn("score", F.col("n_chars")), ["case"])
    two = retrieval.ranked(docs.withColumn("score", F.when(F.col("case") < 20, F.col("n_chars")).otherwise(F.col("doc_id"))), ["case"])
    found = retrieval.overlap(one, two, (5,))
    return found.withColumns({c: F.round(c, 6) for c in ("coverage_5", "exact")})


@register(
    f"""WITH {_COUNTS} SELECT doc_id::VARCHAR AS id, count(*)::BIGINT AS terms FROM tf WHERE term IN ('license', 'version', 'under') GROUP BY doc_id HAVING count(*) >= 2"""
)
def cooccurring_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two of three terms at least, wherever they stand."""
    idx = corpus_index(spark, sf_dir)
    postings = idx.postings.where(F.col("col") == TOKENS).where(F.col("term").isin("license", "version", "under"))
    counted = postings.groupBy("branch_id", "rowid").agg(F.count("*").alias("terms")).where("terms >= 2")
    return counted.join(idx.documents.select("branch_id", "rowid", "id"), ["branch_id", "rowid"]).select("id", "terms")


@register("SELECT doc_id::VARCHAR AS id, len(string_split(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '))::BIGINT AS words, md5(text) AS digest FROM documents WHERE doc_id % 2 = 0 OR doc_id % 2 = 1")
def plain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with pairs put for runs of Han and kana, which these have none of."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), alternatives.paired_text_udf("text").alias("text"))
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")), " "))
    return docs.select("id", words.cast("long").alias("words"), F.md5(F.col("text").cast("binary")).alias("digest")).where(F.col("id").isNotNull())


@register(
    """SELECT doc_id::VARCHAR AS id, length(text)::BIGINT AS points, strlen(text)::BIGINT AS bytes, substr(text, 11, 20) AS part FROM documents"""
)
def code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of texts in code points and bytes, and a part by code points."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.length("text").cast("long").alias("points"), F.octet_length("text").cast("long").alias("bytes"), F.substring("text", 11, 20).alias("part"))


assert tx.BARRIER  # the barrier is no term of these texts, so queries need not leave it out
