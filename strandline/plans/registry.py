"""The registered queries over the test tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.metrics import reports, retrieval
from strandline.operators import automatic, branch, expand, grep, ranking, recall
from strandline.operators.index import TOKENS, Index, build, corpus_documents, spread, vocabulary, working_folder
from strandline.plans.query import Phrase, Plan, plan
from strandline.sources import corpora, traces
from strandline.streaming import cadence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strandline.plans import measured, searched  # noqa: F401  they register theirs

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


_STORED: dict[tuple[str, str], str] = {}


def corpus_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index over ``documents``, whose ids are unique: built and saved once for a session, and read by its queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{working_folder(spark)}/strandline-index-{uuid.uuid4().hex}"
        index = build(corpus_documents(table(spark, sf_dir, "documents")), unique_ids=True, branches=1)
        index.save(path, max(8, 2 * spark.sparkContext.defaultParallelism))
        _STORED[key] = path
    return Index.load(spark, _STORED[key], 1)


# ---------------------------------------------------------------- SQL parts

_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_WORD = r"[\p{L}\p{N}\p{M}_$]+"
#: Terms of documents without Han and kana: words inside runs, and whole dotted runs.
_TERMS = rf"""
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}(?:\.{_WORD})*')) AS run FROM documents),
cut AS (
  SELECT doc_id, regexp_replace(regexp_replace(run, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g') AS run FROM runs
),
words AS (SELECT doc_id, lower(unnest(string_split_regex(run, '[_$.\s]+'))) AS term FROM cut),
terms AS (
  SELECT doc_id, term FROM words WHERE length(term) >= 2
  UNION ALL SELECT * FROM (SELECT doc_id, unnest(string_split_regex(lower(run), '[_$]+')) AS term FROM runs WHERE contains(run, '.')) WHERE term <> ''
)"""
_COUNTS = f"{_TERMS}, tf AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY ALL)"
_HASH = f"sha256(trim(regexp_replace(text, '{_SPACE}', ' ', 'g')))"


# ---------------------------------------------------------------- text and index


@register(
    f"""SELECT doc_id, content_hash FROM (
  SELECT doc_id, {_HASH} AS content_hash, row_number() OVER (PARTITION BY {_HASH} ORDER BY doc_id DESC) AS r FROM documents WHERE text <> ''
) WHERE r = 1"""
)
def doc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last document of each content."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.groupBy(tx.content_hash(F.col("text")).alias("content_hash")).agg(F.max("doc_id").alias("doc_id")).select("doc_id", "content_hash")


@register(f"WITH {_COUNTS} SELECT term, count(*)::BIGINT AS docs, sum(n)::BIGINT AS occurrences FROM tf GROUP BY term")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of each token."""
    found = vocabulary(corpus_index(spark, sf_dir)).where((F.col("col") == TOKENS) & (F.col("term") != tx.BARRIER))
    return found.select("term", "docs", F.col("occurrences").cast("long").alias("occurrences"))


@register(
    f"""WITH {_COUNTS}, df AS (SELECT term, count(*)::BIGINT AS docs FROM tf GROUP BY term)
SELECT term, docs, rank FROM (SELECT term, docs, row_number() OVER (ORDER BY docs DESC, term) AS rank FROM df) WHERE rank <= 50"""
)
def df_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty terms that most documents have."""
    found = vocabulary(corpus_index(spark, sf_dir)).where(F.col("col") == TOKENS).select("term", "docs")
    best = found.orderBy(F.col("docs").desc(), "term").limit(50)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("docs").desc(), "term")).cast("long"))


@register(
    f"""WITH {_TERMS}, plain AS (SELECT DISTINCT term FROM terms WHERE regexp_matches(term, '^[a-z]{{4,}}$'))
SELECT count(*)::BIGINT AS terms, sum(length(term))::BIGINT AS letters FROM plain"""
)
def vocabulary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different plain words of four letters or more."""
    found = ranking.words(corpus_index(spark, sf_dir)).where(F.col("term").rlike("^[a-z]{4,}$"))
    return found.agg(F.count("*").alias("terms"), F.sum(F.length("term")).cast("long").alias("letters"))


@register(
    """SELECT doc_id, length(text)::BIGINT AS weight, length(text) <= 280 AS passes, strlen(trim(text)) > 10 AS long_enough FROM documents"""
)
def weighted_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents an automatic query would take as a message."""
    weight = tx.weighted_length_col(F.col("text"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", weight.cast("long").alias("weight"), (weight <= automatic.GATE).alias("passes"), (F.octet_length(F.trim("text")) > automatic.LEAST_BYTES).alias("long_enough"))


# ---------------------------------------------------------------- ranked recall

_TOKEN_QUERY = ["license", "version", "the", "reen", "tion"]
#: Lengths as the index has them: tokens, and a stem for each plain ASCII word.
_STATS = f"""{_COUNTS},
dl AS (SELECT doc_id, sum(n) + coalesce(sum(n) FILTER (regexp_matches(term, '^[a-z0-9]+$')), 0) AS dl FROM tf GROUP BY doc_id),
n AS (SELECT count(*) AS n, avg(coalesce(dl, 0)) AS avgdl FROM documents LEFT JOIN dl USING (doc_id) WHERE text <> '')"""


def bm25(phrases: str) -> str:
    """SQL parts: phrases (query_id, phrase, pattern, w0, w1) with their score in each document; patterns are those of tokens and of words by stem."""
    return f"""{_STATS},
asked(query_id, phrase, word, stems, w0, w1) AS (VALUES {phrases}),
f AS (
  SELECT query_id, phrase, doc_id, sum(CASE WHEN term = word THEN w0 * n ELSE 0 END + CASE WHEN regexp_matches(term, stems) THEN w1 * n ELSE 0 END) AS f
  FROM tf JOIN asked ON (term = word AND w0 > 0) OR (w1 > 0 AND regexp_matches(term, stems)) GROUP BY ALL
),
df AS (SELECT query_id, phrase, count(*) AS df FROM f GROUP BY ALL),
idf AS (SELECT query_id, phrase, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, n),
weights AS (SELECT query_id, phrase, doc_id, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM f JOIN idf USING (query_id, phrase) JOIN dl USING (doc_id), n)"""


@register(
    f"""WITH {bm25(", ".join(f"('q', {i}, '{t}', '^$', 1.0, 0.0)" for i, t in enumerate(_TOKEN_QUERY)))}
SELECT doc_id::VARCHAR AS id, round(-sum(weight), 6) AS score FROM weights GROUP BY doc_id"""
)
def recall_bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of documents with any of five tokens, over the index's own lengths."""
    index = corpus_index(spark, sf_dir)
    asked = Plan([[(Phrase(t, (TOKENS,)),) for t in _TOKEN_QUERY]])
    found = recall.hits(index, {"q": asked})
    return found.join(index.documents.select("branch_id", "rowid", "id"), ["branch_id", "rowid"]).select("id", F.round("score", 6).alias("score"))


def _has(*words: str) -> str:
    return f"coalesce(bool_or(term IN ({', '.join(repr(w) for w in words)})), false)"


# A surface matches words and, as it is written, stems: words whose stem it is.  Of most words that end with e no word's stem is.
_VERSION = "coalesce(bool_or(regexp_matches(term, '^versions?$')), false)"
_THE = "coalesce(bool_or(regexp_matches(term, '^the(s|ing)?$')), false)"
_BOOLEAN = {
    "any": {"concepts": [["license", "apache"], ["version"]]},
    "all": {"concepts": [["the", "apache"], ["license"]], "match": "all"},
    "exclude": {"concepts": [["license", "the"]], "exclude": ["version", "apache"]},
}


@register(
    f"""WITH {_TERMS} SELECT query_id, doc_id::VARCHAR AS id FROM (
  SELECT doc_id, {_has("license", "apache")} OR {_VERSION} AS a, ({_THE} OR {_has("apache")}) AND {_has("license")} AS b,
    ({_has("license")} OR {_THE}) AND NOT {_VERSION} AND NOT {_has("apache")} AS c FROM terms GROUP BY doc_id
), (VALUES ('any'), ('all'), ('exclude')) v(query_id) WHERE CASE query_id WHEN 'any' THEN a WHEN 'all' THEN b ELSE c END"""
)
def recall_any_all_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents three boolean queries find in tokens."""
    index = corpus_index(spark, sf_dir)
    found = recall.hits(index, {name: plan(q) for name, q in _BOOLEAN.items()})
    return found.join(index.documents.select("branch_id", "rowid", "id"), ["branch_id", "rowid"]).select("query_id", "id")


@register(
    f"""WITH {_TERMS}, hit AS (SELECT doc_id FROM terms GROUP BY doc_id HAVING {_has("license", "apache")} OR {_VERSION})
SELECT 'q' AS query_id, count(DISTINCT {_HASH})::BIGINT AS total FROM documents JOIN hit USING (doc_id)"""
)
def recall_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different contents a query finds."""
    index = corpus_index(spark, sf_dir)
    found = recall.representatives(index, recall.hits(index, {"q": plan({"concepts": [["license", "apache", "version"]]})}))
    return recall.totals(found)


@register(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+') AS w FROM documents)
SELECT doc_id::VARCHAR AS id, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t)
WHERE w[i] = 'under' AND w[i + 1] = 'the' AND w[i + 2] IN ('mit', 'apache') GROUP BY doc_id"""
)
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one of two phrases of three tokens stands in each document."""
    index = corpus_index(spark, sf_dir)
    plans = {name: Plan([[(Phrase(f"under the {name}", (TOKENS,)),)]]) for name in ("mit", "apache")}
    tables = recall.query_tables(spark, plans)
    found = recall.phrase_frequencies(index, tables).groupBy("branch_id", "rowid").agg(F.sum("f").cast("long").alias("tf"))
    return found.join(index.documents.select("branch_id", "rowid", "id"), ["branch_id", "rowid"]).select("id", "tf")


# ---------------------------------------------------------------- grep and expand

_PATTERN = "tion|the|License"


@register(
    f"""SELECT doc_id::VARCHAR AS id, len(regexp_extract_all(text, '(?i){_PATTERN}'))::BIGINT AS matches FROM documents
WHERE regexp_matches(text, '(?i){_PATTERN}')"""
)
def grep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a pattern in each document that has any."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return grep.counted(docs, _PATTERN, "text").select("id", "matches")


@register(r"SELECT coalesce(sum(len(regexp_extract_all(text, '(?i)\b[a-z]*ing\b'))), 0)::BIGINT AS total, count(*)::BIGINT AS entries FROM documents WHERE regexp_matches(text, '(?i)\b[a-z]*ing\b')")
def grep_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and matching entries of a pattern that needs the exact engine."""
    docs = table(spark, sf_dir, "documents").select("text")
    return grep.totals(grep.counted(docs, r"\b[a-z]*ing\b", "text")).select(F.col("total").cast("long").alias("total"), "entries")


def _conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch.conversation_entries(table(spark, sf_dir, "conversations"))


@register(
    """WITH c AS (SELECT conv_id::VARCHAR AS branch_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT a.branch_id, a.branch_id || ':' || a.turn AS target_id, (b.n - a.n)::BIGINT AS at, b.branch_id || ':' || b.turn AS id
FROM c a JOIN c b ON a.branch_id = b.branch_id AND b.n - a.n BETWEEN -2 AND 2 WHERE a.turn % 3 = 1"""
)
def expand_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn of each conversation with the two before and after it."""
    entries = branch.projected(_conversation_entries(spark, sf_dir))
    found = expand.neighbourhood(entries, entries.where("pos % 3 = 1"))
    return found.select("branch_id", "target_id", F.col("at").cast("long").alias("at"), "id")


# ---------------------------------------------------------------- branches


def _with_edits(entries: DataFrame) -> DataFrame:
    """Conversations with edits and compactions that differ by the conversation's number modulo 6.

    0: none, and no compaction.  Else turn 1 is replaced and turn 2 omitted, and turn 4
    is kept first.  2: turn 1 is replaced twice, the later edit counts.  3: the kept id
    stands nowhere, so the compaction itself is the boundary.  4: a second compaction
    keeps turn 6.  5: an edit of turn 0 comes after the compaction and counts too.
    """
    text = lambda word: F.concat(F.lit(f"{word} "), F.col("branch_id"))
    block = lambda word: F.array(F.struct(F.lit("text").alias("type"), text(word).alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments")))
    none = F.lit(None).cast("string")
    ends = entries.groupBy("branch_id").agg(F.max("pos").alias("last")).withColumn("kind", F.col("branch_id").cast("long") % 6)

    def extra(kinds: tuple, at: int, kind: str, target=none, replacement=F.lit(None), omit=F.lit(None), kept=none) -> DataFrame:
        return ends.where(F.col("kind").isin(*kinds)).select(
            "branch_id", (F.col("last") + at).alias("pos"), F.lit(kind).alias("type"), F.concat(F.lit(f"{kind}-{at}-"), "branch_id").alias("id"), none.alias("ts"), none.alias("role"),
            F.lit(None).cast(branch.ENTRY["content"].dataType).alias("content"), target.alias("target_id"), replacement.cast(branch.ENTRY["replacement"].dataType).alias("replacement"),
            omit.cast("boolean").alias("omit"), kept.alias("first_kept_id"),
        )

    turn = lambda n: F.concat_ws(":", "branch_id", F.lit(str(n)))
    edited = (1, 2, 3, 4, 5)
    parts = [
        extra(edited, 1, "context_edit", turn(1), block("edited"), F.lit(False)),
        extra(edited, 2, "context_edit", turn(2), F.lit(None), F.lit(True)),
        extra((2,), 3, "context_edit", turn(1), block("again"), F.lit(False)),
        extra((1, 2, 4, 5), 4, "compaction", kept=turn(4)),
        extra((3,), 4, "compaction", kept=F.lit("nowhere")),
        extra((4,), 5, "compaction", kept=turn(6)),
        extra((5,), 6, "context_edit", turn(0), block("late"), F.lit(False)),
    ]
    for part in parts:
        entries = entries.unionByName(part)
    return entries


_SEARCHABLE = "role IN ('user', 'assistant')"


@register(
    f"""WITH c AS (SELECT conv_id::VARCHAR AS branch_id, conv_id % 6 AS kind, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last,
  min(turn) FILTER (turn = 4) OVER (PARTITION BY conv_id) AS four, min(turn) FILTER (turn = 6) OVER (PARTITION BY conv_id) AS six FROM conversations)
SELECT branch_id, branch_id || ':' || turn AS id,
  md5(CASE WHEN turn = 1 AND {_SEARCHABLE} THEN CASE kind WHEN 2 THEN 'again ' ELSE 'edited ' END || branch_id
    WHEN turn = 0 AND kind = 5 AND {_SEARCHABLE} THEN 'late ' || branch_id ELSE coalesce(text, '') END) AS digest, {_SEARCHABLE} AS searchable
FROM c WHERE kind <> 0 AND turn <> 2 AND turn < CASE kind WHEN 3 THEN last + 4 WHEN 4 THEN coalesce(six, last + 5) ELSE coalesce(four, last + 4) END"""
)
def branch_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a compaction moved out of each conversation, with edits applied."""
    found = branch.compacted(_with_edits(_conversation_entries(spark, sf_dir)))
    return found.select("branch_id", "id", F.md5(F.col("readable").cast("binary")).alias("digest"), F.col("searchable").isNotNull().alias("searchable"))


@register(f"SELECT conv_id::VARCHAR AS branch_id, count(*)::BIGINT AS messages, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations WHERE {_SEARCHABLE} GROUP BY conv_id")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable messages and characters of each conversation."""
    found = branch.documents(branch.projected(_conversation_entries(spark, sf_dir)))
    return found.groupBy("branch_id").agg(F.count("*").alias("messages"), F.sum(F.length("text")).cast("long").alias("chars"))


@register(
    """WITH u AS (SELECT conv_id::VARCHAR AS branch_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user')
SELECT branch_id, md5(max(text) FILTER (r = 1)) AS last, count(*) FILTER (r BETWEEN 2 AND 3)::BIGINT AS recent FROM u GROUP BY branch_id"""
)
def recent_user_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message of each conversation's user, and how many there are to borrow from."""
    found = branch.recent_user_texts(branch.projected(_conversation_entries(spark, sf_dir)))
    return found.select("branch_id", F.md5(F.col("text").cast("binary")).alias("last"), F.size("recent").cast("long").alias("recent"))


@register(
    """SELECT conv_id::VARCHAR AS branch_id, conv_id::VARCHAR || ':' || turn AS id,
  floor(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) / 4.84)::BIGINT AS tokens FROM conversations"""
)
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of each conversation up to each turn."""
    rows = branch.projected(_conversation_entries(spark, sf_dir))
    return corpora.estimated_tokens(rows, "branch_id", "pos", "readable").select("branch_id", "id", "tokens")


@register("SELECT conv_id::VARCHAR AS branch_id, sum(ceil(length(coalesce(text, '')) / 4))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rough number of tokens of each conversation."""
    return corpora.context_tokens(branch.projected(_conversation_entries(spark, sf_dir)), text="readable")


# ---------------------------------------------------------------- further searches

_RARITY = "license version reen stupid"


@register(
    rf"""WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS run FROM documents WHERE text <> ''),
cut AS (SELECT doc_id, run, regexp_replace(regexp_replace(run, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g') AS parts FROM runs),
terms AS (SELECT doc_id, lower(run) AS term FROM runs UNION ALL SELECT doc_id, lower(unnest(string_split_regex(parts, '[_$ ]+'))) FROM cut),
hit AS (SELECT DISTINCT doc_id, term FROM terms WHERE term IN ('license', 'version', 'reen', 'stupid')),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term), n AS (SELECT count(*) AS n FROM documents WHERE text <> '')
SELECT doc_id::VARCHAR AS id, round(sum(1 + ln((n + 1) / (df + 1))), 6) AS score, count(*)::BIGINT AS terms FROM hit JOIN df USING (term), n GROUP BY doc_id"""
)
def legacy_idf_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the rarity of the query terms that they have."""
    docs = corpus_documents(table(spark, sf_dir, "documents")).withColumn("recency", F.col("pos")).where("text <> ''")
    found = ranking.rarity_scores(ranking.rarity_matches(docs, {"q": _RARITY}), docs)
    return found.select("id", F.round("score", 6).alias("score"), "terms")


@register(
    f"""WITH {_TERMS}, d AS (
  SELECT doc_id, {_has("license")} AS must, {_has("mit")}::INT + {_has("the", "der")}::INT AS prefer, {_has("apache")} AS excluded FROM terms GROUP BY doc_id
) SELECT doc_id::VARCHAR AS id, prefer::BIGINT AS prefer_groups, (SELECT count(*) FROM d WHERE must AND NOT excluded)::BIGINT AS total FROM d WHERE must AND NOT excluded"""
)
def must_prefer_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that must have a word and mustn't another, with how many preferred groups they have."""
    query = ranking.Structured(must=[["license"]], prefer=[["mit"], ["the", "der"]], exclude=["apache"], limit=1 << 30)
    return ranking.structured(corpus_index(spark, sf_dir), query).select("id", "prefer_groups", "total")


@register(
    f"""WITH {bm25("('q', 0, 'license', '^$', 1.0, 0.0)")}, d AS (
  SELECT doc_id, {_has("mit")}::INT + {_has("the", "der")}::INT AS prefer, {_has("apache")} AS excluded FROM terms GROUP BY doc_id
), kept AS (SELECT doc_id, prefer, -weight AS score FROM weights JOIN d USING (doc_id) WHERE NOT excluded)
SELECT doc_id::VARCHAR AS id, prefer::BIGINT AS prefer_groups, round(score, 6) AS score, (SELECT count(*) FROM kept)::BIGINT AS total
FROM (SELECT *, row_number() OVER (ORDER BY prefer DESC, score, doc_id) AS r FROM kept) WHERE r <= 20"""
)
def must_prefer_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty documents that must have a word and mustn't another, those with more preferred groups first."""
    query = ranking.Structured(must=[["license"]], prefer=[["mit"], ["the", "der"]], exclude=["apache"], limit=20)
    return ranking.structured(corpus_index(spark, sf_dir), query).select("id", "prefer_groups", F.round("score", 6).alias("score"), "total")


@register(
    f"WITH {_TERMS} SELECT DISTINCT query_id, term FROM terms, (VALUES ('a', 'lic'), ('b', 'vers')) v(query_id, prefix) WHERE starts_with(term, prefix)"
)
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the vocabulary by prefix."""
    return ranking.with_prefix(corpus_index(spark, sf_dir), {"a": "lic", "b": "vers"})


@register(
    f"""WITH {_TERMS} SELECT DISTINCT query_id, term, levenshtein(term, word)::BIGINT AS distance FROM terms, (VALUES ('a', 'licence', 1), ('b', 'versionen', 2)) v(query_id, word, most)
WHERE abs(length(term) - length(word)) <= most AND levenshtein(term, word) <= most AND length(term) >= 2"""
)
def fuzzy_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the vocabulary near a word."""
    found = ranking.fuzzy(corpus_index(spark, sf_dir), {"a": "licence", "b": "versionen"})
    return found.withColumn("distance", F.col("distance").cast("long"))


@register(
    f"""WITH {_STATS}, asked(word) AS (VALUES ('licence'), ('version')),
near AS (SELECT DISTINCT word, term, levenshtein(term, word) AS far, least(6, round(length(word) * 0.2)) AS bound FROM (SELECT DISTINCT term FROM tf), asked),
ways AS (
  SELECT word, term, CASE WHEN term = word THEN 1.0 WHEN starts_with(term, word) THEN 0.375 * length(term) / (length(term) + 0.3 * (length(term) - length(word)))
    ELSE 0.45 * length(term) / (length(term) + far) END AS w FROM near WHERE starts_with(term, word) OR far <= bound
),
df AS (SELECT word, term, count(*) AS df FROM tf JOIN ways USING (term) GROUP BY ALL),
scored AS (
  SELECT doc_id, sum(w * ln(1 + (n.n - df + 0.5) / (df + 0.5)) * (0.5 + tf.n * 2.2 / (tf.n + 1.2 * (0.3 + 0.7 * dl / avgdl)))) * count(DISTINCT word) AS score
  FROM tf JOIN ways USING (term) JOIN df USING (word, term) JOIN dl USING (doc_id), n GROUP BY doc_id
)
SELECT 'q' AS query_id, doc_id::VARCHAR AS id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM scored) WHERE rank <= 20"""
)
def fuzzy_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty documents by words, prefixes and near words."""
    found = ranking.fuzzy_search(corpus_index(spark, sf_dir), {"q": "licence version"})
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register(
    """SELECT query_id, doc_id::VARCHAR AS id FROM documents, (VALUES ('a', 'license, version'), ('b', 'the mit'), ('c', '.0')) v(query_id, needle)
WHERE contains(lower(text), needle)"""
)
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a text, found by trigrams."""
    docs = corpus_documents(table(spark, sf_dir, "documents"))
    grams = docs.select("branch_id", "id", F.explode(ranking.trigrams(F.col("text"))).alias("gram"))
    return ranking.substring_candidates(docs, grams, {"a": "license, version", "b": "the MIT", "c": ".0"}).select("query_id", "id")


@register(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_filter(w, lambda x: length(x) >= 2) AS w FROM t))
SELECT DISTINCT a.doc_id::VARCHAR AS id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'license' AND b.term = 'under' AND abs(a.i - b.i) <= 4"""
)
def near_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which two tokens stand near each other."""
    index = corpus_index(spark, sf_dir)
    found = ranking.within(index, "license", "under", 3)
    return found.join(index.documents.select("branch_id", "rowid", "id"), ["branch_id", "rowid"]).select("id")


# ---------------------------------------------------------------- measures


@register(
    """WITH g AS (SELECT (doc_id % 7)::VARCHAR AS query_id, doc_id FROM labels WHERE quality = 1),
r AS (SELECT (doc_id % 7)::VARCHAR AS query_id, doc_id, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
s AS (SELECT query_id, count(DISTINCT doc_id) AS gold FROM g GROUP BY query_id),
h AS (SELECT r.query_id, rank FROM r JOIN (SELECT DISTINCT * FROM g) g ON r.doc_id = g.doc_id AND r.query_id = g.query_id),
a AS (SELECT query_id, max(1.0 / rank) AS mrr, count(*) FILTER (rank <= 10) AS hits, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM h GROUP BY query_id)
SELECT query_id, gold::BIGINT AS gold, round(coalesce(mrr, 0), 6)::DOUBLE AS mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(gold, 10) + 1), lambda x: 1 / log2(x + 1))), 6)::DOUBLE AS ndcg_10,
  round(coalesce(hits, 0) / gold, 6)::DOUBLE AS recall_10, round(coalesce(hits, 0) / 10, 6)::DOUBLE AS precision_10
FROM s LEFT JOIN a USING (query_id)"""
)
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of documents by length, good quality being relevant, for seven queries."""
    name = (F.col("doc_id") % 7).cast("string")
    gold = table(spark, sf_dir, "labels").where("quality = 1").select(name.alias("query_id"), F.col("doc_id").alias("id"))
    rows = table(spark, sf_dir, "documents").select(name.alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    found = retrieval.measures(retrieval.ranked(rows), gold, (10,))
    return found.select("query_id", "gold", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg_10", "recall_10", "precision_10")])


@register(
    """SELECT (doc_id % 5)::VARCHAR AS subset, count(*)::BIGINT AS selected, count(*) FILTER (s = 'graded')::BIGINT AS scored, count(*) FILTER (s = 'failed')::BIGINT AS failed,
  count(*) FILTER (s = 'pending')::BIGINT AS pending, count(*) FILTER (s = 'graded' AND quality = 1)::BIGINT AS correct, round(avg(quality::DOUBLE) FILTER (s = 'graded'), 6) AS accuracy,
  round(avg(doc_id % 10) FILTER (s = 'graded'), 6) AS mean_score, count(*) FILTER (s = 'graded' AND doc_id % 10 >= 8)::BIGINT AS at_least
FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'graded' END AS s FROM labels) GROUP BY ALL"""
)
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judges say by subset, over labels as verdicts."""
    status = F.when(F.col("doc_id") % 4 == 0, "pending").when(F.col("doc_id") % 4 == 1, "failed").otherwise("graded")
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).cast("string").alias("subset"), status.alias("status"), (F.col("quality") == 1).alias("correct"), (F.col("doc_id") % 10).alias("score"))
    return reports.judged(rows, ["subset"]).withColumns({c: F.round(c, 6) for c in ("accuracy", "mean_score")})


@register("SELECT event_type, count(value)::BIGINT AS count, round(median(value), 6) AS median, max(value) AS max FROM events GROUP BY event_type")
def distribution_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, median and largest value of events by type."""
    return reports.distribution(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("median", F.round("median", 6))


@register(
    """SELECT event_type, quantile_disc(value, 0.95) AS p95, list_sort(list(value))[floor(count(*) / 2)::INT + 1] AS upper_median FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def nearest_rank_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentile by nearest rank and the upper median of values by type."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    p95 = rows.groupBy("event_type").agg(reports.nearest_rank("value", 0.95).alias("p95"))
    return p95.join(reports.cells(rows, "value", ["event_type"]).select("event_type", F.col("median").alias("upper_median")), "event_type")


@register(
    """WITH i AS (SELECT event_type, epoch_us(ts) AS b, epoch_us(ts) + 60000000 * (1 + event_id % 5) AS e FROM events),
s AS (SELECT event_type, b AS moment, 1 AS d FROM i UNION ALL SELECT event_type, e, -1 FROM i),
t AS (SELECT event_type, moment, sum(d) AS d FROM s GROUP BY ALL)
SELECT event_type, max(n)::BIGINT AS peak FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY moment) AS n FROM t) GROUP BY event_type"""
)
def peak_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most events open at one time by type, each for one to five minutes."""
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_type", begin.alias("begin"), (begin + 60_000_000 * (1 + F.col("event_id") % 5)).alias("end"))
    return reports.peak(rows, by=["event_type"])


@register(
    """SELECT user_id::VARCHAR AS session_id, (count(DISTINCT event_id) // 10)::BIGINT AS due, (count(DISTINCT event_id) % 10)::BIGINT AS since
FROM events WHERE event_type <> 'error' GROUP BY user_id"""
)
def cadence_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an index would be due by session, events being tool batches that come twice each."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.lit("batch").alias("kind"), F.col("event_id").cast("string").alias("event_id"), (F.col("event_type") != "error").alias("ok")
    )
    return cadence.due_counts(events.unionByName(events))


@register(
    """WITH c AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id::VARCHAR AS session_id, count(*)::BIGINT AS cycles FROM c WHERE role = 'assistant' AND before = 'user' GROUP BY conv_id"""
)
def cadence_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed cycles of each conversation: an answer that ends after a user's message."""
    kind = F.when(F.col("role") == "user", "user").otherwise("end")
    events = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("pos"), kind.alias("kind"), F.lit(None).cast("string").alias("event_id"), F.lit(True).alias("ok")
    )
    return cadence.completed_cycles(events).select("session_id", F.col("cycles").cast("long").alias("cycles")).where("cycles > 0")


@register(
    """WITH p(phase, f, t) AS (VALUES ('a', 0, 2e9), ('b', 1e9, 4e9)),
e AS (SELECT event_type AS stage, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000.0 AS moment, value FROM events WHERE value IS NOT NULL)
SELECT phase, stage, count(*)::BIGINT AS count, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS mean_ms, list_sort(list(value))[floor(count(*) / 2)::INT + 1] AS p50_ms
FROM e JOIN p ON moment BETWEEN f AND t GROUP BY ALL"""
)
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations by phase and stage, events being spans."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("zero"))
    spans = events.crossJoin(F.broadcast(first)).select(  # one row
        F.col("event_type").alias("stage"), ((F.unix_micros(F.col("ts").cast("timestamp")) - F.col("zero")) / 1000.0).alias("startMs"), F.col("value").alias("durationMs"), F.lit(0.0).alias("clockOriginMs")
    )
    phases = spark.createDataFrame([("a", 0.0, 2e9), ("b", 1e9, 4e9)], "phase string, startMs double, endMs double")
    found = traces.stage_times(traces.in_phases(spans, phases))
    return found.withColumns({"total_ms": F.round("total_ms", 4), "mean_ms": F.round("mean_ms", 6)})
