"""Registered queries of measures, traces and corpora, beside :mod:`strandline.plans.registry`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.metrics import reports, retrieval
from strandline.plans.registry import register, table
from strandline.sources import corpora, traces


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@register(
    """SELECT (user_id % 50)::VARCHAR AS question_id, count(*)::BIGINT AS attempts, round(sum(value), 4) AS wall_ms,
  CASE WHEN count(*) FILTER (event_id % 400 = 0) = 0 THEN sum(event_id % 9) END::BIGINT AS tokens, count(*) FILTER (event_type = 'error')::BIGINT AS timeouts FROM events GROUP BY ALL"""
)
def attempt_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall time, tokens (null if any attempt has none) and timeouts by question, events being attempts."""
    rows = _events(spark, sf_dir).select(
        (F.col("user_id") % 50).cast("string").alias("question_id"), F.col("value").alias("wall_ms"), F.when(F.col("event_id") % 400 != 0, F.col("event_id") % 9).alias("tokens"), (F.col("event_type") == "error").alias("timeout")
    )
    return reports.attempts(rows).withColumn("wall_ms", F.round("wall_ms", 4))


@register(
    """SELECT (user_id % 20)::VARCHAR AS question_id, count(*)::BIGINT AS model_calls, sum(event_id % 100)::BIGINT AS input, sum(event_id % 7)::BIGINT AS output, 0::BIGINT AS cache_read,
  sum(CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END)::BIGINT AS cache_write FROM events WHERE event_type <> 'view' GROUP BY ALL"""
)
def tokens_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by kind and model calls, events but views being an assistant's messages."""
    usage = F.struct(
        (F.col("event_id") % 100).alias("input"), (F.col("event_id") % 7).alias("output"), F.lit(None).cast("long").alias("cache_read"), F.when(F.col("event_id") % 2 == 0, 3).alias("cache_write")
    )
    rows = _events(spark, sf_dir).select((F.col("user_id") % 20).cast("string").alias("question_id"), F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"), usage.alias("usage"))
    return reports.answer_tokens(rows).select("question_id", "model_calls", *[F.col(c).cast("long").alias(c) for c in ("input", "output", "cache_read", "cache_write")])


_KINDS = "CASE event_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'thinking' WHEN 2 THEN 'tool' WHEN 3 THEN 'turn' WHEN 4 THEN 'batch' ELSE 'call' END"


@register(
    f"""WITH k AS (SELECT user_id % 100 AS s, {_KINDS} AS kind, event_id FROM events)
SELECT s::VARCHAR AS session_id, min(event_id) FILTER (kind = 'text') AS first_text_ms, min(event_id) FILTER (kind = 'thinking') AS first_thinking_ms, min(event_id) FILTER (kind = 'tool') AS first_tool_ms,
  0::BIGINT AS user_messages, count(*) FILTER (kind = 'turn')::BIGINT AS turns, count(*) FILTER (kind = 'batch')::BIGINT AS tool_batches, count(*) FILTER (kind = 'call')::BIGINT AS tool_calls FROM k GROUP BY s"""
)
def observed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By session the first time of each kind of output, and how many turns, batches and calls there were."""
    rows = _events(spark, sf_dir).select((F.col("user_id") % 100).cast("string").alias("session_id"), F.expr(_KINDS).alias("kind"), F.col("event_id").alias("at_ms"))
    return reports.observed(rows)


@register(
    """WITH m AS (SELECT user_id % 5 AS k, event_type AS t, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL), o AS (SELECT user_id % 5 AS k, event_type AS t, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT m.k::BIGINT AS k, m.t AS event_type, round(m.v, 6) AS base, round(o.v, 6) AS variant, round(o.v / m.v, 6) AS ratio FROM m JOIN o ON m.k = o.k AND m.t = o.t"""
)
def paired_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of odd events beside those of even ones."""
    cell = lambda odd: _events(spark, sf_dir).where(F.col("event_id") % 2 == odd).groupBy((F.col("user_id") % 5).cast("long").alias("k"), "event_type").agg(F.avg("value").alias("v"))
    return reports.paired(cell(0), cell(1), ["k", "event_type"], "v").withColumns({c: F.round(c, 6) for c in ("base", "variant", "ratio")})


@register(
    """WITH c AS (SELECT event_id, user_id, 'call' || event_id || CASE WHEN event_id % 10 = 0 THEN '/1' ELSE '' END AS call_id FROM events)
SELECT user_id::VARCHAR AS session_id, call_id, CASE WHEN event_id % 10 = 0 THEN 'call' || event_id WHEN event_id % 15 = 5 THEN 'outer' END AS parent_id,
  CASE WHEN event_id % 10 = 0 OR event_id % 15 = 5 OR event_id % 4 = 1 THEN NULL ELSE event_id % 7 <> 0 END AS identical FROM c"""
)
def correlated_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches with what the model had asked for: some inside other calls, some without a model's message, some changed."""
    name = F.concat(F.lit("call"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 == 0, "/1").otherwise(""))
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), name.alias("call_id"), "event_id", F.lit("asked").alias("input"))
    models = rows.where("event_id % 4 <> 1").select("session_id", "call_id", F.when(F.col("event_id") % 7 != 0, "asked").otherwise("other").alias("arguments"))
    parents = rows.where("event_id % 15 = 5 AND event_id % 10 <> 0").select("session_id", "call_id", F.lit("outer").alias("parent_id"))
    return traces.correlated(rows.drop("event_id"), models, parents).select("session_id", "call_id", "parent_id", "identical")


@register("SELECT user_id::VARCHAR AS session_id, event_id::VARCHAR AS call_id, event_type AS name FROM events WHERE event_id % 9 = 0 OR event_id % 11 = 0")
def results_without_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose call, or a call of that name, isn't there."""
    results = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("call_id"), F.col("event_type").alias("name"), "event_id")
    calls = results.where("event_id % 9 <> 0").withColumn("name", F.when(F.col("event_id") % 11 == 0, "other").otherwise(F.col("name")))
    return traces.unmatched_results(calls.drop("event_id"), results.drop("event_id"))


@register(
    """WITH g AS (SELECT DISTINCT doc_id % 60 AS q, doc_id FROM labels WHERE quality = 1), s AS (SELECT q, count(*) AS gold FROM g GROUP BY q),
c AS (SELECT 'long' AS arm, doc_id FROM documents WHERE n_chars > 2000 UNION ALL SELECT 'odd', doc_id FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 'none', -1),
l AS (SELECT arm, q, count(*) AS located FROM c JOIN g USING (doc_id) GROUP BY ALL)
SELECT a.arm, coalesce(sum(located), 0)::BIGINT AS located, count(located)::BIGINT AS any, count(*) FILTER (located = gold)::BIGINT AS all, (SELECT count(*) FROM s)::BIGINT AS queries
FROM (SELECT DISTINCT arm FROM c) a LEFT JOIN l ON a.arm = l.arm LEFT JOIN s ON l.q = s.q GROUP BY a.arm"""
)
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents that three ways to choose candidates locate."""
    query = (F.col("id") % 60).cast("string").alias("query_id")
    gold = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).select(query, "id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    arm = lambda name, rows: rows.select(F.lit(name).alias("arm"), query, "id")
    nothing = spark.range(1).select((F.col("id") - 1).alias("id"))
    return retrieval.coverage(arm("long", docs.where("n_chars > 2000")).unionByName(arm("odd", docs.where("id % 2 = 1"))).unionByName(arm("none", nothing)), gold)


@register(
    """WITH g AS (SELECT (doc_id % 7) AS q, doc_id FROM labels WHERE quality = 1), s AS (SELECT q, count(DISTINCT doc_id) AS gold FROM g GROUP BY q),
r AS (SELECT (doc_id % 7) AS q, doc_id, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
h AS (SELECT r.q, rank FROM r JOIN (SELECT DISTINCT * FROM g) g ON r.doc_id = g.doc_id AND r.q = g.q),
m AS (SELECT s.q, coalesce(max(1.0 / rank), 0)::DOUBLE AS mrr, count(rank) FILTER (rank <= 20) / gold AS recall_20 FROM s LEFT JOIN h ON s.q = h.q GROUP BY s.q, gold)
SELECT (q % 2)::VARCHAR AS language, count(*)::BIGINT AS queries, round(avg(mrr), 6) AS mrr, round(avg(recall_20), 6) AS recall_20 FROM m GROUP BY ALL"""
)
def macro_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean measures of queries by language."""
    name = (F.col("doc_id") % 7).cast("string")
    gold = table(spark, sf_dir, "labels").where("quality = 1").select(name.alias("query_id"), F.col("doc_id").alias("id"))
    rows = table(spark, sf_dir, "documents").select(name.alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    found = retrieval.measures(retrieval.ranked(rows), gold, (20,)).withColumn("language", (F.col("query_id").cast("int") % 2).cast("string"))
    return retrieval.macro(found, ["language"]).select("language", "queries", F.round("mrr", 6).alias("mrr"), F.round("recall_20", 6).alias("recall_20"))


@register(
    """WITH c AS (SELECT user_id AS b, event_id % 13 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) * 5 AS cut, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error'),
s AS (SELECT user_id AS b, count(*) AS size FROM events GROUP BY user_id),
p AS (SELECT c.*, coalesce(lag(cut) OVER (PARTITION BY b ORDER BY n), 0) AS before FROM c)
SELECT DISTINCT p.b::VARCHAR AS branch_id FROM p JOIN s ON p.b = s.b WHERE cut <= before OR cut > size"""
)
def invalid_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose cuts don't increase or go beyond their events."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    events = _events(spark, sf_dir)
    cuts = events.where("event_type = 'error'").withColumn("n", n).select(F.col("user_id").cast("string").alias("branch_id"), "n", (F.col("event_id") % 13 + F.col("n") * 5).alias("cut"))
    sizes = events.groupBy(F.col("user_id").cast("string").alias("branch_id")).agg(F.count("*").alias("size"))
    return corpora.invalid_cuts(cuts, sizes)


@register("SELECT event_id::VARCHAR AS id, (epoch_us(ts) // 60000000)::BIGINT AS minute, strftime(ts, '%Y-%m-%d') AS date FROM events")
def session_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minutes of labels such as sessions carry, and dates of time stamps."""
    at = F.col("ts").cast("timestamp")
    label = F.concat(F.date_format(at, "yyyy/MM/dd"), F.lit(" ("), F.date_format(at, "E"), F.lit(") "), F.date_format(at, "HH:mm"))
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), F.floor(F.unix_timestamp(corpora.session_time(label)) / 60).cast("long").alias("minute"), F.substring(stamp, 1, 10).alias("date"))


@register(
    """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations),
f AS (SELECT conv_id, n, 1 AS part, role, CASE WHEN n = 1 AND role = 'user' THEN '[Session Date: 2024/01/0' || (conv_id % 7 + 1) || ' (Mon) 10:00]' || chr(10) || text ELSE text END AS text FROM t
  UNION ALL SELECT conv_id, 1, 0, 'user', '[Session Date: 2024/01/0' || (conv_id % 7 + 1) || ' (Mon) 10:00]' FROM t WHERE n = 1 AND role <> 'user')
SELECT conv_id::VARCHAR AS question_id, row_number() OVER (PARTITION BY conv_id ORDER BY n, part)::BIGINT AS pos, role, md5(text) AS digest FROM f"""
)
def corpus_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as corpora of one dated session: its date stands in front of a user's first message, else in one of its own."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("s")
    )
    label = F.concat(F.lit("2024/01/0"), (F.col("conv_id") % 7 + 1).cast("string"), F.lit(" (Mon) 10:00"))
    rows = turns.select(F.col("conv_id").cast("string").alias("question_id"), F.array(label).alias("haystack_dates"), F.array("s").alias("haystack_sessions"))
    return corpora.messages(rows).select("question_id", "pos", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@register(
    """SELECT role, count(DISTINCT sha256('[' || to_json(role) || ',' || to_json(coalesce(text, '')) || ']'))::BIGINT AS turns FROM conversations GROUP BY role"""
)
def known_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different turns by role, known by the hash that finds them in several histories."""
    rows = table(spark, sf_dir, "conversations").select("role", F.coalesce("text", F.lit("")).alias("text"))
    return corpora.identities(rows).groupBy("role").agg(F.count_distinct("key").alias("turns"))


@register(
    """SELECT q::VARCHAR AS query_id, count(DISTINCT doc_id) FILTER (r <= 10)::BIGINT AS located FROM (
  SELECT doc_id % 7 AS q, doc_id % 3 AS call, d.doc_id, quality, row_number() OVER (PARTITION BY d.doc_id % 7, d.doc_id % 3 ORDER BY n_chars DESC, d.doc_id) AS r
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
) WHERE quality = 1 GROUP BY q"""
)
def recall_over_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents that the first ten rows of three calls together have."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).cast("string").alias("query_id"), (F.col("doc_id") % 3).alias("call"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    gold = table(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") % 7).cast("string").alias("query_id"), F.col("doc_id").alias("id"))
    found = retrieval.tool_recall(retrieval.ranked(docs, ["query_id", "call"]), gold, 10)
    return found.select("query_id", "located")
