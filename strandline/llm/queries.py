"""The registered queries of this package, each over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import audio, bpe, counts, decontam, langid, licenses, simhash, sstable, toxicity, urls
from strandline.operators.index import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


def op5_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.digests(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings are melodies of the vectors in ``embeddings``, one for each row."""
    recordings = audio.melodies(_table(spark, sf_dir, "embeddings"))
    return audio.matches(recordings.withColumnRenamed("vec_id", "rec_id"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name and function of each query."""
    own = (
        op1_license_scan, op2_byte_bpe, op3_simhash, op4_language, op5_token_tables, op6_token_counts, op7_decontamination,
        op8_audio_fingerprints, op9_toxicity, op10_url_filter, pipeline,
    )
    return {f.__name__: f for f in own}


# ---------------------------------------------------------------- SQL

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = urls.UPPER, urls.LOWER


def _license_sql() -> str:
    values = ", ".join(
        f"('{t.label}', {str(t.base).lower()}, '{' '.join(t.words)}', {t.key[0]}, {t.key[1]}, {t.votes}, {t.group}, {t.enough}, {i})" for i, t in enumerate(licenses.templates())
    )
    return f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), templates(label, base, phrase, key_begin, key_size, need, grp, enough, t) AS (VALUES {values}),
cut AS (SELECT *, string_split(phrase, ' ') AS tw FROM templates),
tokens AS (SELECT t, unnest(tw) AS word, unnest(range(len(tw))) AS pos FROM cut),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM docs),
df AS (SELECT word, count(DISTINCT doc_id) AS n FROM places WHERE word IN (SELECT word FROM tokens) GROUP BY word),
weighted AS (
  SELECT t, k.word, pos, round(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 0.5)), 6) AS idf FROM tokens k LEFT JOIN df USING (word)
),
rare AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY idf DESC, pos) AS r FROM weighted) WHERE r <= {licenses.RARE}),
masses AS (SELECT t, sum(idf) AS whole FROM rare GROUP BY t),
votes AS (
  SELECT p.doc_id, a.t, p.pos - a.pos AS s, count(*) AS n, sum(a.idf) AS mass FROM places p JOIN rare a ON p.word = a.word JOIN cut USING (t) JOIN docs d ON d.doc_id = p.doc_id
  WHERE p.pos - a.pos >= 0 AND p.pos - a.pos + len(tw) <= len(w) GROUP BY ALL
),
share AS (SELECT doc_id, max(mass / greatest(whole, 1e-9)) AS share FROM votes JOIN masses USING (t) GROUP BY doc_id),
found AS (
  SELECT v.doc_id, v.t, v.s, label, base, grp, enough FROM votes v JOIN cut USING (t) JOIN docs d ON d.doc_id = v.doc_id
  WHERE v.n >= need AND list_slice(w, s + key_begin + 1, s + key_begin + key_size) = list_slice(tw, key_begin + 1, key_begin + key_size)
),
labelled AS (SELECT doc_id, label FROM found GROUP BY doc_id, grp, label, enough HAVING count(DISTINCT t) >= enough),
labels AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM labelled GROUP BY doc_id),
base AS (
  SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels
  FROM found WHERE base GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN labels IS NOT NULL THEN 1 ELSE round(0.9 * coalesce(share, 0), 6) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN share USING (doc_id)"""


def _decontam_sql() -> str:
    def words(table: str, key: str) -> str:
        return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM {table}"

    size = decontam.WINDOW
    return f"""
WITH docs AS ({words("documents", "doc_id")}), items AS ({words("benchmark", "item_id")}),
windows AS (
  SELECT item_id, least(len(w), {size}) AS size, array_to_string(list_slice(w, i + 1, i + {size}), ' ') AS line
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - {size - 1}, 1))) AS i FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
starts AS (
  SELECT doc_id, size, i, array_to_string(list_slice(w, i + 1, i + size), ' ') AS line
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size)
),
found AS (SELECT DISTINCT doc_id, i, size, item_id FROM starts JOIN windows USING (size, line)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _url_sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {values}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
),
ranked AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p DESC, v DESC) AS r
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(v, '{urls.DEFAULT}') AS verdict
FROM parts LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op1_license_scan": _license_sql(), "op7_decontamination": _decontam_sql(), "op10_url_filter": _url_sql()}
