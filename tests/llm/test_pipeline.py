"""The pipeline against its stages by brute force, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from strandline.llm import queries, toxicity
from tests.llm.conftest import ODD
from tests.llm.test_near_duplicates import roots
from tests.llm.test_similar import linked
from tests.llm.test_text_operators import slow_hits

DATA = Path("/root/testdata/sf0.001")
#: A text with letters, in no language that the tables' labels teach.
STRANGE = "这份文件里没有一个单词属于我们学过的语言"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of tables in which each stage has something to do."""
    path = tmp_path_factory.mktemp("tables")
    passage = "the quick brown fox jumps over the lazy dog and then it sleeps"
    plain = [" ".join(f"{a}{b}{i}" for a in ("lo", "mi", "ta", "re") for b in ("na", "ko", "pel")) for i in range(60)]
    english = "you are so slow and it is a worthless quick brown fox over a lazy stupid dog then he sleeps more on it jumps the moron idiots fool".split()
    pick = random.Random(1)
    texts = [*plain, *(p + " again" for p in plain[:5]), plain[7], "123 !!!", None, "you stupid idiot, worthless moron", f"so {passage} it is", STRANGE, ""]
    texts += [" ".join(pick.choice(english).replace("moron", "more on").replace("idiots", "idle") for _ in range(40)) for _ in range(40)]
    rows = [(i, t, "en" if t and t != STRANGE else None, "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), texts, passage


def test_stages_take_effect(spark, folder):
    path, texts, passage = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    # The language stage rejects what has no letter and, by the classifier's score, what is in no learned language.
    alive = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t) and t != STRANGE]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, path).collect()) == alive
    lexicon = toxicity.fit([])
    alive = [i for i in alive if lexicon.score(texts[i]) < 0.5]
    assert 68 not in alive and 69 in alive
    # Near duplicates are texts that share 0.8 of their runs of five words.
    alive = [alive[k] for k in sorted(set(roots(len(alive), linked([texts[i] for i in alive]))))]
    assert not set(range(60, 65)) & set(alive)
    alive = [i for i in alive if not slow_hits(texts[i], [(1, passage)])[1]]
    assert sorted(rows) == alive
    for i in alive:
        assert rows[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_stages_keep_the_columns(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS score", "2 AS fp", "3 AS fingerprint_bits")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0


def test_odd_rows_go_through_all_stages(spark, folder, tmp_path):
    """Null, empty, very long texts, repeated and null ids, an extra column: no stage fails, and each text stays at most once."""
    words = " ".join(f"lona{i} mita{i} rekopel" for i in range(2_000))
    texts = [*ODD, words, words, "lona mita rekopel lona", None]
    rows = [(i if i < 6 else 7 if i < 9 else None, t, None, "s", len(t or ""), "x") for i, t in enumerate(texts)]
    rows += [(1_000 + i, f"lona{i} mita rekopel tana {i}", "en", "s", 1, "x") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    digests = [r["decoded_sha256"] for r in found]
    assert len(digests) == len(set(digests)) and hashlib.sha256(words.encode()).hexdigest() in digests
    assert {hashlib.sha256((t or "").encode()).hexdigest() for t in (None, "", "!!! ### 123")}.isdisjoint(digests)


def test_registered_names():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(queries.queries()) <= set(entry.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = queries.queries()[name](spark, str(DATA))
    expected = db.execute(queries.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in db.execute(queries.oracle_sql()[name]).description]
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, expected))
