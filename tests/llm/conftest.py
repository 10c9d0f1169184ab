"""Helpers for the operators on training data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts; further columns have names that operators use themselves."""

    def make(texts, langs=None, clash=True):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
        table = spark.createDataFrame(rows, DOCS)
        if clash:
            names = ("id", "fp", "ids", "score", "words", "n", "k", "fingerprint_bits", "kept_id", "n_tokens", "component_id", "lang_pred", "labels", "spans", "start")
            table = table.withColumns({name: F.lit("x") for name in names})
        return table.repartition(3)

    return make


#: Texts that every operator has to take: null, empty, blank, very long, signs alone, repeated, beyond Latin-1.
ODD = [None, "", " \t\n", "word " * 30_000, "a" * 50_000, "!!! ### 123", "Same text here twice", "Same text here twice", "漢字 😀 \u0558 \U0001d6a6 İ ß é́", "\x00\x1f\x85 x", "<|endoftext|> a<|endoftext|>"]
