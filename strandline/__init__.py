"""Search and data preparation over conversation histories and text corpora, on Spark."""
