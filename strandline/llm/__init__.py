"""Operators for building language-model training data.

One module per operator; ``queries`` holds the registered queries and their
SQL.  Nothing outside this package imports it.

======== =================================================================
module   operator
======== =================================================================
licenses licence scan over a positional rare-token index (SQL only)
bpe      byte-level BPE encoding and decoding
simhash  near-duplicate components over 64-bit fingerprints
similar  near duplicates by shared runs of words, the pipeline's stage
langid   string-kernel language classification
sstable  token-id output as sorted-string-table shards
counts   token counts with a whole-token shortcut
decontam benchmark decontamination by a prefix-filtered set join
audio    chroma fingerprints of recordings and their alignment
toxicity weighted lexicon over folded text
urls     URL rules over host-suffix and path-prefix expressions (SQL only)
======== =================================================================
"""
