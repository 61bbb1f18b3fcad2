"""Readers: corpora, pair streams, word lists, counts, annotated tables."""
