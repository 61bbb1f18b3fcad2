"""Writers: corpora, pairs, counts, and the versioned count store."""
