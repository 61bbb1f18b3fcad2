"""Column-level building blocks: arrays, token templates, predicates, patterns."""
