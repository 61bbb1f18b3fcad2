"""DataFrame → DataFrame operators: matching, windows, counting, rewriting."""
