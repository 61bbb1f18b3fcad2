"""Co-occurrence analytics over dependency-parsed corpora, as Spark DataFrames."""
