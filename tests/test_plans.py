"""Work that queries must not do, read from their plans."""

from __future__ import annotations

from arcwindow.operators.matchers import DependencyArcs, Unigrams
from arcwindow.operators.windows import BagOfWords, extract_pairs
from arcwindow.plans.catalog import QUERIES
from arcwindow.plans.cooccurrence import cooccurrence_counts
from arcwindow.sources.corpus import read_corpus
from tests import plain
from tests.cases import sentences, write


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, tmp_path):
    return read_corpus(spark, write(tmp_path, plain.corpus(sentences(41, 20))), chain=False)


def test_rows_of_targets_and_pairs_meet_no_lambda(spark, tmp_path):
    """Spark writes out each row before a lambda; matching has them, what comes after it has none."""
    for matchers in ([Unigrams()], [Unigrams(), DependencyArcs(relation="N")]):
        pairs = extract_pairs(corpus(spark, tmp_path), matchers, BagOfWords(2)).select("target", "context", "marker")
        after_matching = plan(pairs).split("explode(_m")[0]
        assert "explode" in after_matching and "lambda" not in after_matching


def test_lists_of_single_words_meet_counts_of_both_directions(spark, tmp_path):
    counts = cooccurrence_counts(corpus(spark, tmp_path), window=2, targets=["car-n", "red-j"], contexts=["red-j"])
    assert "_ab" in plan(counts)


def test_chunks_make_the_fields_asked_for(spark):
    made = plan(QUERIES["text_window_counts"](spark, "/root/testdata/sf0.001"))
    assert "VVG" in made and "NMOD" not in made
