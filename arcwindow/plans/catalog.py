"""Registered queries: every operator over the whole of the given tables.

Sentences come from ``documents`` (see :mod:`arcwindow.sources.annotated`), word lists
from ``benchmark`` and ``conversations``. Queries about files write the corpus with Spark
first and read it back.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arcwindow.functions.linear import Flagged, raw_field
from arcwindow.functions.predicates import TokenTest
from arcwindow.functions.tokens import LINE_FIELDS, TOKEN_COLUMNS, TOKENS, Tokens, format_tokens
from arcwindow.operators.counting import (
    count_pairs,
    merge_counts,
    second_part,
    sort_counts,
    whole_sentence_counts,
    whole_sentence_rounds,
)
from arcwindow.operators.filters import flag_words
from arcwindow.operators.graph import dep_edges, dot_graphs
from arcwindow.operators.grep import grep
from arcwindow.operators.heads import contentful_noun_heads
from arcwindow.operators.matchers import DependencyArcs, LinearPhrases, Unigrams
from arcwindow.operators.order import row_numbers
from arcwindow.operators.split import split_by_sentences, split_by_texts
from arcwindow.operators.trim import Pivots, trim
from arcwindow.operators.vocabulary import decode_counts, encoded_tokens, packed_counts
from arcwindow.operators.windows import BagOfWords, extract_pairs, match_rows
from arcwindow.operators.word_stream import word_stream
from arcwindow.plans.cooccurrence import cooccurrence_counts
from arcwindow.plans.scratch import DENSE, cut_lineage, scratch_path
from arcwindow.sinks.corpus import sentence_text, write_corpus, write_files, write_lines, write_parts
from arcwindow.sinks.counts import ChangedCounts, CountStore, export_counts, write_counts, write_pairs
from arcwindow.sources.annotated import (
    benchmark_words,
    conversation_sentences,
    document_chunks,
    document_sentences,
    documents,
    sentence_count,
    table_partitions,
)
from arcwindow.sources.corpus import PIECE_ORDER, read_corpus, read_texts
from arcwindow.sources.counts import read_counts
from arcwindow.sources.pairs import read_pairs
from arcwindow.sources.words import STRIP, read_words
from arcwindow.streaming.counts import stream_changes, stream_merge

Query = Callable[[SparkSession, str], DataFrame]

KEYS = ["doc_id", "sent_idx"]
#: Batches in which the stream queries take the files of their folder, at most.
STREAM_BATCHES = 4
#: Sentences of a corpus file that is read as a whole or cannot be cut, at most.
FILE_SENTENCES = 20_000
ADJECTIVE_OF_NOUN = DependencyArcs(dependent=TokenTest(pos="JJ"), head=TokenTest(pos="N"))
ADJECTIVE_NOUN = LinearPhrases("T<pos=JJ>T<pos=NN.?>")


def big(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# -- tokens -----------------------------------------------------------------------------


def token_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = TOKENS
    texts = F.arrays_zip(
        tokens["id"].alias("id"),
        tokens["sentence_pos"].alias("place"),
        tokens["cat"].alias("cat"),
        format_tokens(tokens).alias("target"),
        format_tokens(tokens, "{word}/{pos}").alias("tagged"),
        format_tokens(tokens, "{dep_rel}({dep_id}, {id})").alias("arc"),
    )
    rows = document_sentences(spark, sf_dir).select(*KEYS, F.explode_outer(texts).alias("t"))
    return rows.select(
        *KEYS, "t.id", big("t.place").alias("place"), "t.cat", "t.target", "t.tagged", "t.arc"
    )


# -- windows and counts -------------------------------------------------------------------


def unigram_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence_counts(document_sentences(spark, sf_dir), window=2)


def word_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and contexts in different templates."""
    return cooccurrence_counts(
        document_sentences(spark, sf_dir),
        window=1,
        target_format="{lemma}",
        context_format="{pos}/{dep_rel}",
    )


def dependency_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence_counts(
        document_sentences(spark, sf_dir),
        window=2,
        unigrams=False,
        compositions=[ADJECTIVE_OF_NOUN],
    )


def window_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which side of an arc its contexts lie."""
    pairs = extract_pairs(document_sentences(spark, sf_dir), [ADJECTIVE_OF_NOUN], BagOfWords(3))
    return pairs.groupBy("target", "marker").agg(
        F.count("*").alias("pairs"), F.sum(big("c_position")).alias("places")
    )


def combined_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, phrases and arcs together; what two matchers find counts once."""
    return cooccurrence_counts(
        document_sentences(spark, sf_dir),
        window=2,
        compositions=[ADJECTIVE_NOUN, DependencyArcs(relation="NMOD")],
    )


def _profile(counts: DataFrame) -> DataFrame:
    n = F.col("occurrences")
    return counts.groupBy("space", "pivot").agg(
        F.count("*").alias("contexts"),
        F.sum(n).alias("pairs"),
        F.sum(n * n).alias("squares"),
        F.sum(n * F.length("context")).alias("letters"),
    )


def whole_sentence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts without a window, summed up per word: in rounds, whose sums are added up."""
    rounds = [cut_lineage(_profile(counts), DENSE) for counts in whole_sentence_rounds(document_sentences(spark, sf_dir))]
    if len(rounds) == 1:
        return rounds[0]
    sums = [F.sum(c).alias(c) for c in rounds[0].columns[2:]]
    return functools.reduce(DataFrame.unionByName, rounds).groupBy("space", "pivot").agg(*sums)


def whole_sentence_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with different templates, and sentences in small blocks."""
    counts = whole_sentence_counts(
        document_sentences(spark, sf_dir),
        target_format="{lemma}",
        context_format="{pos}",
        block=16,
    )
    return counts


def phrase_sentence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs with the whole sentence as window."""
    return _profile(
        cooccurrence_counts(
            document_sentences(spark, sf_dir), unigrams=False, compositions=[ADJECTIVE_OF_NOUN]
        )
    )


def text_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole document as one chunk: ids repeat and the last of each is the target."""
    return cooccurrence_counts(document_chunks(spark, sf_dir), window=2, long_chunks=True)


def text_arc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence_counts(
        document_chunks(spark, sf_dir),
        window=3,
        unigrams=False,
        compositions=[DependencyArcs(relation="(NMOD|SBJ)")],
        long_chunks=True,
    )


def content_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence_counts(document_sentences(spark, sf_dir), window=2, content_only=True)


class Neighbours:
    """A matcher of one's own: every two words that stand side by side."""

    def matches(self, tokens: Tokens) -> Column:
        pairs = F.transform(tokens["id"], lambda _, i: F.array(i, i + 1))
        return F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0)))


class Ahead:
    """A window of one's own: the two words that come after the target."""

    def positions(self, n: Column, left: Column, right: Column) -> Column:
        return F.when(right + 1 < n, F.sequence(right + 1, F.least(right + 2, n - 1)))

    def marker(self, position: Column, left: Column, right: Column) -> Column:
        return (position - right).cast("string")


def own_matcher_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's matcher and a user's window."""
    pairs = extract_pairs(document_sentences(spark, sf_dir), [Neighbours()], Ahead())
    return pairs.groupBy("target", "context", "marker").agg(F.count("*").alias("pairs"))


def phrase_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of two and more words: adjectives and the noun after them."""
    phrases = LinearPhrases("T<pos=JJ>+T<pos=NN>")
    return cooccurrence_counts(document_sentences(spark, sf_dir), window=2, unigrams=False, compositions=[phrases])


# -- word lists -----------------------------------------------------------------------------


def conversation_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    lemmas = conversation_sentences(spark, sf_dir).select(
        F.explode_outer(TOKENS["lemma"]).alias("word")
    )
    return lemmas.where("word IS NOT NULL").distinct()


def listed_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence_counts(
        document_sentences(spark, sf_dir),
        window=2,
        target_format="{lemma}",
        context_format="{lemma}",
        targets=benchmark_words(spark, sf_dir),
        contexts=conversation_lemmas(spark, sf_dir),
    )


def listed_arc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence_counts(
        document_sentences(spark, sf_dir),
        window=2,
        compositions=[ADJECTIVE_OF_NOUN],
        target_format="{lemma}",
        context_format="{lemma}",
        targets=["the", "of", "and", "die", "les"],
        first=conversation_lemmas(spark, sf_dir),
        second=benchmark_words(spark, sf_dir),
    )


def listed_row_col_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that meet finished counts, so pairs are counted once for both directions."""
    return cooccurrence_counts(
        document_sentences(spark, sf_dir),
        window=2,
        compositions=[ADJECTIVE_OF_NOUN],
        target_format="{lemma}",
        context_format="{lemma}",
        rows=benchmark_words(spark, sf_dir),
        cols=conversation_lemmas(spark, sf_dir),
    )


def encoded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and contexts as list indices, and the indices read back."""
    words = benchmark_words(spark, sf_dir)
    words = row_numbers(words, ["word"], "n").select("word", (F.col("n") - 1).alias("id"))
    words = cut_lineage(words)
    coded = encoded_tokens(document_sentences(spark, sf_dir), words, KEYS, "{lemma}")
    return decode_counts(packed_counts(coded, 1), words)


def word_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with padding and repeats, written as a file and read with each way of stripping."""
    words = F.posexplode(F.split("text", "[ \n]", -1)).alias("k", "w")
    lines = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", words)
    padded = F.concat(F.when(F.col("k") % 2 == 0, " ").otherwise("\t"), "w", F.lit(" "))
    path = scratch_path(spark, "words")
    lines.orderBy("item_id", "k").select(padded.alias("value")).write.option("lineSep", "\n").text(path)
    read = [read_words(spark, path, strip).select(F.lit(strip).alias("strip"), "id", "word") for strip in STRIP]
    return functools.reduce(DataFrame.unionByName, read)


# -- matches ----------------------------------------------------------------------------------


def _span_rows(matches: DataFrame) -> DataFrame:
    return matches.select(
        *KEYS,
        big(F.get("positions", F.lit(0))).alias("start"),
        big(F.get("positions", F.size("positions") - 1)).alias("stop"),
        F.array_join("words", " ").alias("phrase"),
    )


def dependency_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(match_rows(document_sentences(spark, sf_dir), [ADJECTIVE_OF_NOUN]))


def dependency_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of tests on both ends of an arc; the head list joins as a table."""
    flagged = flag_words(
        document_sentences(spark, sf_dir),
        conversation_lemmas(spark, sf_dir),
        "known",
        KEYS,
        "{lemma}",
    )
    arcs = DependencyArcs(
        relation="(NMOD|SBJ)",
        dependent=TokenTest(word="[a-m]", lemma=".*[est]$"),
        head=TokenTest(pos="(NN|VV)", flag_column="known"),
    )
    return _span_rows(match_rows(flagged, [arcs]).drop("known"))


def linear_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(match_rows(document_sentences(spark, sf_dir), [ADJECTIVE_NOUN]))


def linear_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = LinearPhrases("T<pos=JJ>(T<pos=JJ>)*T<pos=NN|NNS>")
    return _span_rows(match_rows(document_sentences(spark, sf_dir), [phrases]))


def phrase_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of words that repeat: nouns, with or without an adjective, before a preposition."""
    phrases = LinearPhrases("(T<pos=JJ>?T<pos=NN.?>)+T<pos=IN>")
    return _span_rows(match_rows(document_sentences(spark, sf_dir), [phrases]))


def linear_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list in a phrase, case ignored, and alternatives."""
    lowered = F.transform(raw_field(TOKENS, "word"), F.lower)
    flagged = flag_words(
        document_sentences(spark, sf_dir), benchmark_words(spark, sf_dir), "known", KEYS, texts=lowered
    )
    phrases = LinearPhrases(
        "T<pos=JJ,word=file(known.txt)>(T<pos=VV.>|T<word=t.*,pos=IN>)",
        ignore_case=True,
        lists={"known.txt": Flagged("known")},
    )
    return _span_rows(match_rows(flagged, [phrases]).drop("known"))


def _found(found: DataFrame) -> DataFrame:
    marked = F.zip_with(
        "tok_lemma", "tok_is_match", lambda l, m: F.concat(F.when(m, "*").otherwise(""), l)
    )
    return found.select(
        *KEYS,
        F.array_join(marked, " ").alias("line"),
        big(F.size("matched")).alias("n_matched"),
    )


def grep_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(grep(document_sentences(spark, sf_dir), [ADJECTIVE_NOUN, ADJECTIVE_OF_NOUN]))


def grep_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(
        grep(document_sentences(spark, sf_dir), [ADJECTIVE_NOUN, ADJECTIVE_OF_NOUN], intersect=True)
    )


# -- rewrites -----------------------------------------------------------------------------------


def _token_rows(sentences: DataFrame) -> DataFrame:
    tokens = F.explode_outer(TOKENS.rows(*LINE_FIELDS)).alias("t")
    rows = sentences.select(*KEYS, tokens).where("t IS NOT NULL")
    return rows.select(
        *KEYS,
        big("t.id").alias("id"),
        big("t.dep_id").alias("dep_id"),
        "t.word",
        "t.lemma",
        "t.pos",
        "t.dep_rel",
    )


def trim_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivots = Pivots(lemma=".*[aeiou]n", pos="N|J|V")
    return _token_rows(trim(document_sentences(spark, sf_dir), pivots))


def trim_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = document_sentences(spark, sf_dir)
    flagged = flag_words(sentences, conversation_lemmas(spark, sf_dir), "known", KEYS, "{lemma}")
    return _token_rows(trim(flagged, Pivots(flag_column="known")))


def noun_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_rows(contentful_noun_heads(document_sentences(spark, sf_dir)))


def words_of_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_stream(document_sentences(spark, sf_dir)).select(*KEYS, big("place").alias("place"), "line")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dep_edges(document_sentences(spark, sf_dir))


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dot_graphs(document_sentences(spark, sf_dir), KEYS)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", sentence_count().alias("n_sentences"), F.lit(True).alias("ends_text")
    )


def parts_by_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_texts(_pieces(spark, sf_dir), ["doc_id"], 7).drop("ends_text")


def parts_by_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_by_sentences(_pieces(spark, sf_dir), ["doc_id"], 50).drop("ends_text")


def _write_texts(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Documents in order as texts of a corpus, in compressed files that end anywhere between sentences."""
    sentences = document_sentences(spark, sf_dir)
    body = sentences.select(*KEYS, sentence_text(sentences).alias("value"))
    texts = documents(spark, sf_dir).select("doc_id")
    opening = F.concat(F.lit('<text id="'), F.col("doc_id"), F.lit('">'))

    def markup(sent_idx: int, line: Column) -> DataFrame:
        return texts.select("doc_id", F.lit(sent_idx).cast("bigint").alias("sent_idx"), line.alias("value"))

    lines = body.unionByName(markup(-1, opening)).unionByName(markup(1 << 62, F.lit("</text>")))
    write_lines(lines, "value", path, order=KEYS, compression="gzip", file_rows=FILE_SENTENCES)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of texts as files, split into part files, and what is in each part."""
    corpus, out = scratch_path(spark, "texts"), scratch_path(spark, "parts")
    _write_texts(spark, sf_dir, corpus)
    pieces = read_texts(spark, corpus)
    write_parts(split_by_sentences(pieces, PIECE_ORDER, 50), out, PIECE_ORDER, compression="gzip")
    part = F.regexp_extract("sent_key.file", "out=([0-9]+)", 1).cast("bigint")
    # parts are cut at the ends of texts and lines of whole sentences: nothing goes on in the next file
    found = read_corpus(spark, out, chain=False).select(part.alias("part"), F.size(TOKENS["id"]).alias("n"))
    return found.groupBy("part").agg(F.count("*").alias("sentences"), F.sum("n").alias("tokens"))


# -- stores, files, streams -----------------------------------------------------------------------


def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents, to which counts of conversations are added."""
    arcs = dict(window=2, unigrams=False, compositions=[ADJECTIVE_OF_NOUN])
    store = CountStore(spark, scratch_path(spark, "store"))
    documents_ = cooccurrence_counts(document_sentences(spark, sf_dir), **arcs)
    store.add(documents_, batch=0, source="documents", unique=True)
    new = cooccurrence_counts(conversation_sentences(spark, sf_dir), **arcs)
    store.add(new, batch=0, source="conversations", unique=True)
    store.add(new, batch=0, source="conversations", unique=True)  # comes again: must change nothing
    return store.read()


def union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = dict(window=2, unigrams=False, compositions=[ADJECTIVE_OF_NOUN])
    return merge_counts(
        cooccurrence_counts(document_sentences(spark, sf_dir), **arcs),
        cooccurrence_counts(conversation_sentences(spark, sf_dir), **arcs),
    )


def sorted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sort_counts(dependency_window_counts(spark, sf_dir), by_value=True, reverse=True)
    return counts.select("pivot", "context", "occurrences", second_part(F.col("pivot")).alias("second"))


def _write_sentences(
    spark: SparkSession, sf_dir: str, compression: str | None = None, least_files: int = 1, file_rows: int = 0
) -> str:
    """A file for each partition and each ``file_rows`` sentences; only a table of fewer than ``least_files`` is dealt out."""
    sentences = document_sentences(spark, sf_dir)
    if least_files > 1 and table_partitions(spark, sf_dir, "documents") < least_files:
        sentences = sentences.repartition(least_files, *KEYS)
    path = scratch_path(spark, "corpus")
    write_corpus(sentences.withColumn("text_open", _opening()), path, compression=compression, file_rows=file_rows)
    return path


def _arriving(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A folder of corpus files, and how many of them make a batch, for ``STREAM_BATCHES`` or fewer batches."""
    folder = _write_sentences(spark, sf_dir, "gzip", STREAM_BATCHES, FILE_SENTENCES)
    return folder, max(1, math.ceil(len(spark.read.text(folder).inputFiles()) / STREAM_BATCHES))


def _opening() -> Column:
    """Markup before a sentence that tells where it is from."""
    return F.array(F.concat(F.lit('<text id="'), F.concat_ws(":", *KEYS), F.lit('">')), F.lit("<s>"))


def _read_back(corpus: DataFrame) -> DataFrame:
    place = F.split(F.regexp_extract(F.element_at("text_open", -2), '"(.*)"', 1), ":")
    keyed = corpus.select(
        *[big(F.get(place, F.lit(i))).alias(k) for i, k in enumerate(KEYS)], *TOKEN_COLUMNS
    )
    return _token_rows(keyed)


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(read_corpus(spark, _write_sentences(spark, sf_dir, file_rows=FILE_SENTENCES)))


def corpus_files_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(read_corpus(spark, _write_sentences(spark, sf_dir, "gzip", file_rows=FILE_SENTENCES)))


def corpus_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut anywhere, a record per sentence."""
    path = _write_sentences(spark, sf_dir)
    return _read_back(read_corpus(spark, path, layout="splits"))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From corpus files to counts in one job, words lowered on reading."""
    path = _write_sentences(spark, sf_dir, "gzip", file_rows=FILE_SENTENCES)
    corpus = read_corpus(spark, path, layout="splits", to_lower=True)
    return cooccurrence_counts(
        corpus, window=2, target_format="{word}", context_format="{word}", compositions=[ADJECTIVE_NOUN]
    )


def rewritten_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to the same files: whole-number ids, lemmas lowered before they are tested, trimmed, markup kept."""
    sentences = document_sentences(spark, sf_dir).withColumn("tok_lemma", F.col("tok_word"))
    path, out = scratch_path(spark, "cased"), scratch_path(spark, "trimmed")
    write_corpus(sentences.withColumn("text_open", _opening()), path, compression="gzip", file_rows=FILE_SENTENCES)
    corpus = read_corpus(spark, path, layout="splits", int_ids=True, keep_tails=True)
    trimmed = trim(corpus, Pivots(lemma=".*[aeiou]n", pos="N|J|V"), to_lower=True)
    write_files(trimmed, out, compression="gzip")
    return _read_back(read_corpus(spark, out, layout="splits"))


def text_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as chunks, read from files that are cut anywhere."""
    path = scratch_path(spark, "whole")
    _write_texts(spark, sf_dir, path)
    return cooccurrence_counts(read_corpus(spark, path, separator="text", layout="splits"), window=2, long_chunks=True)


def sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written sorted by value, and the place of each line in the files."""
    path = scratch_path(spark, "export")
    export_counts(dependency_window_counts(spark, sf_dir), path, by_value=True, reverse=True)
    lines = spark.read.text(path).select(
        F.split("value", "\t", -1).alias("f"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    numbered = row_numbers(cut_lineage(lines), ["file", "block", "line"], "place")
    return numbered.select(
        "place", F.get("f", F.lit(0)).alias("pivot"), F.get("f", F.lit(1)).alias("context"), big(F.get("f", F.lit(2))).alias("occurrences")
    )


def pair_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    write_pairs(extract_pairs(document_sentences(spark, sf_dir), [ADJECTIVE_OF_NOUN], BagOfWords(2)), path)
    return count_pairs(read_pairs(spark, path))


def count_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "counts")
    write_counts(combined_counts(spark, sf_dir), path)
    return read_counts(spark, path)


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus files counted by a stream that keeps running totals, a share of the files at a time."""
    folder, files = _arriving(spark, sf_dir)
    path = scratch_path(spark, "stream")
    changes = ChangedCounts(spark, f"{path}/changes")
    stream_changes(
        spark, folder, changes, f"{path}/state", [ADJECTIVE_OF_NOUN], BagOfWords(2), layout="splits", files_per_batch=files
    ).awaitTermination()
    return changes.read()


def streamed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus files counted batch by batch, each batch added to a store."""
    path = scratch_path(spark, "merge")
    store = CountStore(spark, f"{path}/store")
    folder, files = _arriving(spark, sf_dir)
    stream_merge(
        spark, folder, store, f"{path}/state", [ADJECTIVE_OF_NOUN], BagOfWords(2), layout="splits", files_per_batch=files
    ).awaitTermination()
    return store.read()


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        unigram_window_counts,
        token_templates,
        word_window_counts,
        dependency_window_counts,
        window_markers,
        combined_counts,
        whole_sentence_profile,
        whole_sentence_formats,
        phrase_sentence_profile,
        text_window_counts,
        text_arc_counts,
        content_window_counts,
        listed_target_counts,
        listed_arc_counts,
        listed_row_col_counts,
        encoded_counts,
        dependency_arcs,
        dependency_tests,
        linear_matches,
        linear_runs,
        phrase_groups,
        linear_lists,
        grep_sentences,
        grep_intersection,
        trim_by_pattern,
        trim_by_list,
        noun_heads,
        words_of_sentences,
        edges,
        graphs,
        parts_by_texts,
        parts_by_sentences,
        part_files,
        merged_counts,
        union_counts,
        sorted_counts,
        corpus_files,
        corpus_files_gzip,
        corpus_splits,
        corpus_counts,
        pair_file_counts,
        count_files,
        streamed_counts,
        streamed_merge,
        own_matcher_counts,
        phrase_run_counts,
        word_list_file,
        rewritten_files,
        text_file_counts,
        sorted_export,
    )
}
