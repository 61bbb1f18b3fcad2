"""Pair and count files, the store, vocabularies and streams."""

from __future__ import annotations

import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arcwindow.functions.predicates import TokenTest
from arcwindow.operators import counting
from arcwindow.operators.counting import count_pairs, dealt_blocks, merge_counts, sentence_hash, sort_counts, whole_sentence_match_counts
from arcwindow.operators.matchers import DependencyArcs, LinearPhrases, Unigrams
from arcwindow.operators.vocabulary import decode, decode_counts, encode, encoded_tokens, packed_counts
from arcwindow.operators.windows import BagOfWords, extract_pairs
from arcwindow.plans.cooccurrence import cooccurrence_counts
from arcwindow.sinks.counts import ChangedCounts, CountStore, export_counts, write_counts, write_pairs
from arcwindow.sources.corpus import read_bad_sentences_stream, read_corpus
from arcwindow.sources.counts import read_counts
from arcwindow.sources.pairs import bad_pair_lines, read_pairs
from arcwindow.sources.words import read_words
from arcwindow.streaming.counts import stream_changes, stream_counts, stream_merge
from tests import plain
from tests.cases import sentences, write

ARCS = DependencyArcs(relation="N", head=TokenTest(pos="(N|V)"))


def counted(counts) -> Counter:
    return Counter({(r.space, r.pivot, r.context): r.occurrences for r in counts.collect()})


def table(spark, rows):
    return spark.createDataFrame(rows, "space string, pivot string, context string, occurrences bigint")


def test_pair_lines(spark, tmp_path):
    path = write(tmp_path, "car-n\tred-j\nodd\ncar-n\tred-j\na\tb\tc\nété-n<-->x-n\tred-j\n", "pairs.txt")
    counts = count_pairs(read_pairs(spark, path))
    assert counted(counts) == {
        ("core", "car-n", "red-j"): 2,
        ("peripheral", "été-n<-->x-n", "red-j"): 1,
    }
    assert {(r.n_fields, r.line) for r in bad_pair_lines(spark, path).collect()} == {(1, "odd"), (3, "a\tb\tc")}
    with pytest.raises(Exception, match="bad pair line"):
        read_pairs(spark, path, on_bad_line="fail").collect()


def test_own_separator(spark, tmp_path):
    path = write(tmp_path, "a+b\tx\na<-->b\tx\n", "pairs.txt")
    got = counted(count_pairs(read_pairs(spark, path), token_sep="+", rows=["b", "a<-->b"]))
    assert got == {("peripheral", "a+b", "x"): 1, ("core", "a<-->b", "x"): 1}


def test_files(spark, tmp_path):
    df = read_corpus(spark, write(tmp_path, plain.corpus(sentences(21, 20))))
    pairs = extract_pairs(df, [Unigrams(), ARCS], BagOfWords(2))
    write_pairs(pairs, str(tmp_path / "pairs"))
    counts = count_pairs(read_pairs(spark, str(tmp_path / "pairs")))
    want = counted(count_pairs(pairs))
    assert counted(counts) == want
    write_counts(counts, str(tmp_path / "counts"))
    assert counted(read_counts(spark, str(tmp_path / "counts"))) == want
    for space in ("core", "peripheral"):
        files = sorted((tmp_path / "counts" / f"space={space}").glob("part-*"))
        lines = [l for f in files for l in f.read_text().splitlines()]
        keys = [tuple(l.split("\t")[:2]) for l in lines]
        assert keys == sorted(keys) and len(set(keys)) == len(keys) > 0
    write_counts(counts, str(tmp_path / "parquet"), format="parquet")
    assert counted(read_counts(spark, str(tmp_path / "parquet"), format="parquet")) == want


def test_sorting(spark):
    counts = table(spark, [("core", "b", "x", 1), ("core", "a", "é", 3), ("core", "a", "z", 3), ("core", "B", "x", 2)])
    order = lambda *a: [(r.pivot, r.context) for r in sort_counts(counts, *a).collect()]
    by_key = [("B", "x"), ("a", "z"), ("a", "é"), ("b", "x")]
    assert order() == by_key
    assert order(False, True) == by_key[::-1]
    assert order(True) == [("b", "x"), ("B", "x"), ("a", "z"), ("a", "é")]
    assert order(True, True) == [("a", "é"), ("a", "z"), ("B", "x"), ("b", "x")]


def test_merging_is_counting_the_union(spark, tmp_path):
    a, b = sentences(22, 15), sentences(23, 15)
    frames = [
        cooccurrence_counts(read_corpus(spark, write(tmp_path, plain.corpus(s), n)), window=2, compositions=[ARCS])
        for s, n in ((a, "a"), (b, "b"), (a + b, "ab"))
    ]
    assert counted(merge_counts(frames[0], frames[1])) == counted(frames[2])


def test_store(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.read().isEmpty()
    first = table(spark, [("core", "a", "x", 1), ("core", "a", "y", 2)])
    assert store.add(first, batch=0)
    assert not store.add(first, batch=0)
    # a table without its version, from a job that died, is not in force
    first.write.parquet(str(tmp_path / "store" / "tier0-left"))
    assert store.version() == 1
    assert store.add(table(spark, [("core", "a", "y", 5), ("peripheral", "a<-->b", "x", 1)]), unique=True)
    assert counted(store.read()) == {
        ("core", "a", "x"): 1,
        ("core", "a", "y"): 7,
        ("peripheral", "a<-->b", "x"): 1,
    }
    assert store.version() == 2


def test_store_tells_sources_apart(spark, tmp_path):
    """Batch 0 of two sources, or of a stream with a new checkpoint, are two batches."""
    store = CountStore(spark, str(tmp_path / "store"))
    one = table(spark, [("core", "a", "x", 1)])
    assert store.add(one, batch=0, source="s")
    assert store.add(one, batch=0, source="t")
    assert not store.add(one, batch=0, source="t")
    assert counted(store.read()) == {("core", "a", "x"): 2}


def test_store_fails_when_the_version_moved(spark, tmp_path):
    store, other = (CountStore(spark, str(tmp_path / "store")) for _ in range(2))
    store.add(table(spark, [("core", "a", "x", 1)]), batch=0, source="s")
    seen = other._current()
    store.add(table(spark, [("core", "a", "x", 2)]), batch=1, source="s")
    other._current = lambda: seen  # as if it had looked before the addition
    with pytest.raises(RuntimeError, match="another writer"):
        other.add(table(spark, [("core", "a", "x", 100)]), batch=0, source="t")
    assert counted(store.read()) == {("core", "a", "x"): 3}
    assert CountStore(spark, store.path).add(table(spark, [("core", "a", "x", 100)]), batch=0, source="t")
    assert counted(store.read()) == {("core", "a", "x"): 103}


def test_store_merges_its_tables(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "store"), merge_after=2)
    for i in range(7):
        store.add(table(spark, [("core", "a", "x", 1), ("core", "a", str(i), i)]), batch=i)
    assert counted(store.read()) == {("core", "a", "x"): 7, **{("core", "a", str(i)): i for i in range(7)}}
    version, tables = store._current()
    assert version == 7 and sorted(t.split("-")[0] for t in tables) == ["tier0", "tier1", "tier2"]
    on_disk = {p.name for p in (tmp_path / "store").iterdir()} - {"versions", "snapshots"}
    # those of the version before are still there for its readers
    assert set(tables) <= on_disk and len(on_disk) <= 4


def test_store_of_writers_at_once(spark, tmp_path):
    """Of additions that start from the same version one is made, and none is lost or added twice."""
    path = str(tmp_path / "store")
    CountStore(spark, path).add(table(spark, [("core", "a", "x", 1)]))
    barrier, outcome = threading.Barrier(4), []

    def write(i: int) -> None:
        store = CountStore(spark, path)
        publish = store._publish
        store._publish = lambda *args: (barrier.wait(60), publish(*args))[1]
        try:
            outcome.append((i, store.add(table(spark, [("core", "a", f"w{i}", 1)]), batch=i, source="s")))
        except RuntimeError:
            outcome.append((i, None))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (made,) = [i for i, done in outcome if done]
    assert len(outcome) == 4
    assert counted(CountStore(spark, path).read()) == {("core", "a", "x"): 1, ("core", "a", f"w{made}"): 1}
    assert sum(not p.name.startswith(".") for p in (tmp_path / "store" / "versions").iterdir()) == 2


def test_store_log_is_compacted(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "store"), merge_after=4, snapshot_after=3)
    for i in range(11):
        assert store.add(table(spark, [("core", "a", "x", 1)]), batch=i, source="s")
    names = lambda folder: sorted(p.name for p in (tmp_path / "store" / folder).iterdir() if not p.name.startswith("."))
    assert len(names("versions")) <= 6 and names("snapshots")[-1].endswith("009") and len(names("snapshots")) <= 2
    again = CountStore(spark, store.path, snapshot_after=3)
    assert again.version() == 11 and counted(again.read()) == {("core", "a", "x"): 11}
    assert not any(again.add(table(spark, [("core", "a", "x", 1)]), batch=i, source="s") for i in range(11))


def test_store_with_ten_thousand_versions(spark, tmp_path):
    """As after 10,000 batches: they are read from one table."""
    store = CountStore(spark, str(tmp_path / "store"))
    store.add(table(spark, [("core", "a", "x", 1)]), batch=0, source="s")
    tables = store._current()[1]
    rows = spark.range(1, 10_001).select(
        F.col("id").alias("version"), F.lit("s").alias("source"), (F.col("id") - 1).alias("batch"), F.array(F.lit(tables[0])).alias("tables")
    )
    rows.coalesce(1).write.parquet(f"{store.path}/snapshots/{10_000:012d}")
    assert store._publish(json.dumps({"version": 10_001, "source": "s", "batch": 10_000, "tables": tables}), f"{10_001:012d}")
    assert not store.add(table(spark, [("core", "a", "x", 1)]), batch=7_777, source="s")
    assert store.add(table(spark, [("core", "a", "x", 4)]), batch=10_001, source="s") and store.version() == 10_002
    assert counted(store.read()) == {("core", "a", "x"): 5}


def test_export(spark, tmp_path):
    counts = table(spark, [("core", "b", "x", 1), ("peripheral", "a<-->c", "x", 3), ("core", "a", "z", 3)])
    export_counts(counts, str(tmp_path / "out"), by_value=True, reverse=True)
    lines = [l for f in sorted((tmp_path / "out").glob("part-*")) for l in f.read_text().splitlines()]
    assert lines == ["a<-->c\tx\t3", "a\tz\t3", "b\tx\t1"]


def test_vocabulary(spark, tmp_path):
    words = read_words(spark, write(tmp_path, "red\ncar\nred\n", "list.txt"))
    df = spark.createDataFrame([("red",), ("car",), ("bus",)], "w string")
    coded = encode(df, "w", words, "i")
    assert {(r.w, r.i) for r in coded.collect()} == {("red", 2), ("car", 1), ("bus", None)}
    back = decode(coded.where("i IS NOT NULL").select("i"), "i", words, "w")
    assert {(r.i, r.w) for r in back.collect()} == {(2, "red"), (1, "car")}


@pytest.mark.parametrize("block", [512, 2])
def test_whole_sentence_counts_of_phrases(spark, tmp_path, block):
    """Like pairs listed one by one; words that repeat, phrases that overlap, and tokens without text."""
    text = "".join(f"{plain.corpus(sentences(i, 9, 9, wild=True))}</text>\n" for i in range(50, 53))
    phrase = LinearPhrases("T<pos=NN.?>T<>(T<pos=JJ>T<>)*")
    for separator in ("s", "text"):
        corpus = read_corpus(spark, write(tmp_path, text), separator=separator)
        for matchers in ([ARCS], [Unigrams(), ARCS, phrase], [phrase]):
            for formats in ({}, dict(target_format="{lemma}", context_format="{pos}")):
                want = counted(count_pairs(extract_pairs(corpus, matchers, BagOfWords(), **formats)))
                assert counted(whole_sentence_match_counts(corpus, matchers, block=block, **formats)) == want


@pytest.mark.parametrize("separator", ["s", "text"])
def test_whole_sentences_are_counted_in_rounds(spark, tmp_path, monkeypatch, separator):
    """Rounds share no pair and make up all counts, also where ids repeat; each is a part of the pairs, which lie on disk at a time."""
    monkeypatch.setattr(counting, "LEAST_PAIRS", 1)
    text = "".join(f"{plain.corpus(sentences(i, 9, 9, wild=True))}</text>\n" for i in range(60, 64))
    corpus = read_corpus(spark, write(tmp_path, text), separator=separator)
    want = counted(counting.whole_sentence_counts(corpus))
    rounds = [counted(counts) for counts in counting.whole_sentence_rounds(corpus, block=4)]
    assert len(rounds) > 3 and sum(map(len, rounds)) == len(want) and sum(rounds, Counter()) == want
    assert max(map(len, rounds)) < 0.7 * len(want)
    assert [counted(c) for c in counting.whole_sentence_rounds(corpus.limit(0))] == [{}]


def test_equal_sentences_are_dealt_out(spark):
    """Sentences without targets do not cross the shuffle, and equal ones do not meet in one task."""
    found = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    rows = spark.range(400).select(F.col("id").alias("doc_id"), found.alias("_t"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions are not put together
    try:
        dealt = dealt_blocks(rows.withColumn("_key", sentence_hash(rows)), 512)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 200 and max(sizes) < 100


@pytest.mark.parametrize("separator, w", [("s", 1), ("s", 3), ("text", 2)])
def test_encoded_before_counting(spark, tmp_path, separator, w):
    """Like counts of words that are encoded afterwards; also where ids repeat, and with repeated list entries."""
    text = "".join(f"{plain.corpus(sentences(i, 7, 9))}</text>\n" for i in range(40, 44))
    corpus = read_corpus(spark, write(tmp_path, text), separator=separator).withColumn("k", F.to_json("sent_key")).drop("sent_key")
    words = read_words(spark, write(tmp_path, "red\ncar\nbe\nred\nthe\nnone\n", "list.txt"))
    counts = cooccurrence_counts(corpus, window=w, target_format="{lemma}", context_format="{lemma}")
    want = encode(encode(counts, "pivot", words, "pivot_id"), "context", words, "context_id")
    want = want.where("pivot_id IS NOT NULL AND context_id IS NOT NULL")
    coded = encoded_tokens(corpus, words, ["k"], "{lemma}")
    columns = ["pivot_id", "context_id", "occurrences", "pivot", "context"]
    got = decode_counts(packed_counts(coded, w), words).select(columns).collect()
    assert sorted(got) == sorted(want.select(columns).collect()) and len(got) > 8
    assert packed_counts(encoded_tokens(corpus, words.limit(0), ["k"], "{lemma}"), w).collect() == []


def test_streams(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    parsed = [sentences(s, 8) for s in (31, 32, 33)]
    store = CountStore(spark, str(tmp_path / "store"))
    state = str(tmp_path / "state")
    matchers, window = [Unigrams(), ARCS], BagOfWords(2)
    want = lambda k: counted(
        cooccurrence_counts(
            read_corpus(spark, [str(folder / f"f{i}.txt") for i in range(k)]), window=2, compositions=[ARCS]
        )
    )
    for k, s in enumerate(parsed, 1):
        write(folder, plain.corpus(s), f"f{k - 1}.txt")
        stream_merge(spark, str(folder), store, state, matchers, window).awaitTermination()
        assert counted(store.read()) == want(k)
    # nothing new: the stream goes on from its checkpoint and adds nothing
    stream_merge(spark, str(folder), store, state, matchers, window).awaitTermination()
    assert counted(store.read()) == want(3)

    # another checkpoint starts at batch 0 again, and its batches are others
    stream_merge(
        spark, str(folder), store, str(tmp_path / "other"), matchers, window, files_per_batch=1
    ).awaitTermination()
    assert counted(store.read()) == {k: 2 * n for k, n in want(3).items()}
    assert store.version() >= 6

    # changed rows only: what the second batch writes does not hold what only the first one has
    changes, state = ChangedCounts(spark, str(tmp_path / "changes")), str(tmp_path / "running")
    stream_changes(spark, str(folder), changes, state, matchers, window, files_per_batch=1).awaitTermination()
    assert counted(changes.read()) == want(3)
    per_batch = {r["batch"]: r["count"] for r in spark.read.parquet(changes.path).groupBy("batch").count().collect()}
    distinct = [
        cooccurrence_counts(read_corpus(spark, str(folder / f"f{i}.txt")), window=2, compositions=[ARCS]).count() for i in range(3)
    ]
    assert sorted(per_batch.values()) == sorted(distinct)
    stream_changes(spark, str(folder), changes, state, matchers, window).awaitTermination()
    assert counted(changes.read()) == want(3)
    assert counted(ChangedCounts(spark, str(tmp_path / "none")).read()) == {}

    running = stream_counts(spark, str(folder), matchers, window, files_per_batch=1)
    query = running.writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    assert counted(spark.table("running")) == want(3)


def test_bad_sentences_of_streams(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    good = plain.corpus(sentences(34, 4))
    write(folder, good + "<s>\nred\tred\n</s>\n", "a.txt")
    store, bad = CountStore(spark, str(tmp_path / "store")), str(tmp_path / "bad")
    stream_merge(
        spark, str(folder), store, str(tmp_path / "state"), [Unigrams()], BagOfWords(2), bad_path=bad
    ).awaitTermination()
    assert counted(store.read()) == counted(cooccurrence_counts(read_corpus(spark, str(folder)), window=2))
    (row,) = spark.read.parquet(bad).collect()
    assert row["file"].endswith("a.txt") and "red\tred" in row["lines"]
    query = read_bad_sentences_stream(spark, str(folder)).writeStream.format("memory").queryName("bad").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("bad").count() == 1
    with pytest.raises(Exception, match="bad sentence"):
        stream_merge(
            spark, str(folder), CountStore(spark, str(tmp_path / "strict")), str(tmp_path / "state2"),
            [Unigrams()], BagOfWords(2), mode="failfast",
        ).awaitTermination()
