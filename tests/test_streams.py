"""Streams over files of any size and number."""

from __future__ import annotations

from arcwindow.operators.matchers import Unigrams
from arcwindow.operators.windows import BagOfWords
from arcwindow.plans import catalog
from arcwindow.plans.catalog import QUERIES
from arcwindow.plans.cooccurrence import cooccurrence_counts
from arcwindow.sinks.counts import CountStore
from arcwindow.sources.corpus import read_corpus, read_corpus_stream
from arcwindow.streaming.counts import stream_merge
from tests import plain
from tests.cases import sentences, write
from tests.test_counts import ARCS, counted


def test_streams_read_files_by_records(spark, tmp_path):
    """A file of a batch is cut anywhere, and no record holds more than a sentence of it."""
    folder = tmp_path / "arriving"
    folder.mkdir()
    parsed = sentences(35, 40)
    write(folder, plain.corpus(parsed), "a.txt")
    seen = []

    def keep(batch, batch_id):
        seen.append((batch.rdd.getNumPartitions(), batch.count()))

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        stream = read_corpus_stream(spark, str(folder), layout="splits")
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).start().awaitTermination()
        store = CountStore(spark, str(tmp_path / "store"))
        stream_merge(
            spark, str(folder), store, str(tmp_path / "other"), [Unigrams(), ARCS], BagOfWords(2), layout="splits"
        ).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    ((partitions, rows),) = seen
    assert partitions > 4 and rows == read_corpus(spark, str(folder)).count()
    assert counted(store.read()) == counted(
        cooccurrence_counts(read_corpus(spark, str(folder)), window=2, compositions=[ARCS])
    )


def test_stream_queries_keep_the_files_of_the_writing_tasks(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs.repartition(11, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    for k in before:
        spark.conf.set(k, "4096")
    try:
        folder, files_per_batch = catalog._arriving(spark, str(tmp_path))
        files = len(spark.read.text(folder).inputFiles())
        got = [counted(QUERIES[name](spark, str(tmp_path))) for name in ("streamed_counts", "streamed_merge")]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files > 8 and files_per_batch > 1
    want = counted(QUERIES["dependency_window_counts"](spark, str(tmp_path)))
    assert got == [want, want]
