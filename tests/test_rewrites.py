"""Trimming, noun heads, splitting, word stream and graphs."""

from __future__ import annotations

import gzip
import random
import re
from pathlib import Path
from urllib.parse import unquote

import pytest

from arcwindow.operators import graph, order
from arcwindow.operators.graph import dep_edges, dot_graphs
from arcwindow.operators.heads import contentful_noun_heads
from arcwindow.operators.order import running_totals
from arcwindow.operators.split import split_by_sentences, split_by_texts
from arcwindow.operators.trim import Pivots, trim
from arcwindow.operators.word_stream import word_stream
from arcwindow.plans.scratch import checkpoint_folder
from arcwindow.sinks.corpus import sentence_text, write_corpus, write_files, write_lines, write_parts
from arcwindow.sinks.counts import write_counts
from arcwindow.sources.corpus import read_corpus
from pyspark.sql import functions as F
from tests import plain
from tests.cases import RED_CAR, lines_of, sentences, write


def token_lines(df) -> list[list[str]]:
    texts = df.orderBy("sent_key").select(sentence_text(df, markup=False)).collect()
    return [t[0].split("\n")[1:-1] for t in texts]


def test_trim_red_car(spark, tmp_path):
    red = read_corpus(spark, write(tmp_path, RED_CAR), int_ids=True)
    assert token_lines(trim(red, Pivots(pos="N"))) == [["car\tcar\tNN\t1\t-1\tSBJ"]]
    assert token_lines(trim(red, Pivots(pos="J|N"))) == [
        ["red\tred\tJJ\t1\t2\tNMOD", "car\tcar\tNN\t2\t-1\tSBJ"]
    ]
    assert token_lines(trim(red, Pivots(pos="X"))) == [[]]
    assert token_lines(trim(red, Pivots())) == [RED_CAR.split("\n")[2:8]]


@pytest.mark.parametrize("shift", [0, 3])
def test_trim_like_plain(spark, tmp_path, shift):
    """With a shift the ids do not begin at 1, and are counted instead of looked up."""
    parsed = sentences(12, 30, 12, wild=True)
    for s in parsed:
        for t in s:
            t["id"] = str(int(t["id"]) + shift)
    df = read_corpus(spark, write(tmp_path, plain.corpus(parsed)), int_ids=True)
    rows = trim(df, Pivots(lemma="(red|c)", pos="(J|N|v)")).orderBy("sent_key").collect()
    got = [list(zip(map(int, r.tok_id), map(int, r.tok_dep_id))) for r in rows]
    keep = lambda t: re.match("(red|c)", t["lemma"], re.I) and re.match("(J|N|v)", t["pos"], re.I)
    assert got == [plain.trim(s, keep) for s in parsed]


def test_trim_keeps_columns_and_lowers(spark, tmp_path):
    text = "<s>\nA\tA\tNN\t1\t2\tX\tseven\teight\nB\tBe\tVV\t2\t0\tY\tseven\n</s>\n<s>\n</s>\n</text>\n"
    df = read_corpus(spark, write(tmp_path, text), int_ids=True, keep_tails=True)
    done = trim(df, Pivots(words=["be"]), to_lower=True)
    out = tmp_path / "out"
    write_corpus(done, str(out), order=["sent_key"])
    printed = "".join(f.read_text() for f in sorted(out.glob("part-*")))
    assert printed == "<s>\nB\tbe\tVV\t1\t0\tY\tseven\n</s>\n<s>\n</s>\n</text>\n"
    assert all(not r.tok_id for r in trim(df, Pivots(words=["be"])).collect())
    # a list goes before the patterns
    listed = trim(df, Pivots(lemma="A", words=["Be"])).orderBy("sent_key").first()
    assert listed.tok_lemma == ["Be"]


def test_noun_heads_red_car(spark, tmp_path):
    text = RED_CAR + "<s>\na\ta\tNN\t2\t3\tX\n</s>\n"
    df = contentful_noun_heads(read_corpus(spark, write(tmp_path, text)))
    rows = df.orderBy("sent_key").collect()
    assert rows[0].tok_dep_id == ["3", "3", "6", "0", "4", "5"]
    assert [r.rewritten for r in rows] == [True, False]


def test_noun_heads_like_plain(spark, tmp_path):
    parsed = sentences(13, 150, 14)
    rng = random.Random(13)
    for s in parsed:  # more chains than chance makes
        for i, t in enumerate(s, 1):
            if rng.random() < 0.5 and i > 1:
                t.update(pos=rng.choice(["VV", "MD", "JJ"]), dep_id=str(rng.randint(1, i - 1)))
                t.update(dep_rel=rng.choice(["VC", "VC", "PRD", "OBJ"]))
            elif i < len(s):
                t.update(pos="NN", dep_id=str(rng.randint(i + 1, len(s))))
    df = read_corpus(spark, write(tmp_path, plain.corpus(parsed)))
    rows = contentful_noun_heads(df).orderBy("sent_key").collect()
    assert all(r.rewritten for r in rows)
    got = [[int(h) for h in r.tok_dep_id] for r in rows]
    assert got == [plain.noun_heads(s) for s in parsed]
    assert sum(a != [int(t["dep_id"]) for t in s] for a, s in zip(got, parsed)) > 10


def test_noun_heads_long_chain(spark, tmp_path):
    n = 300
    chain = [dict(zip(plain.FIELDS, ("v", "v", "VV", str(i), str(i - 1), "VC"))) for i in range(2, n + 1)]
    noun = dict(zip(plain.FIELDS, ("n", "n", "NN", "1", "2", "SBJ")))
    df = read_corpus(spark, write(tmp_path, plain.corpus([[noun, *chain]])))
    assert contentful_noun_heads(df).first().tok_dep_id[0] == str(n)


def test_noun_heads_keep_odd_lines(spark, tmp_path):
    seven = RED_CAR.replace("SBJ", "SBJ\tseven")
    df = contentful_noun_heads(read_corpus(spark, write(tmp_path, seven)))
    assert token_lines(df)[0][2] == "car\tcar\tNN\t3\t6\tSBJ\tseven"


def test_word_stream(spark, tmp_path):
    text = RED_CAR.replace("sold\tsell\tVVN", "selling\tsell\tVVG").replace("The\tthe\tDT", "x\tx--y\tNN")
    lines = word_stream(read_corpus(spark, write(tmp_path, text))).orderBy("place")
    assert lines_of(lines) == ["<s>", "red-j", "car-n", "sell-vvg"]
    no_open = text.replace("<s>\n", "")
    assert lines_of(word_stream(read_corpus(spark, write(tmp_path, no_open, "b.txt"))))[0] == "red-j"


def test_graph(spark, tmp_path):
    text = "<s>\nred\tred\tJJ\t1\t2\tNMOD\ncar\tcar\tNN\t2\t0\tROOT\n</s>\n" * 2
    df = read_corpus(spark, write(tmp_path, text + "<s>\nx\tx\tNN\t1\t0\tX\textra\n</s>\n"))
    rows = dot_graphs(df, ["sent_key"]).orderBy("sent_key").collect()
    assert [r.number for r in rows] == [0, 1, 2]
    assert rows[1].dot.split("\n") == [
        "digraph sentence_1 {",
        'n_1[label="red/JJ"];',
        'n_1 -> n_2 [label="NMOD"];',
        'n_2[label="car/NN"];',
        'n_2 -> n_0 [label="ROOT"];',
        'label = "red car"',
        "}",
    ]
    assert rows[2].dot is None
    assert dep_edges(df).count() == 5


def test_graphs_number_slim_sentences(spark, monkeypatch):
    """Only a graph's fields are sorted, as one text; fields with line ends, without value, and no tokens make the same graphs."""
    rows = [
        (0, ["a", "b c"], ["NN", "V\tV"], ["1", "2"], ["2", "0"], ["X", ""]),
        (1, ["a\nb", None], ["NN", "VV"], ["1", "2"], ["2", None], ["X", "\n"]),
        (2, ["été", ""], [None, "VV"], ["1", "2"], ["2", "0"], ["X", "Y\\n"]),
        (3, [], [], [], [], []),
    ]
    names = ("word", "pos", "id", "dep_id", "dep_rel")
    arrays = ", ".join(f"tok_{n} array<string>" for n in names)
    df = spark.createDataFrame(rows, f"k int, {arrays}").withColumns(
        {"tok_lemma": F.col("tok_word"), "tok_line": F.lit(None).cast("array<string>"), "tok_n_fields": F.lit(None).cast("array<int>")}
    )
    held = []
    number = graph.row_numbers
    monkeypatch.setattr(graph, "row_numbers", lambda d, *more: held.append(d.columns) or number(d, *more))
    got = [r.dot for r in graph.dot_graphs(df, ["k"]).orderBy("k").collect()]

    def dot(k, words, tags, ids, heads, relations):
        lines = [f"digraph sentence_{k} {{"]
        for w, p, i, h, r in zip(*[["null" if v is None else v for v in x] for x in (words, tags, ids, heads, relations)]):
            lines += [f'n_{i}[label="{w}/{p}"];', f'n_{i} -> n_{h} [label="{r}"];']
        return "\n".join([*lines, f'label = "{" ".join(w for w in words if w is not None).strip(" ")}"', "}"])

    assert got == [dot(*row) for row in rows]
    assert [set(c) & {"tok_lemma", "tok_word"} for c in held] == [set()]


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_running_totals(spark, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        _check_running_totals(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _check_running_totals(spark):
    rng = random.Random(1)
    values = [(i, rng.randint(0, 5)) for i in range(500)]
    rng.shuffle(values)
    df = spark.createDataFrame(values, "k bigint, v bigint")
    rows = running_totals(df, ["k"], {"s": F.col("v"), "n": F.lit(1)}).orderBy("k").collect()
    total = 0
    for i, (r, (_, v)) in enumerate(zip(rows, sorted(values)), 1):
        total += v
        assert (r.s, r.n) == (total, i)


@pytest.mark.parametrize("n", [1, 5, 40, 10**6])
def test_parts_like_plain(spark, n):
    rng = random.Random(n)
    texts = [rng.choice([0, 1, 2, 3, 30]) for _ in range(120)]
    df = spark.createDataFrame(
        [(i, t, True) for i, t in enumerate(texts)], "k bigint, n_sentences bigint, ends_text boolean"
    )
    rows = split_by_sentences(df, ["k"], n).orderBy("k").collect()
    assert [r.part for r in rows] == plain.parts(texts, n)
    by_texts = split_by_texts(df, ["k"], min(n, 50)).orderBy("k").collect()
    assert [r.part for r in by_texts] == [i // min(n, 50) + 1 for i in range(120)]


def test_parts_need_a_size(spark):
    df = spark.createDataFrame([(1, 1, True)], "k bigint, n_sentences bigint, ends_text boolean")
    for split in (split_by_texts, split_by_sentences):
        with pytest.raises(ValueError):
            split(df, ["k"], 0)


@pytest.mark.parametrize("layout", ["files", "splits"])
def test_rewritten_files_keep_files_and_order(spark, tmp_path, layout):
    """Every input file has a folder of its own with its lines in order, also where it was read in many splits."""
    folder, out = tmp_path / "in", tmp_path / f"out-{layout}"
    folder.mkdir()
    whole = {}
    for i, n in enumerate((40, 1, 7)):
        name = f"f {i}=%.txt"
        whole[str(folder / name)] = text = f'<text id="{i}">\n{plain.corpus(sentences(60 + i, n, 9))}</text>\n'
        write(folder, text, name)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        corpus = read_corpus(spark, str(folder), layout=layout, keep_tails=True)
        write_files(corpus, str(out))
        trimmed = trim(corpus, Pivots(pos="N"))
        write_files(trimmed, str(out) + "-trimmed")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

    def written(path) -> dict[str, str]:
        found = {}
        for part in sorted(path.glob("file=*/part-*"), key=lambda p: (p.parent, p.name)):
            name = re.sub("^file:/+", "/", unquote(unquote(part.parent.name.removeprefix("file="))))
            found[name] = found.get(name, "") + part.read_text()
        return found

    assert written(out) == whole
    assert set(written(tmp_path / f"out-{layout}-trimmed")) == set(whole)


def test_rows_are_made_once_before_they_are_sorted_into_files(spark, tmp_path):
    """To find the borders of ranges Spark reads rows twice; sentences and counts are made only once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def watched(df):
        return df.mapInArrow(counted, df.schema)

    write(tmp_path, RED_CAR)
    corpus = read_corpus(spark, str(tmp_path), layout="splits", keep_tails=True)
    n = corpus.count()
    write_files(watched(corpus), str(tmp_path / "files"))
    assert made.value == n
    counts = spark.createDataFrame([("core", "a", "b", 1), ("core", "b", "a", 2)], "space string, pivot string, context string, occurrences bigint")
    write_counts(watched(counts), str(tmp_path / "counts"))
    assert made.value == n + 2


def test_texts_of_parts_are_held_once(spark, tmp_path, monkeypatch):
    """Cuts are found without the texts; parts, compressed, hold their pieces in order."""
    held = []
    cut = order.cut_lineage
    monkeypatch.setattr(order, "cut_lineage", lambda df, *more: held.append(df.columns) or cut(df, *more))
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 2, 9]) for _ in range(80)]
    rows = [(i // 9, i % 9, f"text {i}\n</text>\n", n, i % 7 != 3) for i, n in enumerate(sizes)]
    pieces = spark.createDataFrame(rows, "a int, b int, value string, n_sentences bigint, ends_text boolean").repartition(5)
    parted = split_by_sentences(pieces, ["a", "b"], 6)
    assert sorted("value" in c or "_row" in c for c in held) == [False] * (len(held) - 1) + [True]
    texts = []
    for n, (_, _, _, _, ends) in zip(sizes, rows):
        texts = [*texts[:-1], [*texts[-1], n]] if texts and not closed else [*texts, [n]]
        closed = ends
    part_of_text = plain.parts([sum(t) for t in texts], 6)
    want = {}
    for (_, _, value, _, _), part in zip(rows, (p for t, p in zip(texts, part_of_text) for _ in t)):
        want[part] = want.get(part, "") + value
    write_parts(parted, str(tmp_path / "parts"), ["a", "b"], compression="gzip")
    got = {}
    for path in sorted((tmp_path / "parts").glob("out=*/*.gz")):
        part = int(path.parent.name.removeprefix("out="))
        got[part] = got.get(part, "") + gzip.decompress(path.read_bytes()).decode()
    assert got == want and len(got) > 10


def test_what_is_sorted_into_files_is_removed(spark, tmp_path):
    """Lines lie in the shared folder only until they are sorted; files are of bounded size and compressed."""
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), F.concat(F.lit("line "), "id").alias("l"))
    write_lines(df, "l", str(tmp_path / "lines"), order=["k"], compression="gzip", file_rows=60)
    files = sorted((tmp_path / "lines").glob("part-*.txt.gz"))
    lines = [line for f in files for line in gzip.decompress(f.read_bytes()).decode().splitlines()]
    assert lines == [r["l"] for r in df.orderBy("k").collect()] and len(files) > 8
    assert not list(folder.glob("passing-*"))
