"""Hard negatives, sharding and alignment of tokens, against plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from arcwindow.llm import alignment, negatives, shards
from arcwindow.llm.queries import BYTE_BPE, PIECE_BPE, vocabulary_file
from tests.llm import brute
from tests.llm.conftest import documents, prose

# -- hard negatives ---------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def found(df) -> set[tuple]:
    rows = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in rows.select(*names).collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_vectors(rng: random.Random, n: int, dimensions: int, labels: int) -> list[tuple]:
    """Vectors around a few centres, so that scores of other labels come close; some are equal."""
    centres = [[rng.gauss(0, 0.3) for _ in range(dimensions)] for _ in range(4)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]
    return rows + [(n + i, rows[i][1], rows[(i * 7) % n][2]) for i in range(n // 8)]


@pytest.mark.parametrize("dimensions, labels, block", [(8, 3, (64, 3)), (13, 40, (32, 2)), (24, 1, (2048, 256)), (3, 2, (7, 1))])
def test_hard_negatives(spark, monkeypatch, dimensions, labels, block):
    """Also with labels that fill many blocks, and many labels in one."""
    monkeypatch.setattr(negatives, "CANDIDATES", block[0])
    monkeypatch.setattr(negatives, "ANCHORS", block[1])
    rows = random_vectors(random.Random(dimensions), 400, dimensions, labels)
    assert found(spark.createDataFrame(rows, VECTORS)) == brute.hard_negatives(rows)


def test_hard_negatives_of_odd_and_empty_tables(spark):
    rng = random.Random(5)
    rows = random_vectors(rng, 160, 6, 3)
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, rows[0][1], 1),
        (50, None, 1),
        (100, [0.5] * 6, None),
        (201, [0.5, nan, 0.5, 0.5, 0.5, 0.5], 1),
        (202, [0.5, 0.5, 0.5, inf, 0.5, 0.5], 2),
        (203, [0.5, None, 0.5, 0.5, 0.5, 0.5], 2),
        (204, [], 1),
        (205, [0.0] * 6, 0),
        (206, [0.7, 0.2], 2),
        (207, [-4.0, 4.0, -0.001, 3.0, 2.0, 1.0, 1.0, 9.0, 2.0], 0),
        rows[3],
        (7, [0.9] * 6, 0),
        (250, [0.25] * 6, 99),
    ]
    df = spark.createDataFrame(rows + odd, VECTORS)
    df = df.selectExpr("*", "1 AS number", "'x' AS block", "2 AS score", "array('q') AS whole", "3 AS rank", "4 AS `a.b`")
    assert found(df) == brute.hard_negatives(rows + odd)
    assert found(spark.createDataFrame([], VECTORS)) == set()
    assert found(spark.createDataFrame([(50, [0.5], 1)], VECTORS)) == set()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 20), st.integers(1, 30), st.integers(0, 2**32), st.sampled_from([1, 300, 2**20]))
def test_scores_by_tables_are_inner_products(anchors, candidates, seed, largest):
    rng = np.random.default_rng(seed)
    a, c = (rng.integers(-largest, largest + 1, (n, 16)) for n in (anchors, candidates))
    planes = negatives.bit_planes(c.astype(np.int32), largest.bit_length() + 1)
    assert (negatives.scores(negatives.subset_sums(a, np.int64), planes) == c @ a.T).all()


# -- sharding ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**40), st.integers(1, 30))
def test_the_permutation_and_its_inverse(n, seed, k):
    p = shards.permuted(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert (shards.restored(p, n, seed) == np.arange(n)).all()
    shard, slot = shards.place(n - 1, n, k, seed)
    assert shards.row_at(shard, slot, n, k, seed) == n - 1


def test_large_numbers_stay_exact():
    n = (1 << 61) - 7
    numbers = np.array([0, 1, n // 3, n - 2, n - 1])
    p = shards.permuted(numbers, n)
    assert ((p >= 0) & (p < n)).all() and (shards.restored(p, n) == numbers).all()


def test_neighbours_are_shuffled():
    n = 10_000
    p = shards.permuted(np.arange(n), n)
    assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.05
    assert abs(np.corrcoef(np.diff(p)[:-1], np.diff(p)[1:])[0, 1] + 0.5) < 0.05  # as for independent places


def test_shards(spark, odd_documents, no_documents, tmp_path):
    rng = random.Random(2)
    table = documents(spark, [None, "", *[prose(rng, rng.randint(1, 40)) for _ in range(150)]] * 2)
    for df in (table, odd_documents.drop("spans"), table.selectExpr("*", "1 AS `a.b`", "map('x', 1) AS m", "0 AS place", "0 AS number", "0 AS read")):
        for n_shards in (7, 24):
            rows = shards.sharded(df, "doc_id", n_shards).collect()
            n = df.count()
            assert len(rows) == n
            assert sorted(r["row_number"] for r in rows) == list(range(n))
            for r in rows:
                assert (r["shard"], r["slot"]) == shards.place(r["row_number"], n, n_shards)
            for s in range(n_shards):
                slots = sorted(r["slot"] for r in rows if r["shard"] == s)
                assert slots == list(range(len(slots))) and len(slots) in (n // n_shards, -(-n // n_shards))
            ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["row_number"])]
            assert ids == sorted(ids, key=lambda i: (i is not None, i))
            key = lambda r: sorted((c, repr(r[c])) for c in df.columns)
            assert sorted(map(key, rows)) == sorted(map(key, df.collect()))
    again = [shards.sharded(table.repartition(k), "doc_id").collect() for k in (3, 11)]
    assert sorted(map(str, again[0])) == sorted(map(str, again[1]))
    assert shards.sharded(no_documents, "doc_id").collect() == []
    with pytest.raises(ValueError, match="slot"):
        shards.sharded(table.selectExpr("*", "1 AS SLOT"), "doc_id")

    path = str(tmp_path / "shards")
    shards.write_shards(shards.sharded(table, "doc_id", 5), path)
    for s in range(5):
        files = spark.read.parquet(f"{path}/shard={s}")
        assert sorted(r["slot"] for r in files.collect()) == list(range(files.count()))


def test_sharding_query(spark, tmp_path):
    from arcwindow.llm.queries import op12_feistel_sharding

    texts = [None, "", "é漢", "x" * 70_000, "same", "same"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op12_feistel_sharding(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert rows[i]["law"] == "rows" and rows[i]["grown_shard"] is None


# -- alignment --------------------------------------------------------------------------------

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files() -> tuple[str, str]:
    return vocabulary_file(BYTE_BPE), vocabulary_file(PIECE_BPE)


@pytest.fixture(scope="module")
def mixed_texts(odd_texts) -> list[str | None]:
    rng = random.Random(4)
    odd = [
        "<|endoftext|> <s> </s> <unk> <0x41>",
        " leading and trailing ",
        "a▁b",
        "漢字かな交じり文" * 12,
        "éèê ß ﬁ ́ ​",
        "aaaaaaaaaaaaaaaa 0000000000 ----------",
        "tab\tline\r\n\n  end",
        "😀😀 \x07\x00",
        "Donaudampfschifffahrtsgesellschaftskapitän " * 3,
    ]
    return [*odd_texts, *odd, *[prose(rng, rng.randint(1, 60)) for _ in range(40)]]


@pytest.mark.parametrize("known, together, large, remembered", [(1 << 18, 1 << 19, 8, 400_000), (20, 100, 1, 30), (0, 1 << 19, 2, 0)])
def test_alignment(spark, files, mixed_texts, monkeypatch, known, together, large, remembered):
    """Also with rare pairs joined, all pairs joined, small pieces, ids made distinct in small groups, and little memory."""
    for name, value in (("KNOWN", known), ("TOGETHER", together), ("LARGE_GROUP", large), ("REMEMBERED", remembered)):
        monkeypatch.setattr(alignment, name, value)
    rows = alignment.aligned(documents(spark, mixed_texts).coalesce(2), *files).collect()
    want, _ = brute.token_alignment(mixed_texts, *files)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in rows}
    assert len(rows) == len(mixed_texts)
    assert {i: (got[i], w) for i, w in enumerate(want) if got[i] != w} == {}
    assert sum(w[0] > 0 for w in want) > 40 and want[0][0] == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \u2581abzé漢'!s.0\t\n\u00a0\u3000\x1c\u200b")), max_size=30))
def test_parts_are_tokenized_like_whole_texts(files, tokenizers, text):
    a, b = tokenizers([text])
    whole = alignment.Tokenizers.__new__(alignment.Tokenizers)
    whole.__dict__ = tokenizers.__dict__ | {"in_parts": False, "known_a": {}, "known_b": {}, "unequal": set()}
    assert tokenizers.in_parts and (a, b) == whole([text])


def test_many_parts_are_tokenized_together(files, tokenizers, mixed_texts):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789ABZ.,-é漢"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(9000)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(300)] + [t or "" for t in mixed_texts]
    whole = alignment.Tokenizers.__new__(alignment.Tokenizers)
    whole.__dict__ = tokenizers.__dict__ | {"in_parts": False, "known_a": {}, "known_b": {}, "unequal": set()}
    assert tokenizers(texts) == whole(texts)


@pytest.fixture(scope="module")
def tokenizers(files):
    return alignment.Tokenizers(*files)


def test_groups_of_tokens(spark, files, mixed_texts):
    _, want = brute.token_alignment(mixed_texts, *files)
    for r in alignment.token_groups(documents(spark, mixed_texts).coalesce(2), *files).collect():
        groups = [([], []) for _ in want[r["doc_id"]]]
        for side, name in enumerate("ab"):
            for i, g in zip(r[f"{name}_ids"], r[f"{name}_group"]):
                groups[g][side].append(i)
        assert groups == want[r["doc_id"]]


def test_alignment_of_repeated_rows_odd_and_empty_tables(spark, files, odd_documents, odd_texts, no_documents):
    odd_documents = odd_documents.coalesce(2)
    texts = [*odd_texts, odd_texts[9], odd_texts[4]]
    want, _ = brute.token_alignment(texts, *files)
    got = sorted(map(str, (tuple(r[c] for c in NAMES) for r in alignment.aligned(odd_documents, *files).collect())))
    assert got == sorted(map(str, want))
    clash = odd_documents.selectExpr("*", "1 AS row", "2 AS pairs", "3 AS `a.b`", "4 AS n_best")
    assert alignment.aligned(clash, *files).count() == len(texts)
    assert alignment.aligned(no_documents, *files).collect() == []
    text_ids = documents(spark, ["one text", None]).coalesce(1).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"]: r["n_a"] > 0 for r in alignment.aligned(text_ids, *files).collect()} == {"d0": True, "d1": False}
