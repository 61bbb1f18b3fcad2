"""The pipeline's stages, each on what the one before kept, and the registered queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from arcwindow.llm.queries import QUERIES
from arcwindow.plans.scratch import cut_lineage
from tests.llm import brute
from tests.llm.conftest import DOCUMENTS

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = cut_lineage(stage(spark, docs, SF_DIR))
        out[name] = (docs, made)
        docs = made
    return out


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for name, (_, made) in stages.items():
        assert made.columns == COLUMNS + (["copy"] if name == "mixing" else [])


def test_near_copies(stages):
    before, after = (texts(df) for df in stages["near_copies"])
    want = brute.components(before, brute.jaccard_links(before, 5, 80))
    assert set(after) == {i for i, c in want.items() if i == c}


def test_decontamination(spark, stages):
    before, after = (texts(df) for df in stages["decontamination"])
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    assert set(after) == {i for i, t in before.items() if not brute.contamination(t, items)[1]}


def test_secrets(stages):
    before, after = (texts(df) for df in stages["secrets"])
    assert set(before) == set(after)
    for i, text in before.items():
        if brute.base_secrets(text):
            assert after[i] != text and "<secret>" in after[i]
        assert not brute.base_secrets(after[i])


def test_mixing(stages):
    before, made = stages["mixing"]
    sizes, rows = {}, made.collect()
    for r in before.collect():
        sizes.setdefault(r["source"], []).append(len(brute.SPACED.findall(r["text"])))
    want = brute.targets({s: sum(v) for s, v in sizes.items()})
    for source, own in sizes.items():
        taken = sum(len(brute.SPACED.findall(r["text"])) for r in rows if r["source"] == source)
        assert abs(taken - want[source]) <= max(own) / 2 + 1e-6


def test_pipeline_query(spark, stages):
    made = contract.queries()["pipeline"](spark, SF_DIR)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, stages["mixing"][1].collect()))


def test_pipeline_of_odd_and_empty_tables(spark, odd_documents, no_documents):
    for docs in (odd_documents.select(COLUMNS), no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = cut_lineage(stage(spark, docs, SF_DIR))
        assert docs.columns == [*COLUMNS, "copy"]
    assert docs.count() == 0 and DOCUMENTS


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in ("op1", "op3", "op5", "op7")])
def test_queries_against_brute_force(spark, name):
    import hashlib

    rows = texts(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES[name](spark, SF_DIR).collect()}
    assert set(got) == set(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if name.startswith("op1_"):
        assert {i: tuple(r)[1:] for i, r in got.items()} == brute.substring_dedup(rows)
    elif name.startswith("op7_"):
        want = brute.components(rows, brute.jaccard_links(rows))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {
            i: (len(brute.shingles(t, 4)), want[i]) for i, t in rows.items()
        }
    elif name.startswith("op5_"):
        items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
        for i, text in rows.items():
            n, hit, named = brute.contamination(text, items)
            digest = sha(",".join(sorted(map(str, named))))
            assert tuple(got[i])[1:] == (n, len(hit), len(named), digest, len(hit) > 0)
    else:
        for i, text in rows.items():
            spans = brute.base_secrets(text)
            counts = [sum(k == kind for _, _, k in spans) for kind in ("assign", "access", "hex")]
            assert tuple(got[i])[1:5] == (*counts, sha(",".join(f"{k}:{s}:{e}" for s, e, k in spans)))


def test_schema_of_the_result_is_the_contract(spark):
    want = {
        "op2_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        "op4_embedding_duplicates": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
        "op6_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        "op8_quality": "doc_id bigint, held_out boolean, score double, predicted int",
        "op10_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    }
    for name, ddl in want.items():
        df = QUERIES[name](spark, SF_DIR)
        assert ", ".join(f"{c} {k}" for c, k in df.dtypes) == ddl
        assert df.where(F.lit(True)).count() > 0
