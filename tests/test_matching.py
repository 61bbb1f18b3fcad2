"""Matchers, windows, word lists and counts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcwindow.functions.linear import Flagged, raw_field
from arcwindow.functions.predicates import TokenTest
from arcwindow.functions.tokens import TOKENS
from arcwindow.operators.counting import count_pairs, whole_sentence_counts
from arcwindow.operators import filters
from arcwindow.operators.filters import flag_words
from arcwindow.operators.grep import grep
from arcwindow.operators.matchers import (
    DependencyArcs,
    LinearPhrases,
    Matcher,
    Unigrams,
    composition_matchers,
)
from arcwindow.operators import windows
from arcwindow.operators.windows import BagOfWords, extract_pairs, match_rows, tokens_without_text
from arcwindow.plans.catalog import Ahead, Neighbours
from arcwindow.plans.cooccurrence import cooccurrence_counts, only_content
from arcwindow.sinks.corpus import sentence_text
from arcwindow.sources.annotated import annotated_sentences
from arcwindow.sources.corpus import read_corpus
from tests import plain
from tests.cases import RED_CAR, sentences, write


def counted(counts) -> Counter:
    return Counter({(r.pivot, r.context): r.occurrences for r in counts.collect()})


def corpus(spark, tmp_path, parsed, **options):
    return read_corpus(spark, write(tmp_path, plain.corpus(parsed)), **options)


def test_red_car(spark, tmp_path):
    red = read_corpus(spark, write(tmp_path, RED_CAR))
    arc = DependencyArcs(dependent=TokenTest(pos="JJ"), head=TokenTest(pos="N"))
    pairs = extract_pairs(red, [Unigrams(), arc], BagOfWords(1)).collect()
    assert {(p.target, p.context, p.marker) for p in pairs if "red-j" in p.target} == {
        ("red-j", "the-d", "l"),
        ("red-j", "car-n", "r"),
        ("red-j<-->car-n", "the-d", "l"),
        ("red-j<-->car-n", "have-v", "r"),
    }
    phrase = match_rows(red, [LinearPhrases("T<pos=JJ>T<pos=NN>")]).collect()
    assert [p.positions for p in phrase] == [[1, 2]]


@pytest.mark.parametrize("w", [None, 0, 1, 2, 5])
def test_counts_like_plain(spark, tmp_path, w):
    parsed = sentences(3, 25, 14, wild=True)
    df = corpus(spark, tmp_path, parsed)
    arc = DependencyArcs(relation="N", dependent=TokenTest(pos="(JJ|N)"), head=TokenTest(word="c"))

    def plain_arcs(s):
        return plain.arcs(
            s, "N", lambda t: re.match("(JJ|N)", t["pos"], re.I), lambda t: re.match("c", t["word"], re.I)
        )

    got = counted(cooccurrence_counts(df, window=w, compositions=[arc]))
    assert got == plain.count(parsed, [plain.unigrams, plain_arcs], w)


def test_repeated_ids(spark, tmp_path):
    """A whole text as one chunk: the last token of each id is the target, all are context."""
    parsed = sentences(4, 6, 5, wild=True)
    text = "".join(f"<text>\n{plain.corpus(parsed[i:i + 3])}</text>\n" for i in (0, 3))
    df = read_corpus(spark, write(tmp_path, text), separator="text")
    chunks = plain.read(text, "text")
    for w in (2, None):
        got = counted(cooccurrence_counts(df, window=w, compositions=[DependencyArcs(relation="S")]))
        assert got == plain.count(chunks, [plain.unigrams, lambda s: plain.arcs(s, "S")], w)
    assert counted(cooccurrence_counts(df)) == plain.count(chunks, [plain.unigrams])
    # printed by id: the last of each id, at the place of the first
    found = grep(df, [Unigrams()]).orderBy("sent_key").collect()
    want = [[s[i]["word"] for i in {t["id"]: k for k, t in enumerate(s)}.values()] for s in chunks]
    assert [r.tok_word for r in found] == want


def test_whole_sentence_forms_agree(spark, tmp_path):
    parsed = sentences(5, 20, 15)
    df = corpus(spark, tmp_path, parsed)
    for options in (
        {},
        {"target_format": "{lemma}", "context_format": "{pos}"},
        {"targets": ["car-n", "red-j"], "contexts": ["the-d", "car-n"]},
        {"target_format": "{lemma}", "context_format": "{pos}", "targets": ["car"], "contexts": ["NN"]},
    ):
        listed = count_pairs(extract_pairs(df, [Unigrams()], **options))
        assert counted(whole_sentence_counts(df, **options)) == counted(listed)
        spread = whole_sentence_counts(df, block=2, **options)
        assert counted(spread) == counted(listed)


def test_matchers_share_positions_once(spark, tmp_path):
    red = read_corpus(spark, write(tmp_path, RED_CAR))
    one = [LinearPhrases("T<pos=JJ>T<pos=NN>")]
    arc = DependencyArcs(dependent=TokenTest(pos="JJ"))
    both = counted(count_pairs(extract_pairs(red, [*one, arc], BagOfWords(2))))
    assert both == counted(count_pairs(extract_pairs(red, one, BagOfWords(2))))
    single = extract_pairs(red, [Unigrams(), LinearPhrases("T<pos=JJ>")], BagOfWords(2))
    assert single.count() == extract_pairs(red, [Unigrams()], BagOfWords(2)).count()


def test_order_inside_a_match_counts(spark, tmp_path):
    """(a, b) and (b, a) are two targets; a token that is its own head has one place."""
    text = "<s>\na\ta\tNN\t1\t2\tX\nb\tb\tNN\t2\t1\tX\nc\tc\tNN\t3\t3\tX\n</s>\n"
    df = read_corpus(spark, write(tmp_path, text))
    got = counted(count_pairs(extract_pairs(df, [DependencyArcs(relation="X")])))
    assert got == {
        ("a-n<-->b-n", "c-n"): 1,
        ("b-n<-->a-n", "c-n"): 1,
        ("c-n<-->c-n", "a-n"): 1,
        ("c-n<-->c-n", "b-n"): 1,
    }


def test_relation_is_case_sensitive_and_tests_are_not(spark, tmp_path):
    red = read_corpus(spark, write(tmp_path, RED_CAR))
    assert match_rows(red, [DependencyArcs(relation="nmod")]).count() == 0
    assert match_rows(red, [DependencyArcs(relation="NM")]).count() == 2
    assert match_rows(red, [DependencyArcs(dependent=TokenTest(word="THE"))]).count() == 1
    assert match_rows(red, [DependencyArcs(dependent=TokenTest(lemma="e"))]).count() == 0
    listed = DependencyArcs(dependent=TokenTest(words=["red-j", "car-n"]), head=TokenTest(words=["car-n"]))
    assert [r.words for r in match_rows(red, [listed]).collect()] == [["red-j", "car-n"]]


def python_spans(parsed, pattern, letters):
    """Spans of a regex over one letter per token."""
    for s in parsed:
        text = "".join(letters(t) for t in s)
        yield [list(range(*m.span())) for m in re.finditer(pattern, text)]


@pytest.mark.parametrize(
    "pattern, plain_pattern",
    [
        ("T<pos=JJ>T<pos=NN.?>", "JN"),
        ("(T<pos=JJ>)*T<pos=NN.?>", "J*N"),
        ("T<pos=JJ>{2,3}", "J{2,3}"),
        ("(T<pos=JJ>|T<pos=NN.?>)+", "[JN]+"),
        ("^T<pos=NN.?>(?:T<>)?", "^N.?"),
        ("T<pos=NN.?>+?$", "N+?$"),
    ],
)
def test_phrases_like_python(spark, tmp_path, pattern, plain_pattern):
    parsed = sentences(6, 30, 12)
    df = corpus(spark, tmp_path, parsed)
    found = {}
    for r in match_rows(df, [LinearPhrases(pattern)]).collect():
        found.setdefault((r.sent_key.seq), []).append(r.positions)

    def letters(t):
        return "J" if t["pos"] == "JJ" else "N" if t["pos"] in ("NN", "NNS") else "o"

    want = dict(enumerate(python_spans(parsed, plain_pattern, letters)))
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v}


def test_phrases_read_raw_lines(spark, tmp_path):
    path = write(tmp_path, RED_CAR)
    lowered = read_corpus(spark, path, to_lower=True)
    assert match_rows(lowered, [LinearPhrases("T<word=the>")]).count() == 0
    assert match_rows(lowered, [LinearPhrases("T<word=The>")]).count() == 1
    assert match_rows(lowered, [LinearPhrases("T<word=the>", ignore_case=True)]).count() == 1
    listed = LinearPhrases("T<lemma=file(l.txt)>", lists={"l.txt": ["car", "s.ll", "be"]})
    assert [r.words for r in match_rows(lowered, [listed]).orderBy("positions").collect()] == [["car-n"], ["be-v"]]


def test_phrases_skip_odd_lines(spark, tmp_path):
    text = (
        "<s>\na\ta\tNN\t1\t0\tX\textra\nb|c\tb\tNN\t2\t0\tX\nd\td\tNN\t3\t0\tX\n</s>\n"
        "<s>\nb|c\tb\tNN\t1\t0\tX\ne\te\tNN\t2\t0\tX\n</s>\n"
    )
    df = read_corpus(spark, write(tmp_path, text))
    rows = match_rows(df, [LinearPhrases("T<pos=NN>")]).orderBy("sent_key").collect()
    assert [r.words for r in rows] == [["d-n"], ["e-n"]]


@pytest.mark.parametrize(
    "pattern", ["", "T<pos=JJ>*", "xT<pos=JJ>", "T<pos=JJ> T<pos=NN>", "T<pos=(>", "(T<>", "T<word=file(x)>"]
)
def test_rejected_patterns(pattern):
    with pytest.raises(ValueError):
        LinearPhrases(pattern)


def test_phrases_of_any_number_of_tokens(spark, tmp_path):
    red = read_corpus(spark, write(tmp_path, RED_CAR))
    pairs = extract_pairs(red, [LinearPhrases("T<>{3}"), LinearPhrases("T<pos=JJ>")], BagOfWords(1)).collect()
    assert {(p.target, p.context, p.marker) for p in pairs} == {
        ("the-d<-->red-j<-->car-n", "have-v", "r"),
        ("have-v<-->be-v<-->sell-v", "car-n", "l"),
        ("red-j", "the-d", "l"),
        ("red-j", "car-n", "r"),
    }
    parsed = sentences(12, 25, 12)
    df = corpus(spark, tmp_path, parsed)
    phrase = "(T<pos=JJ>|T<pos=NN.?>)+T<>"

    def runs(s):
        text = "".join("x" if t["pos"] in ("JJ", "NN", "NNS") else "o" for t in s)
        return [tuple(range(*m.span())) for m in re.finditer("x+.", text)]

    for w in (None, 2):
        got = counted(cooccurrence_counts(df, window=w, unigrams=False, compositions=[LinearPhrases(phrase)]))
        assert got == plain.count(parsed, [runs], w)


def test_texts_that_are_missing(spark, tmp_path):
    """Tokens without the field of a template form no pairs, and are told."""
    text = "<s>\na\ta\tNN\t1\t0\tX\nb\tb\tNN\t2\t1\nc\tc\tNN\t3\nd\td\tNN\t4\t1\tY\n</s>\n"
    df = read_corpus(spark, write(tmp_path, text))
    formats = dict(target_format="{dep_rel}", context_format="{dep_rel}")
    want = {("X", "Y"): 1, ("Y", "X"): 1}
    assert counted(cooccurrence_counts(df, window=9, **formats)) == want
    assert counted(cooccurrence_counts(df, **formats)) == want
    assert counted(count_pairs(extract_pairs(df, [Unigrams()], BagOfWords(9), halves=True, **formats))) == want
    mixed = dict(target_format="{dep_rel}", context_format="{lemma}")
    got = counted(cooccurrence_counts(df, **mixed))
    assert {p for p, _ in got} == {"X", "Y"} and sum(got.values()) == 6
    assert counted(cooccurrence_counts(df, window=9, **mixed)) == got
    arc = DependencyArcs(dependent=TokenTest(word="b"))
    assert cooccurrence_counts(df, window=9, unigrams=False, compositions=[arc], **formats).count() == 0
    assert [r.positions for r in tokens_without_text(df, "{dep_rel}").collect()] == [[1, 2]]
    assert tokens_without_text(df).count() == 0


@pytest.mark.parametrize(
    "pattern, plain_pattern",
    [
        ("(T<pos=JJ>|T<pos=RB>)*T<pos=NN>", "[JR]*N"),
        ("(T<pos=JJ>T<pos=RB>)*T<pos=NN>", "(JR)*N"),
        ("(?:(T<pos=JJ>)|(?:T<pos=RB>|T<pos=NN>))+", "[JRN]+"),
        ("(T<pos=JJ>+T<pos=RB>?){2,}", "(J+R?){2,}"),
    ],
)
def test_phrases_on_very_long_sentences(spark, pattern, plain_pattern):
    """50,000 tokens in one sentence, also for patterns that repeat groups."""
    rng = random.Random(13)
    letters = "".join(rng.choice("JJJJJJRN" if i % 20_000 else "o") for i in range(50_000))
    letters = "J" * 20_000 + "JR" * 5_000 + "N" + letters[:20_000]
    tags = {"J": "JJ", "R": "RB", "N": "NN", "o": "XX"}
    one = spark.range(1).select(
        F.lit("w").alias("sent_key"),
        F.split(F.lit(" ".join(tags[c] for c in letters)), " ").alias("tok_pos"),
    )
    fields = {f"tok_{f}": F.transform("tok_pos", lambda _, i: (i + 1).cast("string")) for f in ("id", "dep_id")}
    fields |= {f"tok_{f}": F.transform("tok_pos", lambda _: F.lit("w")) for f in ("word", "lemma", "dep_rel")}
    fields |= {"tok_line": F.lit(None).cast("array<string>"), "tok_n_fields": F.lit(None).cast("array<int>")}
    found = match_rows(one.withColumns(fields), [LinearPhrases(pattern)])
    got = sorted((r[0], r[1] + 1) for r in found.select(F.array_min("positions"), F.array_max("positions")).collect())
    assert got == [m.span() for m in re.finditer(plain_pattern, letters)]


def test_many_predicates(spark, tmp_path):
    parsed = sentences(14, 30, 12)
    df = corpus(spark, tmp_path, parsed)
    tags = ["NN", "NNS", "JJ", "VVZ", "VVG", "VVD", "MD", "IN", "RB", "DT", "N"]
    pattern = "(" + "|".join(f"T<pos={t},word={w}>" for t in tags for w in ("c.*", "[rR]ed")) + ")T<pos=JJ>*T<>"
    found = {}
    for r in match_rows(df, [LinearPhrases(pattern)]).collect():
        found.setdefault(r.sent_key.seq, []).append(r.positions)

    def letters(t):
        return "x" if t["word"].lower() == "red" or t["word"].startswith("c") else "J" if t["pos"] == "JJ" else "o"

    want = {}
    for k, s in enumerate(parsed):
        text = [(letters(t), t["pos"] == "JJ") for t in s]
        spans, i = [], 0
        while i < len(text):
            if text[i][0] == "x":
                j = i + 1
                while j < len(text) and text[j][1]:
                    j += 1
                end = j + 1 if j < len(text) else j if j > i + 1 else None
                if end is not None:
                    spans.append(list(range(i, end)))
                    i = end
                    continue
            i += 1
        if spans:
            want[k] = spans
    assert {k: sorted(v) for k, v in found.items()} == want


def test_list_rules(spark, tmp_path):
    red = read_corpus(spark, write(tmp_path, RED_CAR))
    arc = [Unigrams(), DependencyArcs(relation="NMOD")]
    everything = extract_pairs(red, arc).count()
    assert extract_pairs(red, arc, contexts=[]).count() == everything
    none = extract_pairs(red, arc, targets=[])
    assert {r.target for r in none.collect()} == {"the-d<-->car-n", "red-j<-->car-n"}
    assert extract_pairs(red, arc, targets=[], first=["the-d"], second=["red-j"]).count() == 0
    assert count_pairs(extract_pairs(red, arc), rows=[], cols=[]).count() == everything
    rows = count_pairs(extract_pairs(red, arc), rows=["car-n"])
    assert {r.pivot for r in rows.collect()} == {"car-n", "the-d<-->car-n", "red-j<-->car-n"}


def listed_in_plain(parsed, lists, w):
    """Counts of words and N arcs with all four lists, by plain Python."""
    total = Counter()
    for s in parsed:
        for m in {*plain.unigrams(s), *plain.arcs(s, "N")}:
            words = [s[i]["lemma"] for i in m]
            if len(m) == 1 and words[0] not in lists["targets"]:
                continue
            if len(m) == 2 and (words[0] not in lists["first"] or words[1] not in lists["second"]):
                continue
            for p, _ in plain.contexts(len(s), m, w):
                if s[p]["lemma"] in lists["contexts"]:
                    total["<-->".join(words), s[p]["lemma"]] += 1
    return total


@pytest.mark.parametrize("as_table", [False, True])
def test_lists_like_plain(spark, tmp_path, as_table):
    parsed = sentences(8, 20, 12)
    df = corpus(spark, tmp_path, parsed)
    arc = DependencyArcs(relation="N")
    plain_lists = dict(
        targets=["car", "red"], first=["red", "the", "be", "car"], second=["car", "red", "sell"], contexts=["the", "car", "be"]
    )
    table = lambda ws: spark.createDataFrame([(w,) for w in [*ws, ws[0], None]], "word string") if as_table else ws
    lists = {k: table(v) for k, v in plain_lists.items()}
    lemmas = dict(target_format="{lemma}", context_format="{lemma}")
    want = listed_in_plain(parsed, plain_lists, 3)
    assert {"<-->" in pivot for pivot, _ in want} == {True, False}
    assert counted(count_pairs(extract_pairs(df, [Unigrams(), arc], BagOfWords(3), **lists, **lemmas))) == want
    assert counted(cooccurrence_counts(df, window=3, compositions=[arc], **lists, **lemmas)) == want
    keyed = cooccurrence_counts(df, window=3, compositions=[arc], rows=table(["car"]), cols=table(["the"]), **lists, **lemmas)
    assert counted(keyed) == {k: n for k, n in want.items() if k[0].split("<-->")[-1] == "car" and k[1] == "the"}
    whole = dict(targets=lists["targets"], contexts=lists["contexts"], **lemmas)
    single = {k: n for k, n in listed_in_plain(parsed, plain_lists, None).items() if "<-->" not in k[0]}
    assert counted(whole_sentence_counts(df, **whole)) == single
    empty = spark.createDataFrame([], "word string") if as_table else []
    everything = counted(cooccurrence_counts(df, window=3, **lemmas))
    assert counted(cooccurrence_counts(df, window=3, contexts=empty, rows=empty, **lemmas)) == everything
    assert cooccurrence_counts(df, window=3, targets=empty, **lemmas).count() == 0
    assert cooccurrence_counts(df, targets=empty, **lemmas).count() == 0


def test_flagged_list(spark, tmp_path):
    parsed = sentences(9, 15, 10)
    df = corpus(spark, tmp_path, parsed)
    words = ["car", "red", "be"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    flagged = flag_words(df, table, "known", ["sent_key"], "{lemma}")
    joined = match_rows(flagged, [DependencyArcs(head=TokenTest(flag_column="known"))]).drop("known")
    inline = match_rows(df, [DependencyArcs(head=TokenTest(words=words, words_format="{lemma}"))])
    assert joined.exceptAll(inline).isEmpty() and inline.exceptAll(joined).isEmpty()
    assert not inline.isEmpty()


def test_flagged_phrase_list(spark, tmp_path):
    for text in (RED_CAR, RED_CAR.replace("NMOD", "NMOD\tseven", 1)):
        df = read_corpus(spark, write(tmp_path, text), to_lower=True)
        table = spark.createDataFrame([("The",), ("car",), ("red",)], "word string")
        flagged = flag_words(df, table, "known", ["sent_key"], texts=raw_field(TOKENS, "word"))
        joined = LinearPhrases("T<word=file(l)>+", lists={"l": Flagged("known")})
        inline = LinearPhrases("T<word=file(l)>+", lists={"l": ["The", "car", "red"]})
        found = [r.positions for r in match_rows(flagged, [joined]).collect()]
        assert found == [r.positions for r in match_rows(df, [inline]).collect()]
        assert found == ([[0, 1, 2]] if text == RED_CAR else [[1, 2]])


@pytest.mark.parametrize("most", [1 << 20, 20, -1])
def test_flags_of_short_and_long_lists(spark, tmp_path, monkeypatch, most):
    """A short list is looked up in the tasks, without a shuffle or a table of sentences; both ways give the same flags."""
    monkeypatch.setattr(filters, "TAKEN_BYTES", most)
    texts = [(0, ["Été", "car", None, "car", "b\tc"]), (1, []), (2, None), (3, [None]), (4, ["red"] * 300 + ["x"])]
    rows = spark.createDataFrame(texts, "k int, tok_lemma array<string>").repartition(3)
    words = spark.createDataFrame([("car",), ("red",), ("red",), (None,), ("Été",), ("b\tc",), ("nowhere" * 9,)], "word string")
    flagged = flag_words(rows, words, "known", ["k"], texts=F.col("tok_lemma"))
    want = {k: None if ts is None else [t in ("car", "red", "Été", "b\tc") for t in ts] for k, ts in texts}
    assert {r.k: r.known for r in flagged.collect()} == want
    assert {r.k: r.known for r in flag_words(rows, words.limit(0), "known", ["k"], texts=F.col("tok_lemma")).collect()} == {
        k: None if ts is None else [False] * len(ts) for k, ts in texts
    }
    # words of one hash are told apart
    array, same = pa.array([["a", "b", None], None, ["c"]]), pa.array(["b", "a"])
    monkeypatch.setattr(filters, "text_hashes", lambda ts: np.full(len(ts), 7, np.uint64))
    assert filters.in_list(array, filters.text_hashes(same), same).to_pylist() == [[True, True, False], None, [False]]
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (most < 0)


def test_only_content(spark, tmp_path):
    red = read_corpus(spark, write(tmp_path, RED_CAR))
    assert only_content(red).collect()[0].tok_lemma == ["red", "car", "have", "be", "sell"]


def test_only_content_makes_no_field_that_is_not_asked_for(spark):
    texts = spark.createDataFrame([(1, "The red stone was sold quickly. A dark house")], "doc_id bigint, text string")
    sentences = annotated_sentences(texts, ["doc_id"])
    content = only_content(sentences)
    plan = lambda c: content.select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "ROOT" in plan("tok_dep_rel") and "ROOT" not in plan("tok_lemma")
    for row, whole in zip(content.collect(), sentences.collect(), strict=True):
        at = [i for i, p in enumerate(whole.tok_pos) if p[0] in "NJVR"]
        for c in ("tok_word", "tok_lemma", "tok_pos", "tok_id", "tok_dep_id", "tok_dep_rel"):
            assert row[c] == [whole[c][i] for i in at]
        assert row.tok_line is None and row.tok_n_fields is None


def test_grep(spark, tmp_path):
    red = read_corpus(spark, write(tmp_path, RED_CAR + RED_CAR.replace("red", "big").replace("JJ", "DT")))
    repeated = grep(red, [LinearPhrases("(T<pos=JJ>T<>)+"), DependencyArcs(relation="SBJ")], intersect=True)
    assert [r.matched for r in repeated.collect()] == [[1, 2, 3]]
    phrase, arc = LinearPhrases("T<pos=JJ>T<>"), DependencyArcs(relation="VC")
    assert [r.tok_is_match for r in grep(red, [phrase]).collect()] == [
        [False, True, True, False, False, False]
    ]
    both = grep(red, [phrase, arc]).orderBy("sent_key").collect()
    assert [r.matched for r in both] == [[1, 2, 3, 4, 5], [3, 4, 5]]
    assert grep(red, [phrase, arc], intersect=True).count() == 0
    subject = DependencyArcs(relation="(SBJ|VC)")
    kept = grep(red, [phrase, subject], intersect=True)
    assert [r.matched for r in kept.collect()] == [[1, 2, 3, 4, 5]]
    printed = kept.select(sentence_text(kept, only_fields=True, markup=False)).collect()[0][0]
    assert printed == "<s>\n" + "\n".join(RED_CAR.split("\n")[2:8]) + "\n</s>"
    with pytest.raises(ValueError):
        grep(red, [])


def test_composition_options():
    assert composition_matchers() == []
    assert [type(m) for m in composition_matchers("T<>", relation="X")] == [LinearPhrases, DependencyArcs]
    assert [type(m) for m in composition_matchers(head=TokenTest(words=[]))] == [DependencyArcs]


def test_own_matcher(spark, tmp_path):
    class Neighbours:
        def matches(self, tokens):
            pairs = F.transform(tokens["id"], lambda _, i: F.array(i, i + 1))
            return F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0)))

    assert isinstance(Neighbours(), Matcher)
    parsed = sentences(10, 8, 8)
    got = counted(count_pairs(extract_pairs(corpus(spark, tmp_path, parsed), [Neighbours()], BagOfWords(2))))
    assert got == plain.count(parsed, [lambda s: [(i, i + 1) for i in range(len(s) - 1)]], 2)


def test_templates(spark, tmp_path):
    from arcwindow.functions.tokens import format_tokens

    red = read_corpus(spark, write(tmp_path, RED_CAR))
    for template, third in (
        ("{lemma}", "car"),
        ("{cat}:{sentence_pos}", "n:2"),
        ("<{word}>", "<car>"),
        ("{word}/{pos}/{dep_rel}!", "car/NN/SBJ!"),
        ("{pos}{cat}", "NNn"),
        ("x", "x"),
    ):
        assert red.select(format_tokens(TOKENS, template)).first()[0][2] == third
    for template in ("{lemma:>3}", "{nothing}", "{0}", "{lemma!r}"):
        with pytest.raises(ValueError):
            format_tokens(TOKENS, template)


def test_window_markers_on_random_arcs(spark, tmp_path):
    rng = random.Random(11)
    parsed = sentences(rng.randint(0, 99), 20, 20, wild=True)
    df = corpus(spark, tmp_path, parsed)
    for w in (1, 3, None):
        got = Counter(
            (r.sent_key.seq, tuple(r.t_positions), r.c_position, r.marker)
            for r in extract_pairs(df, [DependencyArcs(relation="N")], BagOfWords(w)).collect()
        )
        want = Counter(
            (k, m, p, marker)
            for k, s in enumerate(parsed)
            for m in plain.arcs(s, "N")
            for p, marker in plain.contexts(len(s), m, w)
        )
        assert got == want


# -- long chunks ----------------------------------------------------------------------------------


@pytest.mark.parametrize("together", [512, 3])
def test_long_chunks_give_the_same_pairs(spark, tmp_path, monkeypatch, together):
    """Whole texts with repeated ids, and with ids of their own; all matchers, windows and lists."""
    monkeypatch.setattr(windows, "TOGETHER", together)
    texts = "".join(f"{plain.corpus(sentences(i, 6, 8, wild=True))}</text>\n" for i in range(4))
    numbered = "".join(f"w{i}\tl{i % 7}\tNN\t{i}\t{i // 2}\tX\n" for i in range(1, 60)) + "</text>\n</text>\n"
    corpus = read_corpus(spark, write(tmp_path, texts + numbered), separator="text")
    arcs, phrase = DependencyArcs(relation="(NMOD|X)"), LinearPhrases("T<pos=NN>T<>T<pos=NN>")
    cases = [
        ([Unigrams()], BagOfWords(2), dict(halves=True)),
        ([Unigrams(), arcs], BagOfWords(1), dict(halves=True)),
        ([Unigrams(), arcs, phrase], BagOfWords(3), dict(context_format="{pos}")),
        ([arcs, phrase], BagOfWords(2), dict(first=["car-n", "red-j"], contexts=["the-n"])),
        ([arcs], BagOfWords(), {}),
        ([Neighbours()], Ahead(), {}),
    ]
    for matchers, features, options in cases:
        rows = [extract_pairs(corpus, matchers, features, long_chunks=long, **options) for long in (False, True)]
        assert rows[0].columns == rows[1].columns
        short, long = (sorted(map(str, r.collect())) for r in rows)
        assert short == long and (short or "first" in options)


def test_a_long_text_takes_part_in_many_tasks(spark, tmp_path):
    text = "".join(f"w{i % 91}\tl{i % 91}\tNN\t{i}\t0\tX\n" for i in range(1, 60_001)) + "</text>\n"
    corpus = read_corpus(spark, write(tmp_path, text), separator="text")
    pairs = extract_pairs(corpus, [Unigrams()], BagOfWords(2), long_chunks=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = pairs.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) == 8 and sum(r["count"] for r in tasks) == 4 * 60_000 - 6


def test_tags_of_lowered_corpora(spark, tmp_path):
    """Lines of six fields are not split again for tests of tags; seven fields and bars still end a phrase."""
    lines = [["Red", "Red", "JJ"], ["Car", "Car", "NN"]]
    text = ""
    for last in ("NMOD", "NMOD\tX", "N|MOD"):
        text += "<s>\n" + "".join("\t".join([*f, str(i + 1), "0", last]) + "\n" for i, f in enumerate(lines)) + "</s>\n"
    lowered = read_corpus(spark, write(tmp_path, text), to_lower=True)
    phrase = LinearPhrases("T<pos=JJ>T<pos=NN>")
    found = lowered.orderBy("sent_key").select(phrase.matches(TOKENS).alias("m"))
    assert [r.m for r in found.collect()] == [[[0, 1]], [], []]
    other = lowered.where("tok_n_fields IS NULL").withColumn("tok_line", F.transform("tok_line", lambda _: F.lit("unsplit")))
    assert other.select(phrase.matches(TOKENS).alias("m")).first().m == [[0, 1]]
    cased = LinearPhrases("T<word=Red>T<pos=NN>")
    assert [r.m for r in lowered.orderBy("sent_key").select(cased.matches(TOKENS).alias("m")).collect()] == [[[0, 1]], [], []]
