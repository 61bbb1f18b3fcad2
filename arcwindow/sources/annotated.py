"""Plain-text tables as corpora.

Tables of prose carry no dependency parse. This adapter gives every word a tag, a head
and a relation by a fixed rule (arbitrary as linguistics, but deterministic), so that
all operators can run over such tables. A sentence ends where its text says so: at a line
end, or at a full stop, exclamation or question mark before a space. Nothing is left out,
however long a sentence is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What ends a sentence inside a line, and what words are made of.
SENTENCE_END = "([.!?]) "
NO_LETTER = r"[^\p{L} ]"

# The rule, over a lemma l at index i of a sentence of n words (SQL, for Spark).
TAG = """CASE WHEN l LIKE '%ing' THEN 'VVG' WHEN l LIKE '%ed' OR l LIKE '%en' THEN 'VVD'
  WHEN l LIKE '%ly' THEN 'RB' WHEN l LIKE '%ble' THEN 'JJ' WHEN l LIKE '%tion' THEN 'NN'
  WHEN length(l) <= 3 THEN 'IN' WHEN length(l) % 5 = 0 THEN 'JJ' WHEN length(l) % 5 = 1 THEN 'NNS'
  WHEN length(l) % 5 = 2 THEN 'VVZ' ELSE 'NN' END"""
HEAD = """CASE WHEN i = 0 THEN 0 WHEN ((i + 1) * 7 + length(l)) % n = i THEN i
  ELSE ((i + 1) * 7 + length(l)) % n + 1 END"""
RELATION = """CASE WHEN p = 'JJ' THEN 'NMOD' WHEN p LIKE 'N%' AND length(l) % 2 = 0 THEN 'SBJ'
  WHEN p LIKE 'N%' THEN 'OBJ' WHEN p = 'RB' THEN 'ADV' WHEN p LIKE 'V%' AND length(l) % 3 = 0 THEN 'VC'
  ELSE 'DEP' END"""


def rule(lemmas: str, tags: str | None = None) -> dict[str, str]:
    """SQL for the annotations of a sentence, given SQL for its lemmas, and for its tags where they are made already."""
    made = f"transform({lemmas}, l -> {TAG})"
    tags = tags or made
    head = HEAD.replace(" n ", f" size({lemmas}) ")
    return {
        "pos": made,
        "id": f"transform({lemmas}, (l, i) -> string(i + 1))",
        "dep_id": f"transform({lemmas}, (l, i) -> string({head}))",
        # the first word is the only root
        "dep_rel": f"transform(zip_with({lemmas}, {tags}, (l, p) -> {RELATION}), (r, i) -> IF(i = 0, 'ROOT', r))",
    }


def annotate(sentences: DataFrame) -> DataFrame:
    """Add tags, heads and relations to ``tok_word`` and ``tok_lemma``."""
    sql = rule("tok_lemma", "tok_pos")
    # relations are made of tags, which are made once for both
    tagged = sentences.withColumns({f"tok_{name}": F.expr(sql[name]) for name in ("pos", "id", "dep_id")})
    return tagged.withColumns(
        {
            "tok_dep_rel": F.expr(sql["dep_rel"]),
            "tok_line": F.expr("CAST(NULL AS ARRAY<STRING>)"),
            "tok_n_fields": F.expr("CAST(NULL AS ARRAY<INT>)"),
        }
    )


def lines_of(text: Column) -> Column:
    """The sentences of a text, as its letters and spaces."""
    lines = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n", -1)
    return F.transform(lines, lambda line: F.regexp_replace(line, NO_LETTER, ""))


def words_of(letters: Column) -> Column:
    return F.filter(F.split(letters, " ", -1), lambda w: w != "")


def annotated_sentences(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, sent_idx`` and token arrays for every sentence of every text; no shuffle."""
    lines = texts.select(*keys, F.posexplode_outer(lines_of(F.col(text))).alias("sent_idx", "_letters"))
    # a sentence without words is none
    worded = lines.where(F.trim("_letters") != "").select(
        *keys,
        F.col("sent_idx").cast("bigint").alias("sent_idx"),
        words_of(F.col("_letters")).alias("tok_word"),
        words_of(F.lower("_letters")).alias("tok_lemma"),
    )
    return annotate(worded)


def annotated_texts(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and token arrays with a whole text as one chunk: ids start again per sentence.

    The arrays are built inside the row of the text, so nothing is shuffled.
    """

    lines = F.filter(lines_of(F.col(text)), lambda letters: F.trim(letters) != "")
    sentences = texts.select(
        *keys,
        F.transform(lines, words_of).alias("_words"),
        F.transform(lines, lambda letters: words_of(F.lower(letters))).alias("_lemmas"),
    )
    sql = rule("ls")
    # an array for each field, so those that nobody asks for are not made
    return sentences.select(
        *keys,
        F.flatten("_words").alias("tok_word"),
        F.flatten("_lemmas").alias("tok_lemma"),
        *[F.expr(f"flatten(transform(_lemmas, ls -> {sql[name]}))").alias(f"tok_{name}") for name in ("pos", "id", "dep_id", "dep_rel")],
        F.expr("CAST(NULL AS ARRAY<STRING>)").alias("tok_line"),
        F.expr("CAST(NULL AS ARRAY<INT>)").alias("tok_n_fields"),
    )


def sentence_count(text: str = "text") -> Column:
    """Number of sentences ``annotated_sentences`` makes of a text."""
    return F.size(F.filter(lines_of(F.col(text)), lambda letters: F.trim(letters) != "")).cast("bigint")


#: Session setting: number of partitions in which the given tables are read. A table that lies in
#: one block is one task without it; tables of many blocks need no such setting.
INPUT_PARTITIONS = "spark.arcwindow.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    n = spark.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(n), *columns[:-1]) if n else rows


def table_partitions(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The number of partitions in which :func:`table` reads."""
    return int(spark.conf.get(INPUT_PARTITIONS, None) or spark.read.parquet(f"{sf_dir}/{name}.parquet").rdd.getNumPartitions())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated sentences of the ``documents`` table, every language and every line."""
    return annotated_sentences(documents(spark, sf_dir), ["doc_id"])


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a whole document as one chunk."""
    return annotated_texts(documents(spark, sf_dir), ["doc_id"])


def conversation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated sentences of the ``conversations`` table."""
    return annotated_sentences(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), ["conv_id", "turn"])


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lowered words of the ``benchmark`` table, as a word list."""
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    words = texts.select(F.explode(F.split("text", r"[ \n]", -1)).alias("w"))
    cleaned = words.select(F.lower(F.regexp_replace("w", r"[^\p{L}]", "")).alias("word"))
    return cleaned.where("word <> ''").distinct()
