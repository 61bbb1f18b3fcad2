"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is ``r`` times its words asks for ``r`` copies of each of its documents. The
whole part of ``r`` is given; the fraction is rounded pair by pair. Of two open documents either
the first gives words to the second or the second to the first, until one of them has a whole
number of copies; which way is drawn so that every document keeps its expectation, and the words
of the pair stay the same. The open rest of a block of documents meets the rests of other blocks,
level by level, until one document per source is left, which is drawn.

Of a pair mostly the shorter document becomes whole, so what is left is long. Therefore documents are rounded in
classes of sizes (powers of eight), longest first. What a class took too much or too little is made good by the
fractions of all shorter documents, which are rounded after it. The last class of a source draws no more: its last
document goes to the nearer side. So a source's words miss their target by at most half of one of its short
documents, and every document keeps its expectation where no fraction has to be held to 0 or 1.

Everything is a column expression. Blocks hold about ``FAN_IN`` documents by a hash of the row,
so no source, however large, meets in one task; levels grow with the logarithm of the rows.
Draws are hashes of the documents, so reruns agree.

Defined results: null and empty texts have size 0 and nothing taken; a null source is a source,
ordered last; a source of empty texts has target 0; an empty table gives an empty result; repeated
rows are documents of their own. Columns other than ``doc_id, text, source`` are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from arcwindow.operators.order import row_numbers, running_totals
from arcwindow.plans.scratch import cut_lineage

#: Documents, or rests, that one block rounds.
FAN_IN = 64
#: Sizes of a class are within this power of two.
CLASS_BITS = 3
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"

OPEN = "struct<size:bigint,key:bigint,doc_id:{id},p:double>"
DONE = "array<struct<doc_id:{id},key:bigint,size:bigint,up:int>>"


def sized(documents: DataFrame, word: str = WORD) -> DataFrame:
    """``doc_id, source, size, key``; the key is the row's hash."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(word)).cast("bigint").alias("size"),
        F.xxhash64("doc_id", "text").alias("key"),
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, n_docs, target``: weighted shares of all words, none above ``most`` times its source.

    What a source cannot take is shared out again by weight among the others until none is above.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ordered = running_totals(
        sums, [F.col("source").isNull(), F.col("source")], {"_place": F.lit(1).cast("bigint")}
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    table = cut_lineage(
        ordered.select("source", "source_size", "n_docs", weight.alias("_w"), (F.col("source_size") * most).alias("_top"))
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:  # each round fills at least one more source
        capped = F.col("_top") <= F.col("_w") * F.lit(share)
        n, taken, left = table.agg(
            F.count_if(capped),
            F.sum(F.when(capped, F.col("_top"))),
            F.sum(F.when(~capped, F.col("_w"))),
        ).first()
        if not left or n == full:
            break
        full, share = n, (total - (taken or 0)) / left
    target = F.least(F.col("_top").cast("double"), F.col("_w") * F.lit(float(share)))
    return table.select("source", "source_size", "n_docs", target.alias("target"))


def drawn(seed: int, *keys: Column) -> Column:
    """A number from 0 to below 1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def rounded(seed: int, id_type: str) -> Column:
    """Rounds the open documents of ``docs`` pair by pair: ``open`` is left, ``done`` is decided."""
    nobody = F.lit(None).cast(OPEN.format(id=id_type))
    start = F.struct(nobody.alias("open"), F.array().cast(DONE.format(id=id_type)).alias("done"))

    def decided(d: Column, up: Column) -> Column:
        return F.array(F.struct(d["doc_id"].alias("doc_id"), d["key"].alias("key"), d["size"].alias("size"), up.cast("int").alias("up")))

    def still(d: Column, p: Column) -> Column:
        return F.struct(d["size"].alias("size"), d["key"].alias("key"), d["doc_id"].alias("doc_id"), p.alias("p"))

    def pair(state: Column, b: Column) -> Column:
        a, done = state["open"], state["done"]
        a_has, b_has = a["size"] * a["p"], b["size"] * b["p"]
        a_room, b_room = a["size"] * (1 - a["p"]), b["size"] * (1 - b["p"])
        to_a, to_b = F.least(a_room, b_has), F.least(a_has, b_room)
        up_a = drawn(seed, a["key"], b["key"]) * (to_a + to_b) < to_b

        def step(open_: Column, closed: Column, up: int) -> Column:
            return F.struct(open_.alias("open"), F.concat(done, decided(closed, F.lit(up))).alias("done"))

        return (
            F.when(a.isNull(), F.struct(still(b, b["p"]).alias("open"), done.alias("done")))
            .when(up_a & (a_room <= b_has), step(still(b, b["p"] - a_room / b["size"]), a, 1))
            .when(up_a, step(still(a, a["p"] + b_has / a["size"]), b, 0))
            .when(a_has <= b_room, step(still(b, b["p"] + a_has / b["size"]), a, 0))
            .otherwise(step(still(a, a["p"] - b_room / a["size"]), b, 1))
        )

    return F.aggregate(F.sort_array("docs", asc=False), start, pair)


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    word: str = WORD,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, key, size, source_size, target, copies``, a row per document; ``key`` hashes id and text."""
    rows = cut_lineage(sized(documents, word))
    targets = cut_lineage(source_targets(rows, weights, most).withColumn("_s", F.xxhash64("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = targets.select(
        "_s", "source", "source_size", "target", F.floor(rate).alias("_whole"), (F.col("target") - F.floor(rate) * F.col("source_size")).alias("_rest")
    )
    asked = rows.join(per_source, rows["source"].eqNullSafe(per_source["source"])).select(
        "doc_id", "key", "size", "_s", "source_size", "target", "_whole", "_rest", F.floor(F.log2(F.col("size").cast("double")) / CLASS_BITS).alias("_class")
    )
    asked = cut_lineage(asked)
    open_ = asked.where("size > 0 AND _rest > 0")
    sums = cut_lineage(class_sums(open_))
    # what is given is carried on as one small table, so that plans do not grow from class to class
    so_far = per_source.select("_s", "_rest", F.lit(0).cast("bigint").alias("given"))
    decided: list[DataFrame] = []
    # a size has 63 bits, so there are few classes
    for one, most_docs in sums.groupBy("_class").agg(F.max("n_docs")).orderBy(F.desc("_class")).collect():
        if decided:
            so_far = cut_lineage(with_given(so_far, decided[-1]))
        shares = cut_lineage(class_shares(so_far, sums, one))
        members = open_.where(F.col("_class") == one).join(shares, "_s")
        decided.append(cut_lineage(rounded_class(members, most_docs, seed)))
    columns = ["doc_id", "key", "size", "source_size", "target"]
    fixed = asked.where("size = 0 OR _rest <= 0").select(*columns, F.col("_whole").cast("int").alias("copies"))
    up = functools.reduce(DataFrame.unionByName, decided).join(per_source, "_s") if decided else None
    if up is None:
        return fixed
    return fixed.unionByName(up.select(*columns, (F.col("_whole") + F.col("up")).cast("int").alias("copies")))


def class_sums(open_: DataFrame) -> DataFrame:
    """``_s, _class, n_docs, words, least``: documents of a class, words of it and all shorter ones, the source's shortest class."""
    sums = open_.groupBy("_s", "_class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n_docs"))
    upto = Window.partitionBy("_s").orderBy("_class").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("_s", "_class", "n_docs", F.sum("words").over(upto).alias("words"), F.min("_class").over(upto).alias("least"))


def with_given(so_far: DataFrame, decided: DataFrame) -> DataFrame:
    """``_s, _rest, given`` with the words that one more class was given."""
    more = decided.groupBy("_s").agg(F.sum(F.col("size") * F.col("up")).alias("more"))
    return so_far.join(more, "_s", "left").select("_s", "_rest", (F.col("given") + F.coalesce("more", F.lit(0))).alias("given"))


def class_shares(so_far: DataFrame, sums: DataFrame, one: int) -> DataFrame:
    """``_s, n_docs, p, nearest`` of a class: the fraction that meets what is still open, and whether it is the source's last."""
    table = so_far.join(sums.where(F.col("_class") == one), "_s")
    p = (F.col("_rest") - F.col("given")) / F.col("words")
    return table.select("_s", "n_docs", F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)).alias("p"), (F.col("least") == one).alias("nearest"))


def rounded_class(members: DataFrame, most_docs: int, seed: int) -> DataFrame:
    """``_s, doc_id, key, size, up`` of documents ``_s, doc_id, key, size, p, n_docs, nearest``: one more copy or none.

    No ``n_docs`` is above ``most_docs``.
    """
    id_type = dict(members.dtypes)["doc_id"]
    columns = ["_s", "doc_id", "key", "size"]
    whole = members.where("p <= 0 OR p >= 1").select(*columns, (F.col("p") >= 1).cast("int").alias("up"))
    level = (
        members.where("p > 0 AND p < 1")
        .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.ceil(F.col("n_docs") / FAN_IN)))
        .groupBy("_s", "_block")
        .agg(F.collect_list(F.struct("size", "key", "doc_id", "p")).alias("docs"), F.max("n_docs").alias("n_docs"), F.max("nearest").alias("nearest"))
    )
    decided, blocks = whole, -(-most_docs // FAN_IN)
    while True:
        now = cut_lineage(level.select("_s", "_block", "n_docs", "nearest", rounded(seed, id_type).alias("r")).select("_s", "_block", "n_docs", "nearest", "r.*"))
        done = now.select("_s", F.explode("done").alias("d")).select("_s", "d.*")
        decided = decided.unionByName(done)
        if blocks <= 1:
            break
        blocks = -(-blocks // FAN_IN)
        level = (
            now.where("open IS NOT NULL")
            .groupBy("_s", F.floor(F.col("_block") / FAN_IN).alias("_block"))
            .agg(F.collect_list("open").alias("docs"), F.max("n_docs").alias("n_docs"), F.max("nearest").alias("nearest"))
        )
    alone = now.where("open IS NOT NULL").select("_s", "nearest", "open.*")
    up = F.when(F.col("nearest"), F.col("p") >= 0.5).otherwise(drawn(seed, F.lit("last"), F.col("key")) < F.col("p"))
    return decided.unionByName(alone.select(*columns, up.cast("int").alias("up")))


def take_copies(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, empty ones never; ``copy`` counts from 1.

    Rows that repeat id and text share the copies they were given together. A column ``copy`` that is there
    already gives way to the new one.
    """
    given = mixed.groupBy(F.col("doc_id").alias("id"), "key").agg(
        F.sum(F.when(F.col("size") > 0, F.col("copies")).otherwise(0)).alias("given"), F.count(F.lit(1)).alias("n")
    )
    given = cut_lineage(given.where("given > 0").withColumnRenamed("key", "k"))
    names = [c for c in documents.columns if c.lower() != "copy"]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    # names of the struct's own are out of the way of those here
    keyed = rows.withColumn("key", F.xxhash64("row.doc_id", "row.text"))
    joined = keyed.join(given, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
    taken = joined.where("n = 1").select("row", F.col("given").cast("int").alias("copies"))
    if given.where("n > 1").head(1):
        # equal rows are numbered, however many there are
        same = joined.where("n > 1").select("row", "id", "key", "given", "n").withColumn("read", F.monotonically_increasing_id())
        numbered = cut_lineage(row_numbers(same, ["id", "key", "read"], "place"))
        firsts = numbered.groupBy("id", "key").agg(F.min("place").alias("first")).withColumnsRenamed({"id": "i", "key": "k"})
        placed = numbered.join(firsts, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
        more = (F.col("place") - F.col("first") < F.col("given") % F.col("n")).cast("int")
        taken = taken.unionByName(placed.select("row", (F.floor(F.col("given") / F.col("n")) + more).cast("int").alias("copies")))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    taken = taken.where("copies > 0").select("row", copies)
    return taken.select(*[F.col("row").getField(c).alias(c) for c in names], "copy")
