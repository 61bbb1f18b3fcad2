"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from arcwindow.llm.shards import PRIME, ROUNDS, SEED, SHARDS, round_keys

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOWERED = f"translate(coalesce(text, ''), {UPPER}, lower({UPPER}))"
SPACED = r"'[^\x20\x09-\x0D]+'"
LETTERED = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _components(ids: str, links: str) -> str:
    """``id, component`` of a table of ids and one of links ``a, b``."""
    return f"""
both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
parts AS (SELECT id, least(id, coalesce(min(b), id)) AS component FROM {ids} LEFT JOIN reach ON a = id GROUP BY id)"""


def _mixed(digit: str) -> str:
    """The round function of the permutation in round ``i``."""
    x = f"(({digit} + key_1[i + 1]) % {PRIME})"
    x = f"(({x} * {x} + key_2[i + 1]) % {PRIME})"
    return f"{x} * {x} % {PRIME}"


def _permuted(number: str) -> str:
    """All rounds; ``a``, ``b`` are the radices."""
    return f"""list_reduce([{number}] || range({ROUNDS}), lambda x, i: CASE WHEN i % 2 = 0
    THEN (x // b + {_mixed("(x % b)")}) % a * b + x % b ELSE x // b * b + (x % b + {_mixed("(x // b)")}) % b END)"""


ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT doc_id, b, octet_length(b) AS n FROM docs),
starts AS (SELECT doc_id, unnest(range(n - 99)) AS p,
    unnest(list_transform(range(n - 99), lambda i: md5_number(b[i + 1:i + 100]))) AS h FROM sized WHERE n >= 100),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM starts) WHERE k > 1),
broken AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens
  FROM again),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM broken),
spans AS (SELECT doc_id, span, min(p) AS s, max(p) + 100 AS e FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER w, 0) AS s, s AS e FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT d.doc_id, coalesce(max(x.e), 0), any_value(d.n) FROM sized d LEFT JOIN spans x USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN g.e > g.s THEN hex(b[g.s + 1:g.e]) ELSE '' END, '' ORDER BY g.s, g.e) AS h
  FROM gaps g JOIN sized USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(h)) AS kept_sha256
FROM sized JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)""",
    "op4_embedding_duplicates": """
WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM vectors WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id < y.vec_id
    AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)) >= 0.93),
ids AS (SELECT vec_id AS id FROM embeddings),"""
    + _components("ids", "links")
    + """,
counts AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, id = component AS kept
FROM parts LEFT JOIN counts USING (id)""",
    "op5_decontamination": f"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, {LETTERED}) AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS width
  FROM (SELECT item_id, regexp_extract_all({LOWERED}, {LETTERED}) AS w FROM benchmark) WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, width, array_to_string(w[p:p + width - 1], ' ') AS words
  FROM (SELECT item_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM items)),
widths AS (SELECT DISTINCT width FROM items),
windows AS (SELECT doc_id, width, p, array_to_string(w[p:p + width - 1], ' ') AS words
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM docs, widths)),
hits AS (SELECT doc_id, p, width, item_id FROM windows JOIN known USING (width, words)),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + width)) AS place FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(x.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(x.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words x USING (doc_id) LEFT JOIN hit_items i USING (doc_id)""",
    "op7_jaccard_join": f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, {SPACED}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, least(4, len(w)) AS width, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
in_common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM in_common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
ids AS (SELECT doc_id AS id FROM documents),"""
    + _components("ids", "links")
    + """
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id
FROM parts LEFT JOIN sizes ON doc_id = id""",
    "op11_hard_negatives": """
WITH vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id,
  positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3""",
    "op12_feistel_sharding": f"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda v: list_reduce([v] || range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS bits_of),
docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) - 1 AS number FROM documents),
summed AS (SELECT doc_id, number, strlen(t) + 8 AS size, xor(list_reduce(
    [4294967295] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS BIGINT)),
    lambda c, y: xor(c >> 8, bits_of[(xor(c, y) & 255) + 1])), 4294967295) AS crc FROM docs, bits),
counted AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents),
radix AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b, {[k for k, _ in round_keys(SEED)]} AS key_1,
    {[k for _, k in round_keys(SEED)]} AS key_2 FROM counted),
walk AS (SELECT number, {_permuted("number")} AS p FROM docs, radix
  UNION ALL SELECT number, {_permuted("p")} FROM walk, radix WHERE p >= n)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p % {SHARDS} AS INTEGER) AS shard, p // {SHARDS} AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM walk JOIN radix ON p < n JOIN summed USING (number)""",
}
