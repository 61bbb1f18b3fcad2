"""The registered queries as SQL over the same tables, in other formulations.

Windows are range self-joins, arcs are joins on ids, phrases are ``lead`` or runs, chains and
cuts are recursive queries.
"""

from __future__ import annotations


def _annotated(source: str, keys: str, name: str) -> str:
    """The rule of ``sources.annotated`` for the table ``source``; ``keys`` name a text."""
    place = f"{keys}, sent_idx"
    return f"""
{name}_sent AS (SELECT {keys}, unnest(range(len(l))) AS sent_idx, unnest(l) AS line
  FROM (SELECT {keys}, string_split(regexp_replace(text, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS l FROM {source})),
{name}_raw AS (SELECT {place}, unnest(range(len(l))) AS k,
    regexp_replace(unnest(l), '[^\\p{{L}}]', '', 'g') AS word
  FROM (SELECT {place}, string_split(line, ' ') AS l FROM {name}_sent)),
{name}_w0 AS (SELECT {place}, word, lower(word) AS lemma,
    row_number() OVER (PARTITION BY {place} ORDER BY k) - 1 AS rn FROM {name}_raw WHERE word <> ''),
{name}_w AS (SELECT {place}, rn + 1 AS id, word, lemma,
    count(*) OVER (PARTITION BY {place}) AS n FROM {name}_w0),
{name}_p AS (SELECT *,
    CASE WHEN lemma LIKE '%ing' THEN 'VVG' WHEN lemma LIKE '%ed' OR lemma LIKE '%en' THEN 'VVD'
      WHEN lemma LIKE '%ly' THEN 'RB' WHEN lemma LIKE '%ble' THEN 'JJ' WHEN lemma LIKE '%tion' THEN 'NN'
      WHEN length(lemma) <= 3 THEN 'IN' WHEN length(lemma) % 5 = 0 THEN 'JJ'
      WHEN length(lemma) % 5 = 1 THEN 'NNS' WHEN length(lemma) % 5 = 2 THEN 'VVZ' ELSE 'NN' END AS pos,
    CASE WHEN id = 1 THEN 0 WHEN (id * 7 + length(lemma)) % n + 1 = id THEN id - 1
      ELSE (id * 7 + length(lemma)) % n + 1 END AS dep_id FROM {name}_w),
{name} AS (SELECT {place}, id, n, word, lemma, pos, dep_id, lower(substr(pos, 1, 1)) AS cat,
    lemma || '-' || lower(substr(pos, 1, 1)) AS t,
    CASE WHEN dep_id = 0 THEN 'ROOT' WHEN pos = 'JJ' THEN 'NMOD'
      WHEN pos LIKE 'N%' AND length(lemma) % 2 = 0 THEN 'SBJ' WHEN pos LIKE 'N%' THEN 'OBJ'
      WHEN pos = 'RB' THEN 'ADV' WHEN pos LIKE 'V%' AND length(lemma) % 3 = 0 THEN 'VC' ELSE 'DEP' END AS dep_rel
  FROM {name}_p)"""


TOK = _annotated("documents", "doc_id", "tok")
TALK = _annotated("conversations", "conv_id, turn", "talk")
BENCH = """
bench AS (SELECT DISTINCT word FROM (SELECT lower(regexp_replace(unnest(
    string_split_regex(text, '[ \\n]')), '[^\\p{L}]', '', 'g')) AS word FROM benchmark) WHERE word <> '')"""
TALK_WORDS = "talk_words AS (SELECT DISTINCT lemma AS word FROM talk)"
SENT = "doc_id, sent_idx"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


# Adjectives that depend on a noun: positions, and their contexts at distance 2.
ARCS = f"""
arcs AS (SELECT {SENT}, d.id AS di, h.id AS hi, least(d.id, h.id) AS l, greatest(d.id, h.id) AS r,
    d.t || '<-->' || h.t AS pivot, d.lemma AS dl, h.lemma AS hl
  FROM tok d JOIN tok h USING ({SENT}) WHERE d.dep_id = h.id AND d.pos LIKE 'JJ%' AND h.pos LIKE 'N%')"""


def _arc_pairs(w: int | None, arcs: str = "arcs", tok: str = "tok", keys: str = SENT) -> str:
    near = "" if w is None else f" AND least(abs(c.id - a.l), abs(c.id - a.r)) <= {w}"
    return f"{arcs} a JOIN {tok} c USING ({keys}) WHERE c.id <> a.l AND c.id <> a.r{near}"


def _counts(pairs: str, space: str = "core", pivot: str = "a.t", context: str = "c.t") -> str:
    return (
        f"SELECT '{space}' AS space, {pivot} AS pivot, {context} AS context, count(*) AS occurrences "
        f"FROM {pairs} GROUP BY 1, 2, 3"
    )


def _word_pairs(w: int | None, tok: str = "tok") -> str:
    near = "" if w is None else f" AND abs(a.id - c.id) <= {w}"
    return f"{tok} a JOIN {tok} c USING ({SENT}) WHERE a.id <> c.id{near}"


PROFILE = """SELECT space, "pivot", count(*) AS contexts, CAST(sum(occurrences) AS BIGINT) AS pairs,
  CAST(sum(occurrences * occurrences) AS BIGINT) AS squares,
  CAST(sum(occurrences * length(context)) AS BIGINT) AS letters FROM counts GROUP BY 1, 2"""

# Adjective directly before a noun.
PHRASES = f"""
phrases AS (SELECT {SENT}, id AS l, id + 1 AS r, t || '<-->' || nt AS pivot, t || ' ' || nt AS phrase
  FROM (SELECT *, lead(t) OVER s AS nt, lead(pos) OVER s AS npos FROM tok WINDOW s AS (PARTITION BY {SENT} ORDER BY id))
  WHERE pos = 'JJ' AND npos IN ('NN', 'NNS'))"""

DEP_COUNTS = _with(TOK, ARCS) + _counts(_arc_pairs(2), "peripheral", "a.pivot")

COMBINED = _with(
    TOK,
    PHRASES,
    f"""
targets AS (SELECT {SENT}, id AS di, NULL AS hi, id AS l, id AS r, t AS pivot FROM tok
  UNION SELECT {SENT}, l, r, l, r, "pivot" FROM phrases
  UNION SELECT {SENT}, d.id, h.id, least(d.id, h.id), greatest(d.id, h.id), d.t || '<-->' || h.t
    FROM tok d JOIN tok h USING ({SENT}) WHERE d.dep_id = h.id AND d.dep_rel LIKE 'NMOD%')""",
) + f"""SELECT CASE WHEN a.pivot LIKE '%<-->%' THEN 'peripheral' ELSE 'core' END AS space,
  a.pivot AS pivot, c.t AS context, count(*) AS occurrences FROM {_arc_pairs(2, 'targets')} GROUP BY 1, 2, 3"""

# A document as one chunk: places run on, and for each id the last token is the target.
CHUNK = """
chunk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, id) AS place FROM tok),
by_id AS (SELECT * FROM chunk QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY place DESC) = 1)"""

TOKEN_ROWS = f"SELECT {SENT}, id, dep_id, word, lemma, pos, dep_rel"


def _grep(condition: str) -> str:
    covered = f"""
by_phrase AS (SELECT DISTINCT {SENT}, unnest([l, r]) AS id FROM phrases),
by_arc AS (SELECT DISTINCT {SENT}, unnest([di, hi]) AS id FROM arcs),
covered AS (SELECT * FROM by_phrase UNION SELECT * FROM by_arc)"""
    return _with(TOK, ARCS, PHRASES, covered) + f"""
SELECT {SENT}, string_agg(CASE WHEN c.id IS NULL THEN '' ELSE '*' END || tok.lemma, ' ' ORDER BY tok.id) AS line,
  count(c.id) AS n_matched
FROM tok LEFT JOIN covered c USING ({SENT}, id)
WHERE EXISTS ({condition}) GROUP BY {SENT}"""


def _same_sentence(table: str) -> str:
    return " AND ".join(f"{table}.{k.strip()} = tok.{k.strip()}" for k in SENT.split(","))


def _trim(kept: str, extra: tuple[str, ...] = ()) -> str:
    return _with(
        TOK,
        *extra,
        f"kept AS (SELECT *, row_number() OVER (PARTITION BY {SENT} ORDER BY id) AS new_id FROM tok WHERE {kept})",
    ) + f"""
SELECT {SENT}, k.new_id AS id, CASE WHEN k.dep_id = 0 THEN 0 ELSE coalesce(h.new_id, -1) END AS dep_id,
  k.word, k.lemma, k.pos, k.dep_rel
FROM kept k LEFT JOIN (SELECT {SENT}, id AS head, new_id FROM kept) h
  USING ({SENT}) WHERE h.head = k.dep_id
UNION ALL
SELECT {SENT}, k.new_id, CASE WHEN k.dep_id = 0 THEN 0 ELSE -1 END, k.word, k.lemma, k.pos, k.dep_rel
FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept h WHERE {" AND ".join(f"h.{x.strip()} = k.{x.strip()}" for x in SENT.split(","))} AND h.id = k.dep_id)"""


PIECES = f"""
pieces AS (SELECT d.doc_id, coalesce(s.n, 0) AS n_sentences, row_number() OVER (ORDER BY d.doc_id) AS rn
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT {SENT} FROM tok) GROUP BY 1) s
  USING (doc_id))"""

# Texts in order: sentences since the last cut, and the part.
WALK = """
walk AS (SELECT rn, CAST(n_sentences AS BIGINT) AS since, CAST(1 AS BIGINT) AS part FROM pieces WHERE rn = 1
  UNION ALL SELECT p.rn, CASE WHEN w.since >= 50 THEN 0 ELSE w.since END + p.n_sentences,
    w.part + CASE WHEN w.since >= 50 THEN 1 ELSE 0 END
  FROM walk w JOIN pieces p ON p.rn = w.rn + 1)"""

MERGED = _with(
    TOK,
    TALK,
    ARCS,
    """
talk_arcs AS (SELECT conv_id, turn, sent_idx, least(d.id, h.id) AS l, greatest(d.id, h.id) AS r,
    d.t || '<-->' || h.t AS pivot FROM talk d JOIN talk h USING (conv_id, turn, sent_idx)
  WHERE d.dep_id = h.id AND d.pos LIKE 'JJ%' AND h.pos LIKE 'N%')""",
) + f"""SELECT 'peripheral' AS space, "pivot", context, count(*) AS occurrences FROM (
  SELECT a.pivot, c.t AS context FROM {_arc_pairs(2)}
  UNION ALL SELECT a.pivot, c.t FROM {_arc_pairs(2, 'talk_arcs', 'talk', 'conv_id, turn, sent_idx')})
GROUP BY 1, 2, 3"""

ROUND_TRIP = _with(TOK) + f"{TOKEN_ROWS} FROM tok"

ORACLES: dict[str, str] = {
    "unigram_window_counts": _with(TOK) + _counts(_word_pairs(2)),
    "token_templates": _with(TOK)
    + f"""SELECT {SENT}, CAST(id AS VARCHAR) AS id, id - 1 AS place, cat, t AS target,
  word || '/' || pos AS tagged, dep_rel || '(' || dep_id || ', ' || id || ')' AS arc FROM tok""",
    "word_window_counts": _with(TOK)
    + _counts(_word_pairs(1), "core", "a.lemma", "c.pos || '/' || c.dep_rel"),
    "dependency_window_counts": DEP_COUNTS,
    "window_markers": _with(TOK, ARCS)
    + f"""SELECT a.pivot AS target, CASE WHEN c.id < a.l THEN 'l' WHEN c.id > a.r THEN 'r' ELSE 'c' END AS marker,
  count(*) AS pairs, CAST(sum(c.id - 1) AS BIGINT) AS places FROM {_arc_pairs(3)} GROUP BY 1, 2""",
    "combined_counts": COMBINED,
    "whole_sentence_profile": _with(TOK, f"counts AS ({_counts(_word_pairs(None))})") + PROFILE,
    "whole_sentence_formats": _with(TOK) + _counts(_word_pairs(None), "core", "a.lemma", "c.pos"),
    "phrase_sentence_profile": _with(
        TOK, ARCS, f"counts AS ({_counts(_arc_pairs(None), 'peripheral', 'a.pivot')})"
    )
    + PROFILE,
    "text_window_counts": _with(TOK, CHUNK)
    + _counts(
        "by_id a JOIN chunk c ON a.doc_id = c.doc_id AND c.place BETWEEN a.place - 2 AND a.place + 2 "
        "WHERE a.place <> c.place"
    ),
    "text_arc_counts": _with(
        TOK,
        CHUNK,
        """
far AS (SELECT d.doc_id, least(d.place, h.place) AS l, greatest(d.place, h.place) AS r, d.t || '<-->' || h.t AS pivot
  FROM by_id d JOIN by_id h ON d.doc_id = h.doc_id AND d.dep_id = h.id
  WHERE d.dep_rel LIKE 'NMOD%' OR d.dep_rel LIKE 'SBJ%')""",
    )
    + _counts(
        "far a JOIN chunk c ON a.doc_id = c.doc_id WHERE c.place <> a.l AND c.place <> a.r "
        "AND least(abs(c.place - a.l), abs(c.place - a.r)) <= 3",
        "peripheral",
        "a.pivot",
    ),
    "content_window_counts": _with(
        TOK,
        f"""content AS (SELECT {SENT}, t, row_number() OVER (PARTITION BY {SENT} ORDER BY id) AS id
  FROM tok WHERE substr(pos, 1, 1) IN ('N', 'J', 'V', 'R'))""",
    )
    + _counts(_word_pairs(2, "content")),
    "listed_target_counts": _with(TOK, TALK, BENCH, TALK_WORDS)
    + _counts(
        _word_pairs(2)
        + " AND a.lemma IN (SELECT word FROM bench) AND c.lemma IN (SELECT word FROM talk_words)",
        "core",
        "a.lemma",
        "c.lemma",
    ),
    "listed_arc_counts": _with(TOK, TALK, BENCH, TALK_WORDS, ARCS)
    + _counts(
        _word_pairs(2) + " AND a.lemma IN ('the', 'of', 'and', 'die', 'les')", "core", "a.lemma", "c.lemma"
    )
    + " UNION ALL "
    + _counts(
        _arc_pairs(2)
        + " AND a.dl IN (SELECT word FROM talk_words) AND a.hl IN (SELECT word FROM bench)",
        "peripheral",
        "a.dl || '<-->' || a.hl",
        "c.lemma",
    ),
    "listed_row_col_counts": _with(TOK, TALK, BENCH, TALK_WORDS, ARCS)
    + _counts(
        _word_pairs(2)
        + " AND a.lemma IN (SELECT word FROM bench) AND c.lemma IN (SELECT word FROM talk_words)",
        "core",
        "a.lemma",
        "c.lemma",
    )
    + " UNION ALL "
    + _counts(
        _arc_pairs(2)
        + " AND a.hl IN (SELECT word FROM bench) AND c.lemma IN (SELECT word FROM talk_words)",
        "peripheral",
        "a.dl || '<-->' || a.hl",
        "c.lemma",
    ),
    "encoded_counts": _with(
        TOK,
        BENCH,
        "ids AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM bench)",
        f"counts AS ({_counts(_word_pairs(1), 'core', 'a.lemma', 'c.lemma')})",
    )
    + """SELECT p.id AS pivot_id, x.id AS context_id, occurrences, "pivot", context
FROM counts JOIN ids p ON p.word = "pivot" JOIN ids x ON x.word = context""",
    "dependency_arcs": _with(TOK, ARCS)
    + f"""SELECT {SENT}, di - 1 AS start, hi - 1 AS stop, replace("pivot", '<-->', ' ') AS phrase FROM arcs""",
    "dependency_tests": _with(TOK, TALK, TALK_WORDS)
    + f"""SELECT {SENT}, d.id - 1 AS start, h.id - 1 AS stop, d.t || ' ' || h.t AS phrase
FROM tok d JOIN tok h USING ({SENT}) WHERE d.dep_id = h.id AND (d.dep_rel LIKE 'NMOD%' OR d.dep_rel LIKE 'SBJ%')
  AND regexp_matches(d.word, '^[A-Ma-m]') AND regexp_matches(d.lemma, '[est]$')
  AND (h.pos LIKE 'NN%' OR h.pos LIKE 'VV%') AND h.lemma IN (SELECT word FROM talk_words)""",
    "linear_matches": _with(TOK, PHRASES)
    + f"SELECT {SENT}, l - 1 AS start, r - 1 AS stop, phrase FROM phrases",
    "linear_runs": _with(
        TOK,
        f"""
runs AS (SELECT *, id - row_number() OVER (PARTITION BY {SENT} ORDER BY id) AS run FROM tok WHERE pos = 'JJ'),
spans AS (SELECT {SENT}, min(id) AS a, max(id) AS b, string_agg(t, ' ' ORDER BY id) AS words FROM runs
  GROUP BY {SENT}, run)""",
    )
    + f"""SELECT {SENT}, a - 1 AS start, b AS stop, words || ' ' || n.t AS phrase
FROM spans JOIN tok n USING ({SENT}) WHERE n.id = b + 1 AND n.pos IN ('NN', 'NNS')""",
    # a letter for each tag, and marks around the matches, whose places are counted without the marks
    "phrase_groups": _with(
        TOK,
        f"""
letters AS (SELECT {SENT}, regexp_replace(string_agg(CASE WHEN pos = 'JJ' THEN 'J' WHEN pos LIKE 'NN%' THEN 'N'
    WHEN pos = 'IN' THEN 'I' ELSE 'o' END, '' ORDER BY id), '((?:J?N)+I)', '<\\1>', 'g') AS marked FROM tok GROUP BY {SENT}),
signs AS (SELECT {SENT}, marked, unnest(range(1, length(marked) + 1)) AS p FROM letters WHERE marked LIKE '%<%'),
marks AS (SELECT {SENT}, p, row_number() OVER (PARTITION BY {SENT} ORDER BY p) - 1 AS before, substr(marked, p, 1) AS sign
  FROM signs WHERE substr(marked, p, 1) IN ('<', '>')),
spans AS (SELECT {SENT}, p - 1 - before AS a, lead(p - 1 - before) OVER (PARTITION BY {SENT} ORDER BY p) - 1 AS b, sign FROM marks)""",
    )
    + f"""SELECT {SENT}, a AS start, b AS stop, string_agg(t, ' ' ORDER BY id) AS phrase
FROM spans JOIN tok USING ({SENT}) WHERE sign = '<' AND id BETWEEN a + 1 AND b + 1 GROUP BY {SENT}, a, b""",
    "linear_lists": _with(TOK, BENCH)
    + f"""SELECT {SENT}, a.id - 1 AS start, b.id - 1 AS stop, a.t || ' ' || b.t AS phrase
FROM tok a JOIN tok b USING ({SENT}) WHERE b.id = a.id + 1 AND a.pos = 'JJ'
  AND a.lemma IN (SELECT word FROM bench)
  AND (b.pos LIKE 'VV_' OR (b.pos = 'IN' AND b.lemma LIKE 't%'))""",
    "grep_sentences": _grep(f"SELECT 1 FROM covered x WHERE {_same_sentence('x')}"),
    "grep_intersection": _grep(
        f"SELECT 1 FROM by_phrase x JOIN by_arc y USING ({SENT}, id) WHERE {_same_sentence('x')}"
    ),
    "trim_by_pattern": _trim("regexp_matches(lemma, '^.*[aeiou]n') AND regexp_matches(pos, '^(N|J|V)')"),
    "trim_by_list": _trim("lemma IN (SELECT word FROM talk_words)", (TALK, TALK_WORDS)),
    "noun_heads": _with(
        TOK,
        f"""
links AS (SELECT {SENT}, h.id AS hi, max(d.id) AS di FROM tok d JOIN tok h USING ({SENT})
  WHERE d.dep_id = h.id AND h.id < d.id AND (d.pos = 'JJ' OR d.pos LIKE 'V%') AND (h.pos = 'JJ' OR h.pos LIKE 'V%')
    AND NOT regexp_matches(d.dep_rel, '^(PRN|OBJ|ADV|COORD|AMOD)') GROUP BY {SENT}, h.id),
steps AS (SELECT {SENT}, id, dep_id AS head, 0 AS step FROM tok WHERE pos LIKE 'N_%' AND dep_id > id
  UNION ALL SELECT {SENT}, s.id, l.di, s.step + 1 FROM steps s JOIN links l USING ({SENT}) WHERE l.hi = s.head),
ends AS (SELECT {SENT}, id, arg_max(head, step) AS head FROM steps GROUP BY {SENT}, id)""",
    )
    + f"""SELECT {SENT}, id, coalesce(e.head, dep_id) AS dep_id, word, lemma, pos, dep_rel
FROM tok LEFT JOIN ends e USING ({SENT}, id)""",
    "words_of_sentences": _with(
        TOK,
        f"""
lexical AS (SELECT *, row_number() OVER (PARTITION BY {SENT} ORDER BY id) AS place FROM tok
  WHERE regexp_matches(pos, '^(NN|VV|RB|JJ)') AND regexp_matches(lemma, '^[A-Za-z]+$'))""",
    )
    + f"""SELECT DISTINCT {SENT}, 0 AS place, '<s>' AS line FROM tok
UNION ALL SELECT {SENT}, place, lemma || '-' || CASE WHEN pos = 'VVG' THEN 'vvg' ELSE cat END FROM lexical""",
    "edges": _with(TOK)
    + f"""SELECT {SENT}, CAST(id AS VARCHAR) AS id, CAST(dep_id AS VARCHAR) AS dep_id, dep_rel,
  word || '/' || pos AS label FROM tok""",
    "graphs": _with(
        TOK,
        f"""
bodies AS (SELECT {SENT}, row_number() OVER (ORDER BY {SENT}) - 1 AS number, string_agg(word, ' ' ORDER BY id) AS label,
    string_agg('n_' || id || '[label="' || word || '/' || pos || '"];' || chr(10) ||
      'n_' || id || ' -> n_' || dep_id || ' [label="' || dep_rel || '"];', chr(10) ORDER BY id) AS body
  FROM tok GROUP BY {SENT})""",
    )
    + f"""SELECT {SENT}, number, 'digraph sentence_' || number || ' {{' || chr(10) || body || chr(10) ||
  'label = "' || label || '"' || chr(10) || '}}' AS dot FROM bodies""",
    "parts_by_texts": _with(TOK, PIECES)
    + "SELECT doc_id, n_sentences, (rn - 1) // 7 + 1 AS part FROM pieces",
    "parts_by_sentences": _with(TOK, PIECES, WALK)
    + "SELECT doc_id, n_sentences, part FROM pieces JOIN walk USING (rn)",
    "part_files": _with(TOK, PIECES, WALK)
    + """SELECT part, count(DISTINCT (doc_id, sent_idx)) AS sentences, count(*) AS tokens
FROM tok JOIN pieces USING (doc_id) JOIN walk USING (rn) GROUP BY part""",
    "merged_counts": MERGED,
    "union_counts": MERGED,
    "sorted_counts": _with(TOK, ARCS, f"counts AS ({_counts(_arc_pairs(2), 'peripheral', 'a.pivot')})")
    + """SELECT "pivot", context, occurrences, split_part("pivot", '<-->', 2) AS second FROM counts
ORDER BY 3 DESC, 1 DESC, 2 DESC""",
    "corpus_files": ROUND_TRIP,
    "corpus_files_gzip": ROUND_TRIP,
    "corpus_splits": ROUND_TRIP,
    "corpus_counts": _with(TOK, PHRASES)
    + _counts(_word_pairs(2), "core", "a.lemma", "c.lemma")
    + " UNION ALL "
    + _counts(
        f"phrases a JOIN tok x USING ({SENT}) JOIN tok y USING ({SENT}) JOIN tok c USING ({SENT}) "
        "WHERE x.id = a.l AND y.id = a.r AND c.id <> a.l AND c.id <> a.r "
        "AND least(abs(c.id - a.l), abs(c.id - a.r)) <= 2",
        "peripheral",
        "x.lemma || '<-->' || y.lemma",
        "c.lemma",
    ),
    "own_matcher_counts": _with(
        TOK,
        f"side AS (SELECT {SENT}, a.id, a.t || '<-->' || b.t AS target FROM tok a JOIN tok b USING ({SENT}) WHERE b.id = a.id + 1)",
    )
    + f"""SELECT target, c.t AS context, CAST(c.id - s.id - 1 AS VARCHAR) AS marker, count(*) AS pairs
FROM side s JOIN tok c USING ({SENT}) WHERE c.id BETWEEN s.id + 2 AND s.id + 3 GROUP BY 1, 2, 3""",
    "phrase_run_counts": _with(
        TOK,
        f"""
adjectives AS (SELECT *, id - row_number() OVER (PARTITION BY {SENT} ORDER BY id) AS run FROM tok WHERE pos = 'JJ'),
chains AS (SELECT {SENT}, min(id) AS l, max(id) AS e, string_agg(t, '<-->' ORDER BY id) AS words FROM adjectives
  GROUP BY {SENT}, run),
named AS (SELECT {SENT}, l, n.id AS r, words || '<-->' || n.t AS pivot FROM chains JOIN tok n USING ({SENT})
  WHERE n.id = e + 1 AND n.pos = 'NN')""",
    )
    + f"""SELECT 'peripheral' AS space, a.pivot AS pivot, c.t AS context, count(*) AS occurrences
FROM named a JOIN tok c USING ({SENT}) WHERE (c.id < a.l OR c.id > a.r) AND least(abs(c.id - a.l), abs(c.id - a.r)) <= 2
GROUP BY 1, 2, 3""",
    "word_list_file": """WITH parts AS (SELECT item_id, unnest(range(len(l))) AS k, unnest(l) AS w
  FROM (SELECT item_id, string_split_regex(text, '[ \n]') AS l FROM benchmark)),
lines AS (SELECT row_number() OVER (ORDER BY item_id, k) - 1 AS id, w,
  CASE WHEN k % 2 = 0 THEN ' ' ELSE chr(9) END || w || ' ' AS line FROM parts)
SELECT 'ws' AS strip, id, w AS word FROM lines UNION ALL SELECT 'spacetab', id, w FROM lines
UNION ALL SELECT 'newline', id, line FROM lines""",
    "rewritten_files": _trim("regexp_matches(lemma, '^.*[aeiou]n') AND regexp_matches(pos, '^(N|J|V)')"),
    "text_file_counts": _with(TOK, CHUNK)
    + _counts(
        "by_id a JOIN chunk c ON a.doc_id = c.doc_id AND c.place BETWEEN a.place - 2 AND a.place + 2 "
        "WHERE a.place <> c.place"
    ),
    "sorted_export": _with(TOK, ARCS, f"counts AS ({_counts(_arc_pairs(2), 'peripheral', 'a.pivot')})")
    + """SELECT row_number() OVER (ORDER BY occurrences DESC, "pivot" DESC, context DESC) AS place,
  "pivot", context, occurrences FROM counts""",
    "pair_file_counts": DEP_COUNTS,
    "count_files": COMBINED,
    "streamed_counts": DEP_COUNTS,
    "streamed_merge": DEP_COUNTS,
}
