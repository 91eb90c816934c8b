"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

from curata.llm import rules

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = "list_filter(string_split_regex({}, '" + _SPACE + "'), lambda w: w <> '')"

#: 2-word shingles, all links by an inverted index over the shingles, reachability
NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sized a JOIN sized b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN roots USING (doc_id)"""

# SHA-1 has 40 hexadecimal digits: eight groups of 20 bits, four base-32 digits each
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {shift}) & 31), 1)"
    for g in range(8) for shift in (15, 10, 5, 0))

ARCHIVE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS response FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM f"""


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _counted(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(text) - len(regexp_replace(text, '{quoted}', '', 'g'))"


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance, base 2, of two lists; null if one is null."""
    def term(x):
        return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p}[i] + {q}[i]) / 2)) ELSE 0 END"
    total = f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({term(p + '[i]')} + {term(q + '[i]')}) / 2))"
    return f"CASE WHEN {p} IS NOT NULL AND {q} IS NOT NULL THEN round(sqrt(greatest(0.0, {total})), 6) END"


def _rules() -> str:
    every = _list(sorted({w for words in rules.COMMON_WORDS.values() for w in words}))
    listed = "CASE lang " + " ".join(f"WHEN '{c}' THEN {_list(w)}" for c, w in rules.COMMON_WORDS.items())
    span = rules.WINDOW
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w,
             {listed} ELSE {every} END AS listed
           FROM documents),
grams AS (SELECT doc_id, i, list_slice(w, i, i + {span - 1}) AS g
          FROM d, range(1, len(w) - {span - 2}) r(i) WHERE len(w) >= {span}),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, sum(least({span}, coalesce(i - last, {span}))) AS n
            FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, listed, w, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(text) AS chars,
         strlen(text) AS bytes, {", ".join(f"{_counted(p)} AS {n}" for n, p in rules._COUNTED.items())},
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{rules._WORD}')) AS lines,
         coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
t AS (
  SELECT *, list_transform(listed, lambda l: len(list_filter(w, lambda x: x = l))) AS tally,
         [chars - word_chars, {", ".join(rules._COUNTED)}, bytes - chars] AS classes,
         chars >= {rules.MIN_CHARS} AND n_words >= {rules.MIN_HISTOGRAM_WORDS} AS long_enough
  FROM m),
h AS (
  SELECT *, CASE WHEN long_enough THEN list_transform(list_append(classes, bytes - list_sum(classes)),
                                                      lambda x: x / bytes) END AS chars_p,
         CASE WHEN long_enough THEN list_transform(list_append(tally, n_words - list_sum(tally)),
                                                   lambda x: x / n_words) END AS words_p
  FROM t),
means AS (
  SELECT lang, kind, i, avg(x) AS x FROM (
    SELECT lang, 'c' AS kind, unnest(range(1, len(chars_p) + 1)) AS i, unnest(chars_p) AS x FROM h UNION ALL
    SELECT lang, 'w', unnest(range(1, len(words_p) + 1)), unnest(words_p) FROM h) GROUP BY ALL),
refs AS (SELECT lang, list(x ORDER BY i) FILTER (kind = 'c') AS chars_q, list(x ORDER BY i) FILTER (kind = 'w') AS words_q
         FROM means GROUP BY lang),
j AS (
  SELECT h.*, {_distance("chars_p", "chars_q")} AS char_distance, {_distance("words_p", "words_q")} AS word_distance,
         n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEATED_PERCENT} * n_words AS base_failed
  FROM h LEFT JOIN refs ON h.lang IS NOT DISTINCT FROM refs.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(char_distance > {rules.MAX_CHAR_DISTANCE}, false)
         AND NOT coalesce(word_distance > {rules.MAX_WORD_DISTANCE}, false) AS kept,
       char_distance, word_distance
FROM j"""


RULES = _rules()
