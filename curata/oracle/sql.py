"""DuckDB twins of the Spark expressions, used to write the oracle SQL.

These are SQL *text* builders for the correctness gate only; no query is run by
this module. RE2 (DuckDB) has ASCII ``\\b``/``\\w``, no look-behind and no
back-references, so Unicode word boundaries are spelled out as
``(^|[^\\p{L}\\p{N}_])`` and splits use a marker character.
"""

from __future__ import annotations

from curata.functions.text import ANNOUNCE_STEMS, STOP_WORDS
from curata.functions.urls import TRACKING_PARAMS, USES_NETLOC
from curata.sources.pages import ARTICLE_PATTERN, POST_STEPS, PRE_STEPS

WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"
SEP = "chr(1)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


# ---------------------------------------------------------------- text
def collapse_ws(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def sentences(e: str) -> str:
    """list of sentences of the collapsed text (empties dropped)."""
    t = collapse_ws(f"coalesce({e}, '')")
    return (f"list_filter(string_split(regexp_replace({t}, '([.!?]) ', '\\1' || {SEP}, 'g'), {SEP}),"
            f" lambda s: s <> '')")


def normalize_title(e: str) -> str:
    t = f"regexp_replace(lower(coalesce({e}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def scoring_text(title: str, summary: str) -> str:
    return f"lower(coalesce({title}, '') || chr(10) || coalesce({summary}, ''))"


def strip_html(e: str) -> str:
    t = f"regexp_replace(coalesce({e}, ''), '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def doc_text(title: str, summary: str) -> str:
    return f"(coalesce({title}, '') || ' ' || coalesce({summary}, ''))"


def tokens(e: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({e}), '[a-z0-9]+'), "
            f"lambda t: length(t) > 1 AND NOT list_contains({str_list(STOP_WORDS)}, t))")


def word_count(e: str) -> str:
    return f"length(regexp_extract_all(coalesce({e}, ''), '{WORD}+'))"


def xml_escape(e: str) -> str:
    t = f"coalesce({e}, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


def teaser(e: str, length: int = 240, leeway: int = 5, end: str = "...") -> str:
    t = f"coalesce({e}, '')"
    cut = f"regexp_replace(substring({t}, 1, {length - len(end)}), ' [^ ]*$', '')"
    return f"CASE WHEN length({t}) <= {length + leeway} THEN {t} ELSE {cut} || {q(end)} END"


def sentence_score(s: str, i: str) -> str:
    """i is 0-based."""
    n = f"length(string_split({s}, ' '))"
    stems = " + ".join(f"(CASE WHEN contains(lower({s}), {q(k)}) THEN 1.5 ELSE 0.0 END)"
                       for k in ANNOUNCE_STEMS)
    base = f"greatest(0.0, 3.0 - CAST({i} AS DOUBLE) * 0.6)"
    medium = f"(CASE WHEN {n} BETWEEN 8 AND 34 THEN 1.0 ELSE 0.0 END)"
    return f"(CASE WHEN {n} < 4 OR {n} > 60 THEN -1.0 ELSE {base} + ({stems}) + {medium} END)"


def page_text(e: str) -> str:
    h = f"coalesce({e}, '')"
    for pat, rep in PRE_STEPS:
        h = f"regexp_replace({h}, {q(_re2(pat))}, {q(rep)}, 'g')"
    inner = f"regexp_extract(__h, {q(_re2(ARTICLE_PATTERN))}, 1)"
    # the <article> pick needs the value twice: use a lambda over a one-element list
    h = f"list_transform([{h}], lambda __h: CASE WHEN {inner} <> '' THEN {inner} ELSE __h END)[1]"
    for pat, rep in POST_STEPS:
        if pat.startswith("&"):
            h = f"replace({h}, {q(pat)}, {q(rep)})"
        else:
            rep_sql = "chr(10)" if rep == "\n" else q(rep)
            h = f"regexp_replace({h}, {q(_re2(pat))}, {rep_sql}, 'g')"
    return f"nullif({h}, '')"


def _re2(pat: str) -> str:
    # Java and RE2 share this syntax; newline escapes are kept as regex escapes
    return pat.replace("\n", "\\n")


# ---------------------------------------------------------------- keywords
def _re2_escape(part: str) -> str:
    return "".join("\\" + ch if (ch.isascii() and not ch.isalnum()) else ch for ch in part)


def keyword_pattern(keyword: str) -> str:
    parts = keyword.split()
    core = r"\s+".join(_re2_escape(p) for p in parts)
    first, last = keyword.strip()[:1], keyword.strip()[-1:]

    def is_word(ch):
        return ch.isalnum() or ch == "_"
    left = f"(^|{NONWORD})" if is_word(first) else WORD
    right = f"($|{NONWORD})" if is_word(last) else WORD
    return left + core + right


def keyword_hits(text: str, keywords) -> str:
    keywords = list(keywords)
    if not keywords:
        return "[]::VARCHAR[]"
    cases = ", ".join(
        f"CASE WHEN regexp_matches({text}, {q(keyword_pattern(k))}) THEN {q(k)} END"
        for k in keywords)
    return f"list_filter([{cases}]::VARCHAR[], lambda x: x IS NOT NULL)"


# ---------------------------------------------------------------- urls
def _form_decode(e: str) -> str:
    return f"url_decode(replace({e}, '+', ' '))"


def _form_encode(e: str) -> str:
    return f"replace(url_encode({e}), '%20', '+')"


def normalize_url(e: str) -> str:
    s = f"regexp_replace(regexp_replace(coalesce({e}, ''), '^\\s+|\\s+$', '', 'g'), '[\\t\\r\\n]', '', 'g')"
    tracking = str_list(TRACKING_PARAMS)
    uses = str_list(USES_NETLOC)
    return f"""(list_transform([{s}], lambda s: list_transform([{{
        'scheme': CASE WHEN regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) = '' THEN 'https'
                       ELSE lower(regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) END,
        'netloc': regexp_extract(regexp_extract(s, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(.*)$', 1), '^//([^/?#]*)', 1),
        'after': regexp_extract(regexp_extract(s, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(.*)$', 1), '^(?://[^/?#]*)?(.*)$', 1)
      }}], lambda p: list_transform([{{
        'scheme': p.scheme,
        'raw_netloc': p.netloc,
        'host': regexp_replace(lower(p.netloc), '^www\\.', ''),
        'path': CASE WHEN regexp_replace(regexp_extract(p.after, '^([^?#]*)', 1), '/+$', '') = '' THEN '/'
                     ELSE regexp_replace(regexp_extract(p.after, '^([^?#]*)', 1), '/+$', '') END,
        'query': array_to_string(list_transform(list_sort(list_transform(list_filter(
                    list_transform(list_filter(string_split(regexp_extract(p.after, '^[^?#]*\\?([^#]*)', 1), '&'),
                                               lambda x: contains(x, '=')),
                                   lambda x: {{'k': {_form_decode("split_part(x, '=', 1)")},
                                              'rv': regexp_extract(x, '^[^=]*=(.*)$', 1)}}),
                    lambda x: x.rv <> '' AND NOT list_contains({tracking}, lower(x.k))),
                  lambda x: {{'k': x.k, 'v': {_form_decode('x.rv')}}})),
                  lambda x: {_form_encode('x.k')} || '=' || {_form_encode('x.v')}), '&')
      }}], lambda u: CASE
        WHEN s = '' AND coalesce({e}, '') = '' THEN ''
        WHEN contains(u.raw_netloc, '[') <> contains(u.raw_netloc, ']') THEN s
        ELSE u.scheme || ':' ||
          (CASE WHEN u.host <> '' THEN '//' || u.host || u.path
                WHEN starts_with(u.path, '//') THEN '//' || u.path
                WHEN list_contains({uses}, u.scheme) AND starts_with(u.path, '/') THEN '//' || u.path
                ELSE u.path END)
          || CASE WHEN u.query <> '' THEN '?' || u.query ELSE '' END
        END)[1])[1])[1])"""


# ---------------------------------------------------------------- item tables
def doc_items_cte(name: str = "items") -> str:
    """DuckDB twin of ``curata.sources.items.items_from_documents``."""
    first = f"coalesce({sentences('text')}[1], '')"
    return f"""{name} AS (
  SELECT doc_id AS item_id, doc_id AS seq, CAST(floor(doc_id / 24) AS BIGINT) AS run_id,
         source AS source_id,
         'https://www.' || source || '.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR)
           || '/?utm_source=feed&id=' || CAST(doc_id AS VARCHAR) AS url,
         {first} AS title,
         {collapse_ws('text')} AS summary,
         text AS content, '' AS author,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS fetched_at,
         CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) END
           AS published_at,
         CAST((doc_id % 4) * 0.5 AS DOUBLE) AS source_weight, lang
  FROM documents)"""


def mixed_batch_cte(items: str = "items", name: str = "mixed") -> str:
    second = f"{sentences('content')}[2]"
    return f"""{name} AS (
  SELECT * REPLACE (item_id * 2 AS seq) FROM {items}
  UNION ALL
  SELECT item_id, item_id * 2 + 1 AS seq, run_id, source_id, url,
         {second} AS title, summary, content, author, fetched_at, published_at,
         CAST(((item_id + 2) % 4) * 0.5 AS DOUBLE) AS source_weight, lang
  FROM {items} WHERE {second} IS NOT NULL)"""


def page_items_cte(name: str = "page_items") -> str:
    title = strip_html("coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''),"
                       " regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1))")
    body = f"coalesce({page_text('html')}, '')"
    host = ("regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#:]*)', 1)),"
            " '^www\\.', '')")
    no_frag = "regexp_replace(url, '#.*$', '')"
    toggled = (f"CASE WHEN regexp_matches({no_frag}, '^[A-Za-z]+://www\\.') "
               f"THEN regexp_replace({no_frag}, '^([A-Za-z]+://)www\\.', '\\1') "
               f"ELSE regexp_replace({no_frag}, '^([A-Za-z]+://)', '\\1www.') END")
    return f"""{name}_base AS (
  SELECT page_id * 2 AS item_id, page_id * 2 AS seq, CAST(floor(page_id / 25) AS BIGINT) AS run_id,
         {host} AS source_id, url, {title} AS title,
         {collapse_ws(body)} AS summary, {body} AS content, '' AS author,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(floor(page_id / 25) AS INTEGER)) AS fetched_at,
         CAST(NULL AS TIMESTAMP) AS published_at,
         CAST((page_id % 3) * 0.5 AS DOUBLE) AS source_weight,
         regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang
  FROM pages),
{name} AS (
  SELECT * FROM {name}_base
  UNION ALL
  SELECT item_id + 1 AS item_id, seq + 1 AS seq, run_id, 'aggregator' AS source_id,
         {toggled.replace('url', 'url')} || CASE WHEN contains({no_frag}, '?') THEN '&' ELSE '?' END
           || 'utm_medium=social' AS url,
         title || ' | Digest' AS title, summary, content, author, fetched_at, published_at,
         CAST(((item_id // 2 + 1) % 4) * 0.5 AS DOUBLE) AS source_weight, lang
  FROM {name}_base WHERE item_id % 6 = 0)"""


def relevance_select(scope, text: str = None, weight: str = "source_weight") -> str:
    """SELECT-list fragments: strong_hits ... exclude_hits, raw_score."""
    t = text or scoring_text("title", "summary")
    return (f"{keyword_hits(t, scope.strong)} AS strong_hits, "
            f"{keyword_hits(t, scope.normal)} AS normal_hits, "
            f"{keyword_hits(t, scope.signals)} AS signal_hits, "
            f"{keyword_hits(t, scope.exclude)} AS exclude_hits")


def scored_cte(scope, src: str = "items", name: str = "scored") -> str:
    """DuckDB twin of ``curata.operators.relevance.apply_relevance``."""
    w = scope.weights
    raw = (f"(len(strong_hits) * {w.strong_keyword!r} + len(normal_hits) * {w.normal_keyword!r}"
           f" + len(signal_hits) * {w.announcement_signal!r} - len(exclude_hits) * {w.exclude_penalty!r}"
           f" + coalesce(source_weight, 0.0) * {w.source_weight_scale!r})")
    return f"""{name}_hits AS (
  SELECT *, {relevance_select(scope)} FROM {src}),
{name}_raw AS (
  SELECT *, CAST({raw} AS DOUBLE) AS raw_score,
         (len(strong_hits) + len(signal_hits)) > 0 AS in_scope,
         coalesce(source_weight, 0.0) AS sw FROM {name}_hits),
{name} AS (
  SELECT * EXCLUDE (in_scope, sw),
         round(raw_score, 3) AS relevance_score,
         raw_score >= {w.min_score!r} AND in_scope AS relevant,
         CASE WHEN raw_score >= {w.min_score!r} AND in_scope THEN 'relevant' ELSE 'irrelevant' END AS status,
         list_filter([
           CASE WHEN len(strong_hits) > 0 THEN 'strong: ' || array_to_string(strong_hits, ', ') END,
           CASE WHEN len(signal_hits) > 0 THEN 'novelty: ' || array_to_string(signal_hits, ', ') END,
           CASE WHEN len(normal_hits) > 0 THEN 'normal: ' || array_to_string(normal_hits, ', ') END,
           CASE WHEN len(exclude_hits) > 0 THEN 'excluded: ' || array_to_string(exclude_hits, ', ') END,
           CASE WHEN sw <> 0 THEN 'source_weight: ' || CAST(sw AS VARCHAR) END,
           CASE WHEN NOT in_scope THEN 'no in-scope signal (dropped)' END,
           'score=' || CAST(round(raw_score, 2) AS VARCHAR) || ' min={w.min_score!r}'
         ]::VARCHAR[], lambda x: x IS NOT NULL) AS relevance_reasons
  FROM {name}_raw)"""


def strip_ws(e: str) -> str:
    return f"regexp_replace(coalesce({e}, ''), '^\\s+|\\s+$', '', 'g')"


def best_text(content: str = "content", summary: str = "summary") -> str:
    return (f"CASE WHEN {strip_ws(content)} <> '' THEN {strip_ws(content)} "
            f"ELSE {strip_ws(summary)} END")


def top_sentences_list(sents: str, k: int = 3) -> str:
    """list<varchar>: the k best sentences of the list ``sents`` in first-occurrence order."""
    scored = (f"list_transform({sents}, lambda x, i: {{'neg': -({sentence_score('x', 'i - 1')}), "
              f"'idx': i - 1, 'text': x}})")
    picked = f"list_slice(list_sort(list_filter({scored}, lambda y: y.neg < 0)), 1, {k})"
    placed = (f"list_sort(list_transform({picked}, lambda y: {{'pos': list_position({sents}, y.text), "
              f"'idx': y.idx, 'text': y.text}}))")
    return f"list_transform({placed}, lambda z: z.text)"
