"""Keyword and phrase matching.

A keyword matches as a whole word or phrase: ``\\b`` (Unicode) on both ends and
any run of white space between its words. A text is cut into words once; keywords of one
word are looked up among them (a hash set per text), and the pattern of a longer keyword is
tried only on texts that hold all of its words.

For vocabularies too large for an expression, ``term_tokens`` cuts a text (or a term) into
words, single spaces for runs of white space, and other characters, so that a term of n such
tokens is found among the text's n-grams (``operators/relevance.py``, ``dictionary_hits``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.text import col


def _escape(part: str) -> str:
    out = []
    for ch in part:
        if ch.isascii() and not ch.isalnum():
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def keyword_pattern(keyword: str) -> str:
    """Java regex for one keyword: \\b w1 \\s+ w2 ... \\b with Unicode classes."""
    core = r"\s+".join(_escape(p) for p in keyword.split())
    return r"(?U)\b" + core + r"\b"


_WORD = r"(?U)\w+"
_TOKEN = r"(?U)\w+|\s+|[^\w\s]"
_LISTED = "\x1f"


def words(text) -> Column:
    """array<string> of the runs of word characters."""
    return F.regexp_extract_all(col(text), F.lit(_WORD), F.lit(0))


def term_tokens(text) -> Column:
    """array<string>: words, one space for each run of white space, every other character."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(_TOKEN), F.lit(0)),
                       lambda x: F.when(x.rlike(r"(?U)^\s"), F.lit(" ")).otherwise(x))


def term_key(term: str) -> str | None:
    """The tokens of a term, joined; None where it does not begin and end with a word
    character (such terms need their pattern)."""
    term = " ".join(term.split())
    return term if re.fullmatch(r"\w(.*\w)?", term) else None


def _constant(values: list[str]) -> Column:
    return F.split(F.lit(_LISTED.join(values)), _LISTED)   # folded to one constant array


def known_words(text, keywords) -> Column:
    """array<string>: of the words of ``text``, those that the keywords are made of."""
    return F.array_intersect(_constant(sorted({w for k in keywords for w in re.findall(r"\w+", k)}) or [""]), words(text))


def keyword_hits(text, keywords, known: Column | None = None) -> Column:
    """array<string> of the keywords found in ``text``, in list order. ``known``: the text's
    ``words`` (or ``known_words`` of these and other keywords), where they have been made before."""
    keywords = list(keywords)
    if not keywords:
        return F.array().cast("array<string>")
    t = col(text)
    parts = {k: re.findall(r"\w+", k) for k in keywords}
    single = [k for k in keywords if parts[k] == [k]]
    needed = _constant(sorted({w for k in keywords for w in parts[k]}) or [""])
    found = F.array_intersect(needed, words(t) if known is None else known)
    if len(single) == len(keywords):
        return F.array_intersect(_constant(keywords), words(t) if known is None else known)
    empty = F.array().cast("array<string>")

    def hits(known: Column) -> Column:
        tests = []
        for k in keywords:
            here = F.lit(True)
            for w in dict.fromkeys(parts[k]):
                here = here & F.array_contains(known, w)
            if parts[k] != [k]:
                here = here & t.rlike(keyword_pattern(k))
            tests.append(F.when(here, F.array(F.lit(k))).otherwise(empty))
        # flatten of one-or-zero element arrays keeps list order
        return F.flatten(F.array(*tests))

    # the one-element array makes ``found`` once; named in each test, it would be made by each
    return F.element_at(F.transform(F.array(found), hits), 1)
