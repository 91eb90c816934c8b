"""Main-text extraction from landed HTML pages (precision first).

A fixed chain of regular-expression rewrites, each one a native
``regexp_replace``: comments and boilerplate elements go, the ``<article>``
element is taken when present, block tags become line breaks, the remaining tags
go, the common entities are decoded (``&amp;`` last), lines are cleaned and blank
lines dropped. NULL when no text is left. The patterns use only syntax shared by
Java and RE2 so that the DuckDB oracle can replay the same chain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.text import col

BOILERPLATE_TAGS = ("script", "style", "noscript", "nav", "header", "footer", "aside",
                    "form", "table", "iframe")
BLOCK_TAGS = ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol",
              "section", "article", "blockquote", "pre", "tr", "main")

# (pattern, replacement) applied in order before the <article> pick
PRE_STEPS: list[tuple[str, str]] = [(r"(?s)<!--.*?-->", " ")] + [
    (rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ") for t in BOILERPLATE_TAGS
] + [(r"(?is)<(div|p|span|section)\b[^>]*class=\"[^\"]*\b(ad|ads|advert|banner|cookie|promo)\b[^\"]*\"[^>]*>.*?</(div|p|span|section)\s*>", " ")]

ARTICLE_PATTERN = r"(?is)<article\b[^>]*>(.*)</article\s*>"

# applied in order after the <article> pick
POST_STEPS: list[tuple[str, str]] = [
    (r"(?is)</?(" + "|".join(BLOCK_TAGS) + r")\b[^>]*>", "\n"),
    (r"(?s)<[^>]*>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""),
    ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"),
    (r"[ \t\f\r]+", " "),
    (r"(?m)^ +| +$", ""),
    (r"\n+", "\n"),
    (r"^\n+|\n+$", ""),
]

_LITERAL = {"&nbsp;", "&lt;", "&gt;", "&quot;", "&#39;", "&#x27;", "&amp;"}


def page_text(html) -> Column:
    h = F.coalesce(col(html), F.lit(""))
    for pat, rep in PRE_STEPS:
        h = F.regexp_replace(h, pat, rep)
    inner = F.regexp_extract(h, ARTICLE_PATTERN, 1)
    h = F.when(inner != "", inner).otherwise(h)
    for pat, rep in POST_STEPS:
        if pat in _LITERAL:
            h = F.replace(h, F.lit(pat), F.lit(rep))
        else:
            h = F.regexp_replace(h, pat, rep)
    return F.nullif(h, F.lit(""))
