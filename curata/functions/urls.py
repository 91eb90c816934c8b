"""URL canonicalisation and fingerprints as native column expressions.

The URL is split with regular expressions in the manner of RFC 3986 appendix B
(``parse_url`` returns NULL for many real-world URLs), the query is decoded,
filtered, sorted and re-encoded with higher-order array functions. Nothing runs
in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curata.functions.text import col, normalize_title

# --- fixed values: query parameter names that carry tracking noise ---
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_reader", "utm_name", "utm_brand", "utm_social",
    "gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src",
    "source", "cmpid", "spm", "at_medium", "at_campaign",
)

# --- fixed values: schemes whose URLs carry an authority ("//") part ---
USES_NETLOC = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
    "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
    "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)


def _form_decode(c: Column) -> Column:
    # '+' is a space; a broken escape leaves the text as it is
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _form_encode(c: Column) -> Column:
    # form encoding keeps letters, digits and _ . - ~ ; space becomes '+'
    e = F.url_encode(c)
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_parts(c) -> Column:
    """struct<scheme, netloc, path, query> of the stripped URL."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    rest = F.regexp_extract(s, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(.*)$", 1)
    netloc = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    after = F.regexp_extract(rest, r"^(?://[^/?#]*)?(.*)$", 1)
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    query = F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1)
    return F.struct(s.alias("stripped"), scheme.alias("scheme"), netloc.alias("netloc"),
                    path.alias("path"), query.alias("query"))


def canonical_query(query: Column) -> Column:
    """Blank values and tracking names dropped, decoded, sorted by (name, value),
    form-encoded again and joined with '&'."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    pairs = F.transform(pairs, lambda p: F.struct(
        _form_decode(F.substring_index(p, "=", 1)).alias("k"),
        _form_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        F.regexp_extract(p, r"^[^=]*=(.*)$", 1).alias("raw_v")))
    tracking = F.array(*[F.lit(t) for t in TRACKING_PARAMS])
    kept = F.filter(pairs, lambda p: (p["raw_v"] != "") & ~F.array_contains(tracking, F.lower(p["k"])))
    kept = F.array_sort(F.transform(kept, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))))
    return F.array_join(F.transform(kept, lambda p: F.concat(
        _form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&")


def normalize_url(c) -> Column:
    """Canonical URL: scheme lower (default https), host lower without one leading
    'www.', trailing '/' removed (empty path is '/'), tracking and blank query
    parameters dropped and the rest sorted, fragment dropped. '' for empty input;
    the stripped input when the authority has unbalanced IPv6 brackets."""
    p = url_parts(c)
    scheme = F.lower(p["scheme"])
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    host = F.lower(p["netloc"])
    host = F.when(host.startswith("www."), F.substring(host, 5, 1 << 30)).otherwise(host)
    path = F.regexp_replace(p["path"], "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = canonical_query(p["query"])
    uses_netloc = F.array(*[F.lit(s) for s in USES_NETLOC])
    body = (F.when(host != "", F.concat(F.lit("//"), host, path))
            .when(path.startswith("//"), F.concat(F.lit("//"), path))
            .when(F.array_contains(uses_netloc, scheme) & path.startswith("/"),
                  F.concat(F.lit("//"), path))
            .otherwise(path))
    out = F.concat(scheme, F.lit(":"), body,
                   F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    bad_brackets = p["netloc"].contains("[") != p["netloc"].contains("]")
    raw = F.coalesce(col(c), F.lit(""))
    return (F.when(raw == "", F.lit(""))
            .when(bad_brackets, F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
            .otherwise(out))


def url_fingerprint(c) -> Column:
    return F.sha1(normalize_url(c))


def title_fingerprint(c) -> Column:
    return F.sha1(normalize_title(c))


def with_identity(df, url: str = "url", title: str = "title"):
    """Adds normalized_url, normalized_title, url_fp, title_fp and title_key
    (title_fp only when the normalised title is non-empty; NULL never joins)."""
    return (df.withColumn("normalized_url", normalize_url(url))
              .withColumn("normalized_title", normalize_title(title))
              .withColumn("url_fp", F.sha1("normalized_url"))
              .withColumn("title_fp", F.sha1("normalized_title"))
              .withColumn("title_key", F.when(F.col("normalized_title") != "", F.col("title_fp"))))
