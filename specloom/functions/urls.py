"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom import patterns as p

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def netloc(url: Column) -> Column:
    """Host with port and user info; empty when the url names no host."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)


def host_root(url: Column) -> Column:
    """Scheme and host, the base a path starting with a slash is resolved against."""
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path of an absolute url."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize_base_url(url: Column) -> Column:
    """Prefix ``https://`` when no web scheme is given."""
    has_scheme = url.startswith("http://") | url.startswith("https://")
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def site_file_name(url: Column) -> Column:
    """``https://api.example.com/v1`` -> ``api_example_com``."""
    bare = F.replace(F.replace(url, F.lit("https://")), F.lit("http://"))
    return F.replace(F.split(bare, "/")[0], F.lit("."), F.lit("_"))


def is_same_domain(url: Column, base: Column) -> Column:
    """Same host, or no host at all (``mailto:`` passes)."""
    host = netloc(url)
    return (host == netloc(base)) | (host == "")


def is_likely_doc_url(url: Column) -> Column:
    """The address looks like documentation; the whole address is searched, host included."""
    return F.rlike(F.lower(url), F.lit(p.any_of(p.DOC_URL_PATTERNS)))


def is_api_documentation(url: Column, html: Column) -> Column:
    """Address or content say that a page is API documentation."""
    address, body = F.lower(url), F.lower(html)
    strong = F.rlike(address, F.lit(p.any_of(p.STRONG_DOC_URL_PATTERNS)))
    markers = F.contains(body, F.lit(p.SPEC_MARKERS[0]))
    for marker in p.SPEC_MARKERS[1:]:
        markers = markers | F.contains(body, F.lit(marker))
    needed = F.when(is_likely_doc_url(url), p.KEYWORDS_WITH_URL).otherwise(p.KEYWORDS_ALONE)
    return strong | markers | (keyword_count(html) >= needed)


def keyword_count(html: Column) -> Column:
    """Distinct documentation keywords present in a page."""
    body = F.lower(html)
    hits = [F.when(F.contains(body, F.lit(word)), 1).otherwise(0) for word in p.DOC_KEYWORDS]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path that starts with a slash."""
    # The first element, before the leading slash, is empty; ".." never removes it.
    segments = F.split(path, "/")
    resolved = F.aggregate(
        F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    # A trailing "." or ".." leaves the directory, which ends in a slash.
    directory = F.element_at(segments, -1).isin(".", "..")
    tail = F.when(directory, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(resolved, tail), "/"))


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute address of a link found on the page ``base`` (an absolute url)."""
    root, path = host_root(base), url_path(base)
    scheme = F.regexp_extract(base, SCHEME, 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    clean = F.regexp_replace(link, r"\A[\x00-\x20]+|[\t\r\n]", "")
    link_path = F.regexp_extract(clean, r"^([^?#]*)", 1)
    link_tail = F.regexp_extract(clean, r"^[^?#]*(.*)$", 1)
    directory = F.regexp_replace(path, r"[^/]*$", "")
    relative = F.concat(F.when(directory == "", "/").otherwise(directory), link_path)
    relative = F.regexp_replace(relative, "/{2,}", "/")
    return (
        F.when(clean == "", base)
        .when(F.rlike(clean, F.lit(SCHEME)), link)
        .when(clean.startswith("//"), F.concat(scheme, F.lit(":"), clean))
        .when(clean.startswith("/"), F.concat(root, remove_dot_segments(link_path), link_tail))
        .when(clean.startswith("?"), F.concat(root, path, clean))
        .when(clean.startswith("#"), F.concat(root, path, query, clean))
        .otherwise(F.concat(root, remove_dot_segments(relative), link_tail))
    )
