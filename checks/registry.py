"""Where queries register, next to the SQL that asks the same question."""

from __future__ import annotations

from specloom import patterns as p
from checks.views import oracle

QUERIES = {}
ORACLES = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a query (spark, folder) -> DataFrame, and its SQL over the named views."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return function

    return register


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches_any(column: str, patterns) -> str:
    """Any of the patterns is found; a dot stops at a newline in this dialect, too."""
    joined = "|".join(f"(?:{p.portable(x)})" for x in patterns)
    return f"regexp_matches({column}, {literal(joined)})"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '\\A{p.SPACE}+|{p.SPACE}+\\z', '', 'g')"


def doc_url(url: str) -> str:
    return matches_any(f"lower({url})", p.DOC_URL_PATTERNS)


def keyword_count(html: str) -> str:
    hits = [f"CAST(contains(lower({html}), {literal(w)}) AS INTEGER)" for w in p.DOC_KEYWORDS]
    return f"({' + '.join(hits)})"


def is_doc(url: str, html: str) -> str:
    marks = " OR ".join(f"contains(lower({html}), {literal(m)})" for m in p.SPEC_MARKERS)
    strong = matches_any(f"lower({url})", p.STRONG_DOC_URL_PATTERNS)
    return (
        f"({strong} OR {marks} OR {keyword_count(html)} >= "
        f"CASE WHEN {doc_url(url)} THEN {p.KEYWORDS_WITH_URL} ELSE {p.KEYWORDS_ALONE} END)"
    )
