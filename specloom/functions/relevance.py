"""Keyword relevance of endpoints, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom import patterns as p


def query_keywords(query: str) -> list[str]:
    """Keywords of one query: its words without stop words, each with its keyword group."""
    found = {}
    for word in re.findall(r"\w+", query.lower()):
        if word not in p.STOP_WORDS:
            found[word] = None
            for name, group in p.KEYWORD_GROUPS.items():
                if word == name or word in group:
                    found.update(dict.fromkeys(group))
    return list(found)


def words(text: Column) -> Column:
    """Words of a lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({p.WORD}+)"))


def keywords(query: Column) -> Column:
    """``query_keywords`` for a column of queries, sorted.

    The keyword groups are a fixed map inside the expression: no join.
    """
    related = {}
    for name, group in p.KEYWORD_GROUPS.items():
        for word in {name, *group}:
            related.setdefault(word, {}).update(dict.fromkeys(group))
    pairs = []
    for word, group in related.items():
        pairs += [F.lit(word), F.array(*[F.lit(w) for w in group])]
    groups = F.create_map(*pairs)
    plain = F.array_except(words(query), F.array(*[F.lit(w) for w in p.STOP_WORDS]))
    nothing = F.array().cast("array<string>")
    expanded = F.flatten(
        F.transform(plain, lambda w: F.coalesce(F.try_element_at(groups, w), nothing))
    )
    return F.array_sort(F.array_union(plain, expanded))


def literal_keywords(found: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in found]).cast("array<string>")


def relevance(
    path: Column, summary: Column, description: Column, tags: Column, found: Column
) -> Column:
    """Score between 0 and 1 of an endpoint for an array of distinct keywords.

    Keywords are made of word characters only, so "occurs as a whole word" is membership in the
    set of words: one hash lookup per word instead of one regular expression per keyword.
    """
    path, tags = F.coalesce(path, F.lit("")), F.coalesce(tags, F.array().cast("array<string>"))
    text = F.concat_ws(" ", path, summary, description, F.array_join(tags, " "))
    share = F.size(F.array_intersect(words(text), found)) / F.size(found)
    in_path = F.exists(found, lambda k: F.contains(F.lower(path), k))
    score = F.when(in_path, F.least(F.lit(1.0), share + p.PATH_BOOST)).otherwise(share)
    return F.when(F.size(found) == 0, 1.0).otherwise(score)
