"""Secrets in texts: rules are regular expressions, a trigram index says where they can match.

1. From each pattern a Boolean query over trigrams is derived: the literal strings that a match must
   hold, as an AND of ORs of trigram sets (lower-cased; sets that hold another one are dropped).
2. The index has a posting (trigram, row) for each trigram of the queries and each row whose text holds
   it. Rows of a rule are those in the intersections and unions of its postings.
3. Candidates are verified: the pattern runs over the whole text. A rule from whose pattern no trigram
   follows runs over every text.

All of it is SQL functions; the texts pass one shuffle, to meet their postings. A row is known by a
hash of its id and text; two rows that share one are verified for each other's rules, nothing else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as k
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import boxed, let

#: Literal strings followed through one pattern; beyond, a part counts as unknown.
ENUMERATED = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A private key, of PGP as well: from its first line to its END line, if no other line of five hyphens is
# between. Without an END line: headers, the run of base64 lines and a piece on the line after. Possessive
# repeats, which Java walks through in a loop, so a key has any length; nothing behind them could need what
# they take, so plain repeats match the same.
_SEPARATED = r"[\x20\t\r\n\\,>+-]"
_HEADER = r"(?:[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:\x20*[^\x20\t\r\n]+|(?:Version|Comment|Hash|Charset):[^\r\n\\]*)"
PRIVATE_KEY = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:"
    r"[^-]*+(?:-{1,4}[^-]++)*+-----+END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|"
    rf"(?:{_SEPARATED}*{_HEADER})*+(?:{_SEPARATED}+[A-Za-z0-9+/=]{{16,}})*+(?:(?:\\|\r?\n)[A-Za-z0-9+/=]+)?)"
)
BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
RULES = (
    *BASE,
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

Query = list[list[frozenset[str]]]  # AND of ORs of trigram sets, each set being an AND


def _strings(item) -> set[str] | None:
    """All strings that an element of a parsed pattern matches, lower-cased; None if many."""
    kind, value = item
    if kind is k.LITERAL:
        return {chr(value).lower()}
    if kind is k.IN and all(x[0] is k.LITERAL for x in value):
        return {chr(x[1]).lower() for x in value}
    if kind is k.SUBPATTERN:
        return _sequence(value[-1])
    if kind is k.BRANCH:
        found = [_sequence(x) for x in value[1]]
        return None if None in found else set().union(*found)
    if kind is k.MAX_REPEAT and value[1] <= 2:
        one = _sequence(value[2])
        if one is not None:
            out, power = set(), {""}
            for n in range(value[1] + 1):
                if n >= value[0]:
                    out |= power
                power = {a + b for a in power for b in one}
            return out
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        found = _strings(item)
        if found is None or len(out) * len(found) > ENUMERATED:
            return None
        out = {a + b for a in out for b in found}
    return out


def trigram_query(pattern: str) -> Query:
    """What trigrams a text must hold for a match; empty if none follow from the pattern."""
    runs, current = [], {""}
    for item in [*parser.parse(pattern), None]:
        found = item and _strings(item)
        if found and len(current) * len(found) <= ENUMERATED:
            current = {a + b for a in current for b in found}
        else:
            runs.append(current)
            current = found or {""}
    query = []
    for strings in runs:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            query.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
    return query


def _holds(query: Query, grams: Column) -> Column:
    every = F.lit(True)
    for either in query:
        some = F.lit(False)
        for grams_of in either:
            some = some | (F.size(F.array_intersect(grams, F.array(*map(F.lit, sorted(grams_of))))) == len(grams_of))
        every = every & some
    return every


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """The index: a row (gram, row_key) for each of the trigrams that a row's text holds."""
    low = F.lower("text")
    there = let(low, lambda t: F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(t, g)))
    return keyed.select("row_key", F.explode(there).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """row_key and the kinds of the rules whose trigram query its postings answer."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    held = index.groupBy("row_key").agg(F.collect_set("gram").alias("grams"))
    kinds = F.array_compact(F.array(*(F.when(_holds(q, F.col("grams")), F.lit(n)) for n, q in queries.items() if q)))
    return held.select("row_key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


SPAN = "array<struct<start: bigint, rank: int, kind: string, end: bigint>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in code points, leftmost and without overlap.

    What lies between the matches and the matches themselves add up to the positions.
    """
    parts = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))

    def walk(bound: Column) -> Column:
        def step(state, i):
            start = state["at"] + F.length(F.get(bound["parts"], i))
            end = start + F.length(F.get(bound["hits"], i))
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
            good = F.length(F.get(bound["checked"], i)) >= rule.least
            found = F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"])
            return F.struct(end.alias("at"), found.alias("found"))

        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("found"))
        steps = F.sequence(F.lit(0), F.size(bound["hits"]) - 1)
        return F.aggregate(steps, zero, step)["found"]

    bound = F.struct(parts.alias("parts"), hits.alias("hits"), checked.alias("checked"))
    return F.when(text.rlike(rule.pattern), let(bound, walk)).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``secret_spans``: start, rank of the rule, kind, end, by start and rank.

    Positions are code points, the end is exclusive. A null text is empty and has no span. Repeated rows
    and ids, also null ones, are handled row by row; spans of different rules may overlap. Columns of
    other names are carried along, a column that is already called secret_spans is replaced.
    """
    row = F.col("row")
    body = F.coalesce(row[text].cast("string"), F.lit(""))
    keyed = boxed(docs, "secret_spans").withColumn("_text", body).withColumn("_row_key", F.xxhash64(row[key], body))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for either in q for s in either for g in s})
    index = postings(keyed.select(F.col("_row_key").alias("row_key"), F.col("_text").alias("text")), grams)
    found = candidates(index, rules).select(F.col("row_key").alias("_found"), F.col("kinds").alias("_kinds"))
    met = keyed.join(found.hint("shuffle_hash"), F.col("_row_key") == F.col("_found"), "left")
    spans = []
    for rank, rule in enumerate(rules):
        all_ = _spans(F.col("_text"), rule, rank)
        if queries[rule.kind]:
            here = F.coalesce(F.array_contains("_kinds", rule.kind), F.lit(False))
            all_ = F.when(here, all_).otherwise(F.array().cast(SPAN))
        spans.append(all_)
    return met.select("row.*", F.array_sort(F.concat(*spans)).alias("secret_spans"))


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""

    def step(state, s):
        fresh = s["start"] >= state["at"]
        before = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.when(fresh, F.concat(state["out"], before, F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).cast("int").alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))),
        zero,
        step,
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def oracle_sql() -> str:
    """The registered query in DuckDB SQL: every pattern over every text."""

    def spans(rank: int, rule: Rule) -> str:
        # plain repeats instead of possessive ones
        p = "'" + rule.pattern.replace("'", "''").replace(r"\x20", " ").replace(r"\"", '"').replace("*+", "*").replace("++", "+") + "'"
        return f"""
        SELECT doc_id, row, {rank} AS rank, '{rule.kind}' AS kind,
               CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start_,
               hits[i] AS hit, checked[i] AS checked_
        FROM (SELECT doc_id, row, unnest(generate_series(1, len(hits))) AS i, parts, hits, checked FROM (
            SELECT doc_id, row, string_split_regex(t, {p}) AS parts, regexp_extract_all(t, {p}) AS hits,
                   regexp_extract_all(t, {p}, {rule.group}) AS checked
            FROM d WHERE regexp_matches(t, {p})))
        """

    each = " UNION ALL ".join(
        f"SELECT doc_id, row, rank, kind, start_, start_ + length(hit) AS end_ FROM ({spans(i, r)}) WHERE length(checked_) >= {r.least}"
        for i, r in enumerate(RULES)
    )
    word = "kind || ':' || start_ || ':' || end_"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
    s AS ({each}),
    g AS (
        SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
               count(*) FILTER (rank = 2) AS n_hex,
               string_agg({word}, ',' ORDER BY start_, rank) FILTER (rank < 3) AS base,
               string_agg({word}, ',' ORDER BY start_, rank) AS spans
        FROM s GROUP BY row)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (row)
    """
