"""Queries over endpoints: extraction results, cache, merging, coverage, relevance."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.page_queries import CRAWL_LIMITS, DISCOVERED
from checks.registry import query
from checks.views import endpoints, pages, records, table, view
from specloom import patterns as p
from specloom import schemas
from specloom.functions import jsontext as j
from specloom.functions import specs as sp
from specloom.functions.records import parse_endpoints
from specloom.operators import build, cache, coverage, discovery, extraction, merge, relevance
from specloom.plans.generate import generate_specs
from specloom.sources import tables
from specloom.workspace import materialize, new_folder

c = F.col

RANK = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, path, method
    ORDER BY {RANK} DESC, url, seq) AS rn FROM endpoints_raw) r WHERE rn = 1)"""
NORM_PATH = "CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END"


# -- merging ---------------------------------------------------------------------------------------


@query(
    "w1_dedup_endpoints",
    "endpoints_raw",
    sql=f"WITH {BEST} SELECT site, path, method, confidence, url, seq FROM best",
)
def dedup_endpoints(spark, folder):
    best = merge.dedup_endpoints(endpoints(spark, folder))
    return best.select("site", "path", "method", "confidence", "url", "seq")


UNIQUE = f"""{BEST}, named AS (SELECT *, {NORM_PATH} AS norm_path FROM best),
  placed AS (SELECT *,
    row_number() OVER (PARTITION BY site, norm_path, method ORDER BY url DESC, seq DESC) AS last_rn,
    min(url || '|' || lpad(CAST(seq AS VARCHAR), 12, '0')) OVER (PARTITION BY site, norm_path) AS place
    FROM named)"""


@query(
    "w2_resolve_path_collisions",
    "endpoints_raw",
    sql=f"WITH {UNIQUE} SELECT site, norm_path, method, seq, place FROM placed WHERE last_rn = 1",
)
def resolve_path_collisions(spark, folder):
    kept = merge.resolve_path_collisions(merge.dedup_endpoints(endpoints(spark, folder)))
    place = F.concat("path_order.url", F.lit("|"), F.lpad(c("path_order.seq").cast("string"), 12, "0"))
    return kept.select("site", "norm_path", "method", "seq", place.alias("place"))


PAGE_META = """metas AS (SELECT site, url, seq,
    CASE WHEN seq % 17 = 0 OR seq % 19 = 0 OR seq % 5 < 2 THEN NULL ELSE concat('T', seq % 1000) END AS title,
    CASE WHEN seq % 17 = 0 OR seq % 19 = 0 OR seq % 5 < 2 THEN NULL ELSE concat('D', seq % 7) END AS description
  FROM record_pages)"""


@query(
    "w3_first_non_empty_metadata",
    "record_pages",
    sql=f"""WITH {PAGE_META} SELECT site, arg_min(title, url) FILTER (WHERE title IS NOT NULL) AS api_title,
  arg_min(description, url) FILTER (WHERE description IS NOT NULL) AS api_description
FROM metas GROUP BY site""",
)
def first_non_empty_metadata(spark, folder):
    results = extraction.parse_records(records(spark, folder))
    return merge.first_non_empty_metadata(results).select("site", "api_title", "api_description")


VALID = "seq % 17 <> 0 AND seq % 19 <> 0"


@query(
    "w4_number_security_schemes",
    "record_pages",
    sql=f"""SELECT site, url, concat('security_', row_number() OVER (PARTITION BY site ORDER BY url)) AS scheme_name,
  CASE WHEN seq % 3 = 0 THEN 'http' ELSE 'apiKey' END AS type FROM record_pages WHERE {VALID}""",
)
def number_security_schemes(spark, folder):
    results = materialize(extraction.parse_records(records(spark, folder)), "results")
    numbered = merge.number_security_schemes(merge.flatten_security_schemes(results))
    return numbered.select("site", "url", "scheme_name", "type")


@query(
    "w5_last_response_per_status",
    "endpoints_raw",
    sql="""WITH given AS (SELECT seq, 1 AS pos, 200 + seq % 2 AS code, 'first' AS txt FROM endpoints_raw
    UNION ALL SELECT seq, 2, 200 + (seq // 2) % 2, 'second' FROM endpoints_raw
    UNION ALL SELECT seq, 3, 200 + seq % 3, 'third' FROM endpoints_raw),
  kept AS (SELECT seq, code, min(pos) AS pos, arg_max(txt, pos) AS txt FROM given GROUP BY seq, code)
SELECT seq, string_agg(concat(code, '=', txt), ',' ORDER BY pos) AS responses FROM kept GROUP BY seq""",
)
def last_response_per_status(spark, folder):
    seq = c("seq")
    codes = (seq % 2, F.floor(seq / 2) % 2, seq % 3)
    given = [
        F.struct((200 + code).cast("string"), F.lit(text), F.lit("a/b"), F.lit(None), F.lit(None))
        for code, text in zip(codes, ("first", "second", "third"))
    ]
    responses = F.array(*given).cast(f"array<{schemas.RESPONSE}>")
    kept = F.transform(
        merge.last_response_per_status(responses),
        lambda r: F.concat(r["status_code"], F.lit("="), r["description"]),
    )
    rows = view(spark, folder, "endpoints_raw")
    return rows.select("seq", F.array_join(kept, ",").alias("responses"))


@query(
    "e13_operation_id",
    "endpoints_raw",
    sql="""SELECT seq, lower(concat(method, '_', regexp_replace(regexp_replace(
  regexp_replace(path, '^/+|/+$', '', 'g'), '\\{.*?\\}', 'by_id', 'g'), '[^a-zA-Z0-9]+', '_', 'g'))) AS operation_id
FROM endpoints_raw""",
)
def operation_id(spark, folder):
    rows = view(spark, folder, "endpoints_raw")
    return rows.select("seq", merge.operation_id(c("method"), c("path")).alias("operation_id"))


@query(
    "e14_normalize_path",
    "endpoints_raw",
    sql=f"SELECT seq, {NORM_PATH} AS norm_path FROM endpoints_raw",
)
def normalize_path(spark, folder):
    rows = view(spark, folder, "endpoints_raw")
    return rows.select("seq", merge.normalize_path(c("path")).alias("norm_path"))


@query(
    "a10_distinct_tags",
    "endpoints_raw",
    sql=f"WITH {BEST} SELECT DISTINCT site, tag FROM best WHERE tag IS NOT NULL",
)
def distinct_tags(spark, folder):
    return merge.distinct_tags(merge.dedup_endpoints(endpoints(spark, folder)))


@query(
    "a13_path_count",
    "endpoints_raw",
    sql=f"SELECT site, count(DISTINCT {NORM_PATH}) AS path_count FROM endpoints_raw GROUP BY site",
)
def path_count(spark, folder):
    return merge.path_count(endpoints(spark, folder))


@query(
    "a14_total_endpoints",
    "record_pages",
    sql=f"""SELECT site, CAST(sum(CASE WHEN {VALID} THEN 2 ELSE 0 END) AS BIGINT) AS total_endpoints
FROM record_pages GROUP BY site""",
)
def total_endpoints(spark, folder):
    return merge.total_endpoints(extraction.parse_records(records(spark, folder)))


@query(
    "u2_concat_results",
    "record_pages",
    "spec_docs",
    sql=f"""SELECT method, count(*) AS n FROM (
  SELECT method FROM record_pages JOIN endpoints_raw USING (seq) WHERE {VALID}
  UNION ALL SELECT 'get' FROM record_pages WHERE {VALID}
  UNION ALL SELECT method FROM endpoints_raw WHERE seq % 13 <> 0
  UNION ALL SELECT 'put' FROM endpoints_raw WHERE seq % 13 <> 0) m GROUP BY method""",
)
def concat_results(spark, folder):
    recorded = extraction.parse_records(records(spark, folder, early=True)).select("site", "url", "endpoints")
    specs = view(spark, folder, "spec_docs", early=True).select(
        F.lit("specs").alias("site"),
        c("spec_id").cast("string").alias("url"),
        j.canonical(c("spec_json")).alias("spec"),
    )
    found = sp.spec_endpoints(c("spec"), c("url"))
    embedded = specs.select("site", "url", found.alias("endpoints"))
    rows = merge.flatten_endpoints(merge.concat_results(recorded, embedded))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


# -- coverage --------------------------------------------------------------------------------------

EXAMPLE = "has_example AND (has_params OR has_body OR has_responses)"
COUNTS = f"""counts AS (SELECT site, count(*) AS total_endpoints,
    count(*) FILTER (WHERE has_params) AS endpoints_with_parameters,
    count(*) FILTER (WHERE has_body) AS endpoints_with_request_body,
    count(*) FILTER (WHERE has_responses) AS endpoints_with_responses,
    count(*) FILTER (WHERE {EXAMPLE}) AS endpoints_with_examples,
    count(*) FILTER (WHERE confidence = 'high') AS confidence_high,
    count(*) FILTER (WHERE confidence = 'medium') AS confidence_medium,
    count(*) FILTER (WHERE confidence = 'low') AS confidence_low FROM endpoints_raw GROUP BY site),
  scored AS (SELECT *, (confidence_high + 0.6::DOUBLE * confidence_medium + 0.3::DOUBLE * confidence_low)
    / total_endpoints AS average_confidence FROM counts)"""


@query("a1_coverage_report", "endpoints_raw", sql=f"WITH {COUNTS} SELECT * FROM counts")
def coverage_report(spark, folder):
    report = coverage.coverage_report(endpoints(spark, folder))
    return report.drop("average_confidence", "parameter_coverage", "response_coverage", "quality_score")


@query(
    "a2_parameter_response_coverage",
    "endpoints_raw",
    sql=f"""WITH {COUNTS} SELECT site,
  round(100.0::DOUBLE * endpoints_with_parameters / total_endpoints, 6) AS parameter_coverage,
  round(100.0::DOUBLE * endpoints_with_responses / total_endpoints, 6) AS response_coverage FROM counts""",
)
def parameter_response_coverage(spark, folder):
    report = coverage.coverage_report(endpoints(spark, folder))
    return report.select(
        "site",
        F.round("parameter_coverage", 6).alias("parameter_coverage"),
        F.round("response_coverage", 6).alias("response_coverage"),
    )


@query(
    "a3_quality_score",
    "endpoints_raw",
    sql=f"""WITH {COUNTS} SELECT site, round(average_confidence, 6) AS average_confidence,
  round(100 * (0.25::DOUBLE * endpoints_with_parameters / total_endpoints
    + 0.20::DOUBLE * endpoints_with_request_body / total_endpoints
    + 0.30::DOUBLE * endpoints_with_responses / total_endpoints
    + 0.15::DOUBLE * endpoints_with_examples / total_endpoints
    + 0.10::DOUBLE * average_confidence), 6) AS quality_score FROM scored""",
)
def quality_score(spark, folder):
    report = coverage.coverage_report(endpoints(spark, folder))
    return report.select(
        "site",
        F.round("average_confidence", 6).alias("average_confidence"),
        F.round("quality_score", 6).alias("quality_score"),
    )


@query(
    "a4_page_confidence",
    "record_pages",
    sql=f"""SELECT url, CASE WHEN NOT ({VALID}) THEN 'low' WHEN seq % 11 < 3 THEN 'high' ELSE 'medium' END
  AS confidence FROM record_pages""",
)
def page_confidence(spark, folder):
    return extraction.parse_records(records(spark, folder)).select("url", "confidence")


@query(
    "a11_run_summary",
    "record_pages",
    sql=f"""SELECT r.site, sum(CASE WHEN {VALID} THEN 1 ELSE 0 END) > 0 AS success, count(*) AS doc_urls,
  CAST(sum(CASE WHEN {VALID} THEN 2 ELSE 0 END) AS BIGINT) AS endpoints FROM record_pages r GROUP BY r.site""",
)
def run_summary(spark, folder):
    results = materialize(extraction.parse_records(records(spark, folder)).select("site", "url", "endpoints"), "results")
    report = coverage.coverage_report(merge.flatten_endpoints(results), results)
    return coverage.run_summary(results, results, report).drop("quality")


# -- relevance -------------------------------------------------------------------------------------

QUERY = "payment reports and user admin"
WORDS = [*sorted(relevance.query_keywords(QUERY))]
LISTED = ", ".join(f"'{w}'" for w in WORDS)
SCORED = f"""scored AS (SELECT *, CASE WHEN list_has_any([true], list_transform([{LISTED}], lambda k: contains(lower(path), k)))
      THEN least(1.0, share + 0.2) ELSE share END AS score
    FROM (SELECT *, CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(concat_ws(' ', path, summary,
      coalesce(description, ''), coalesce(tag, ''))), '[\\p{{L}}\\p{{N}}_]+')), [{LISTED}])) AS DOUBLE) / {len(WORDS)} AS share
      FROM endpoints_raw) s)"""


@query(
    "e12_relevance",
    "endpoints_raw",
    sql=f"WITH {SCORED} SELECT seq, round(CAST(score AS DOUBLE), 9) AS score FROM scored",
)
def relevance_scores(spark, folder):
    scored = relevance.score_endpoints(endpoints(spark, folder), QUERY)
    return scored.select("seq", F.round("score", 9).alias("score"))


LOW = 0.15


@query(
    "f6_relevance_threshold",
    "endpoints_raw",
    sql=f"WITH {SCORED} SELECT seq, round(CAST(score AS DOUBLE), 9) AS score FROM scored WHERE score >= {LOW}",
)
def relevance_threshold(spark, folder):
    kept = relevance.filter_endpoints(endpoints(spark, folder), QUERY, LOW)
    return kept.select("seq", F.round("score", 9).alias("score"))


@query(
    "t1_rank_endpoints",
    "endpoints_raw",
    sql=f"""WITH {SCORED} SELECT site, seq, round(CAST(score AS DOUBLE), 9) AS score FROM scored
WHERE score >= {LOW} ORDER BY score DESC, site, url, seq""",
)
def rank_endpoints(spark, folder):
    kept = relevance.filter_endpoints(endpoints(spark, folder), QUERY, LOW)
    return relevance.rank_endpoints(kept).select("site", "seq", F.round("score", 9).alias("score"))


TOP = f"""{SCORED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site
    ORDER BY score DESC, url, seq) AS rnk FROM scored WHERE score >= {LOW}) r WHERE rnk <= 5)"""


@query(
    "t2_top_matches",
    "endpoints_raw",
    sql=f"WITH {TOP} SELECT site, CAST(rnk AS INTEGER) AS rank, seq FROM top",
)
def top_matches(spark, folder):
    kept = relevance.filter_endpoints(endpoints(spark, folder), QUERY, LOW)
    return relevance.top_matches(kept).select("site", "rank", "seq")


@query(
    "a8_filter_summary",
    "endpoints_raw",
    sql=f"""WITH {TOP}, listed AS (SELECT site, string_agg(concat(path, ' ', method, ' ', summary), ';' ORDER BY rnk)
    AS top_matches FROM top GROUP BY site)
SELECT s.site, count(*) AS original_count, count(*) FILTER (WHERE score >= {LOW}) AS filtered_count,
  round(coalesce(avg(CAST(score AS DOUBLE)) FILTER (WHERE score >= {LOW}), 0), 6) AS average_score,
  round(CAST(coalesce(max(score) FILTER (WHERE score >= {LOW}), 0) AS DOUBLE), 6) AS max_score,
  round(CAST(coalesce(min(score) FILTER (WHERE score >= {LOW}), 0) AS DOUBLE), 6) AS min_score,
  coalesce(any_value(top_matches), '') AS top_matches
FROM scored s LEFT JOIN listed ON s.site = listed.site GROUP BY s.site""",
)
def filter_summary(spark, folder):
    summary = relevance.filter_summary(endpoints(spark, folder), QUERY, LOW)
    matches = F.transform(
        "top_matches", lambda m: F.concat_ws(" ", m["path"], m["method"], m["summary"])
    )
    return summary.select(
        "site",
        "original_count",
        "filtered_count",
        *[F.round(n, 6).alias(n) for n in ("average_score", "max_score", "min_score")],
        F.array_join(matches, ";").alias("top_matches"),
    )


# -- records ---------------------------------------------------------------------------------------


@query(
    "f5_drop_empty_results",
    "record_pages",
    sql=f"SELECT url, 2 AS n_endpoints, 1 AS n_schemes FROM record_pages WHERE {VALID}",
)
def drop_empty_results(spark, folder):
    parsed = materialize(extraction.parse_records(records(spark, folder)), "results")
    return extraction.drop_empty_results(parsed).select(
        "url",
        F.size("endpoints").alias("n_endpoints"),
        F.size("security_schemes").alias("n_schemes"),
    )


@query(
    "x4_explode_records",
    "record_pages",
    "endpoints_raw",
    sql="""SELECT r.url, 0 AS seq, e.path, e.method, e.summary, e.confidence,
  CASE WHEN has_params THEN 'id/path/integer/true/7' ELSE '' END AS parameters,
  CASE WHEN has_body THEN 'b/application/json' END AS body,
  CASE WHEN has_responses THEN '200:ok:"e",404:no:-' ELSE '' END AS responses
FROM record_pages r JOIN endpoints_raw e USING (seq) WHERE seq % 17 <> 0
UNION ALL SELECT url, CASE WHEN seq % 17 = 0 THEN 0 ELSE 1 END, '/status', 'get', 'x', 'high', '', NULL, ''
FROM record_pages WHERE seq % 19 <> 0""",
)
def explode_records(spark, folder):
    results = extraction.parse_records(records(spark, folder), on_error="row")
    parameters = F.transform(
        "parameters",
        lambda q: F.concat_ws(
            "/", q["name"], q["location"], q["type"], q["required"].cast("string"), q["example"]
        ),
    )
    responses = F.transform(
        "responses",
        lambda r: F.concat_ws(
            ":", r["status_code"], r["description"], F.coalesce(r["example"], F.lit("-"))
        ),
    )
    body = F.concat(c("request_body.description"), F.lit("/"), c("request_body.content_type"))
    return merge.flatten_endpoints(results).select(
        "url", "seq", "path", "method", "summary", "confidence",
        F.array_join(parameters, ",").alias("parameters"),
        body.alias("body"),
        F.array_join(responses, ",").alias("responses"),
    )


@query(
    "x5_schema_from_properties",
    "record_pages",
    "endpoints_raw",
    sql="""SELECT url, CASE WHEN has_body THEN 'object|b|{"a":{"type":"string"}}' END AS body_schema,
  CASE WHEN has_responses THEN 'none,object|no|{"m":1}' ELSE '' END AS response_schemas
FROM record_pages JOIN (SELECT seq, has_body, has_responses FROM endpoints_raw) e USING (seq)""",
)
def schema_from_properties(spark, folder):
    def shown(schema):
        return F.concat(schema["type"], F.lit("|"), schema["description"], F.lit("|"), schema["properties"])

    parsed = parse_endpoints(c("records"), c("url"))
    first = records(spark, folder).select("url", F.get(parsed, F.lit(0))["endpoint"].alias("e"))
    listed = F.transform("e.responses", lambda r: F.coalesce(shown(r["schema"]), F.lit("none")))
    return first.select(
        "url",
        shown(c("e.request_body.schema")).alias("body_schema"),
        F.array_join(listed, ",").alias("response_schemas"),
    )


# -- cache -----------------------------------------------------------------------------------------


@query(
    "s7_read_cache",
    "cache_rows",
    sql="""SELECT kind, content_hash, payload FROM (SELECT *, row_number() OVER (PARTITION BY kind, content_hash
  ORDER BY created_at DESC, payload DESC) AS rn FROM cache_rows) r WHERE rn = 1""",
)
def read_cache(spark, folder):
    """Entries written in two runs, compacted, written to once more and read back, both kinds."""
    rows, path = view(spark, folder, "cache_rows"), new_folder(spark, "cache")
    for third in range(3):
        tables.write_cache(rows.filter(c("cache_id") % 3 == third), path)
        if third == 1:
            tables.compact_cache(spark, path)
    found = tables.read_cache(spark, path)
    kinds = [cache.newest_entries(found, kind).withColumn("kind", F.lit(kind)) for kind in ("llm", "http")]
    return kinds[0].unionByName(kinds[1]).select("kind", "content_hash", "payload")


@query(
    "j1_cache_lookup",
    "cache_rows",
    sql="""WITH fresh AS (SELECT content_hash, payload FROM (SELECT *, row_number() OVER (PARTITION BY content_hash
    ORDER BY created_at DESC, payload DESC) AS rn FROM cache_rows
    WHERE kind = 'llm' AND created_at >= TIMESTAMP '2024-01-30 00:00:00') r WHERE rn = 1)
SELECT doc_id, payload FROM @documents d LEFT JOIN fresh f ON md5(concat('doc-',
  CASE WHEN d.doc_id % 3 = 0 THEN 7 ELSE d.doc_id % 200 END)) = f.content_hash""",
)
def cache_lookup(spark, folder):
    key = F.when(c("doc_id") % 3 == 0, 7).otherwise(c("doc_id") % 200)
    documents = table(spark, folder, "documents").select(
        "doc_id", F.md5(F.concat(F.lit("doc-"), key)).alias("content_hash")
    )
    entries = view(spark, folder, "cache_rows")
    now = F.lit("2024-01-31 00:00:00").cast(entries.schema["created_at"].dataType)
    found = cache.cache_lookup(documents, entries, now, 86400, spread=["doc_id"])
    return found.select("doc_id", "payload")


@query(
    "a9_cache_stats",
    "cache_rows",
    sql="""SELECT count(*) FILTER (WHERE kind = 'http') AS http_cache_count,
  count(*) FILTER (WHERE kind = 'llm') AS llm_cache_count,
  CAST(sum(strlen(payload)) FILTER (WHERE kind = 'http') AS DOUBLE) / 1048576 AS http_cache_size_mb,
  CAST(sum(strlen(payload)) FILTER (WHERE kind = 'llm') AS DOUBLE) / 1048576 AS llm_cache_size_mb,
  CAST(sum(strlen(payload)) AS DOUBLE) / 1048576 AS total_size_mb,
  CAST(24 AS DOUBLE) AS cache_ttl_hours FROM cache_rows""",
)
def cache_stats(spark, folder):
    return cache.cache_stats(view(spark, folder, "cache_rows"))


# -- extraction function and the whole run ---------------------------------------------------------


def find_operations(document):
    """The extraction function of the checks: METHOD /path wherever it is written."""
    for method, path in re.findall(r"\b(GET|POST|PUT|DELETE|PATCH) (/\S*)", document["text"]):
        yield "record_endpoint", {"path": path, "method": method.lower(), "summary": "found"}


def one_per_page(document):
    yield "record_endpoint", {
        "path": "/page", "method": "get", "summary": document["title"], "confidence": "high",
    }


def faulty(document):
    for path in ("/{id}", "/a-b", "/a_b"):
        yield "record_endpoint", {"path": path, "method": "get", "summary": document["title"]}
    yield "record_security_scheme", {"type": "oauth2"}


@query(
    "p1_extract_with",
    "endpoints_raw",
    sql=f"SELECT seq, {NORM_PATH} AS path, method FROM endpoints_raw",
)
def extract_with(spark, folder):
    text = F.concat(F.lit("Call "), F.upper("method"), F.lit(" "), merge.normalize_path(c("path")))
    documents = view(spark, folder, "endpoints_raw").select("site", "url", "seq", text.alias("text"))
    results = extraction.parse_records(extraction.extract_with(documents, find_operations))
    rows = results.select("seq", F.explode("endpoints").alias("e"))
    return rows.select("seq", "e.path", "e.method")


def generated(spark, folder, **options):
    crawl_pages = pages(spark, folder, "crawl_pages")
    return generate_specs(
        crawl_pages, one_per_page, crawl_below=p.CRAWL_IF_FEWER_THAN, **CRAWL_LIMITS, **options
    )


GENERATED = f"""WITH {DISCOVERED} SELECT site, count(*) AS total_endpoints, count(*) AS confidence_high,
  10.0::DOUBLE AS quality_score, 1::BIGINT AS paths_count, true AS success FROM discovered GROUP BY site"""


@query("p2_generate_specs", "crawl_pages", sql=GENERATED)
def generate(spark, folder):
    return report(generated(spark, folder))


@query("p2_generate_all", "crawl_pages", sql=GENERATED)
def generate_all(spark, folder):
    """Without any limit of the crawl; the planted sites are small enough for the limits not to matter."""
    found = pages(spark, folder, "crawl_pages")
    return report(generate_specs(found, one_per_page, crawl_below=p.CRAWL_IF_FEWER_THAN))


@query(
    "p2_verdicts",
    "crawl_pages",
    sql=f"""WITH {DISCOVERED} SELECT site, false AS is_valid, 2 + count(*) AS n_errors,
  'operation_id_unique,path_parameters_declared,security_scheme_fields' AS rules, 3::BIGINT AS paths_count
FROM discovered GROUP BY site""",
)
def verdicts(spark, folder):
    """Of each site: a placeholder without parameter, an id for two paths, a scheme without flows per page."""
    run = generate_specs(
        pages(spark, folder, "crawl_pages"), faulty, crawl_below=p.CRAWL_IF_FEWER_THAN, **CRAWL_LIMITS
    )
    return run.verdicts.select("site", "is_valid", "n_errors", F.array_join("rules", ",").alias("rules"), "paths_count")


@query("p2_generate_in_parts", "crawl_pages", sql=GENERATED)
def generate_in_parts(spark, folder):
    """The same with every description in parts, as those are that one value should not hold."""
    return report(generated(spark, folder, max_bytes=100))


def report(run):
    counted = run.verdicts.select("site", "paths_count")
    summary = run.summary.select("site", "success")
    report = run.coverage.select(
        "site", "total_endpoints", "confidence_high", F.round("quality_score", 6).alias("quality_score")
    )
    return report.join(counted, "site").join(summary, "site")
