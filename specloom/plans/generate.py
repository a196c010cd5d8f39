"""From crawled pages to descriptions and reports, for all sites at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from specloom import patterns as p
from specloom.operators.build import (
    MAX_DOCUMENT_BYTES,
    build_filtered_specs,
    build_specs,
    no_schemes,
    unique_operations,
)
from specloom.operators.content import extract_content, with_needs_render
from specloom.operators.coverage import coverage_report, run_summary
from specloom.operators.discovery import discover, newest_pages, select_pages_by_url
from specloom.operators.extraction import Extractor, extract_results, with_embedded_endpoints
from specloom.operators.merge import flatten_endpoints, flatten_security_schemes
from specloom.operators.relevance import filter_endpoints
from specloom.operators.specs import operation_rows, recommendations_of, verdicts_of, violations_of
from specloom.workspace import materialize


@dataclass(frozen=True)
class Generated:
    """Tables of one run, all keyed by site. Reports come from rows, never from a whole description."""

    specs: DataFrame
    coverage: DataFrame
    violations: DataFrame
    verdicts: DataFrame
    recommendations: DataFrame
    summary: DataFrame
    results: DataFrame
    documents: DataFrame
    cache_updates: DataFrame


def generate_specs(
    pages: DataFrame,
    fn: Extractor,
    doc_urls: DataFrame | Sequence[str] | str | None = None,
    query: str | None = None,
    threshold: float = p.RELEVANCE_THRESHOLD,
    cache: DataFrame | None = None,
    now: Column | None = None,
    ttl_seconds: int = p.CACHE_TTL_SECONDS,
    on_error: str = "page",
    carry_body: bool = False,
    partitions: int | None = None,
    max_bytes: int = MAX_DOCUMENT_BYTES,
    **crawl_limits,
) -> Generated:
    """Discover, extract, merge, build and report.

    ``doc_urls`` replaces discovery; of a page that was fetched more than once the newest row counts.
    ``query`` filters endpoints before anything is built or
    counted. Documents and page results are each written once to the shared folder; everything else
    derives from them.
    """
    urls = discover(pages, **crawl_limits) if doc_urls is None else doc_urls
    documents = with_needs_render(extract_content(newest_pages(select_pages_by_url(pages, urls))))
    documents = materialize(with_embedded_endpoints(documents, carry_body), "documents")
    results, updates = extract_results(
        documents, fn, cache, now, ttl_seconds, on_error, carry_body, partitions
    )
    results = materialize(results, "results")
    endpoints = flatten_endpoints(results)
    # Sites without a single endpoint get no description.
    sites = results.select("site").distinct()
    if query is None:
        schemes = flatten_security_schemes(results)
        operations = materialize(unique_operations(endpoints), "operations")
        specs = build_specs(sites, results, endpoints, schemes, operations, max_bytes=max_bytes)
    else:
        schemes = no_schemes(pages.sparkSession)
        endpoints = filter_endpoints(endpoints, query, threshold)
        operations = materialize(unique_operations(endpoints), "operations")
        specs = build_filtered_specs(sites, endpoints, operations, max_bytes=max_bytes)
    rows = operation_rows(sites, operations, schemes)
    violations = materialize(violations_of(rows, "site"), "violations")
    coverage = coverage_report(endpoints, sites)
    return Generated(
        specs=materialize(specs, "specs"),
        coverage=coverage,
        violations=violations,
        verdicts=verdicts_of(rows, violations, "site"),
        recommendations=recommendations_of(rows, "site"),
        summary=run_summary(pages, documents, coverage),
        results=results,
        documents=documents,
        cache_updates=updates,
    )
