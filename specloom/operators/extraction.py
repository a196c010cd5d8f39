"""From documents to page results: embedded descriptions, cache, extraction function."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom import patterns as p
from specloom import schemas
from specloom.functions import auth, records
from specloom.functions import text as t
from specloom.functions.html import slices
from specloom.functions.specs import spec_endpoints
from specloom.operators.cache import fixed_time, is_fresh, newest_entries
from specloom.operators.skew import salted_join
from specloom.operators.specs import find_embedded_spec
from specloom.workspace import materialize

Extractor = Callable[[dict], Iterable[tuple[str, dict]]]

RESULT_FIELDS = (
    "endpoints",
    "security_schemes",
    "api_title",
    "api_description",
    "base_url",
    "confidence",
)
NO_ENDPOINTS = f"ARRAY<{schemas.ENDPOINT}>"
NO_SCHEMES = f"ARRAY<{schemas.SECURITY_SCHEME}>"


def _empty(type_: str) -> Column:
    return F.array().cast(type_)


def with_prompt(documents: DataFrame) -> DataFrame:
    """Add the ``prompt``: what an extraction function may show to a model."""
    return documents.withColumn(
        "prompt",
        t.document_prompt(F.col("url"), F.col("title"), F.col("text"), F.col("code_samples")),
    )


def extract_with(documents: DataFrame, fn: Extractor) -> DataFrame:
    """Run ``fn`` on every document; add its ``records`` and the ``error`` of a failed call.

    ``fn`` gets a document as a dict and returns (record name, fields) pairs. It runs inside the
    tasks on Arrow batches; a failure concerns its own page only.
    """
    schema = documents.select(
        "*",
        F.lit(None).cast(schemas.TOOL_RECORDS).alias("records"),
        F.lit(None).cast("string").alias("error"),
    ).schema
    record_type = pa.list_(pa.struct([("name", pa.string()), ("input", pa.string())]))

    def call(document):
        try:
            found = [{"name": n, "input": json.dumps(v)} for n, v in fn(document)]
            return found, None
        except Exception as error:  # noqa: BLE001 - whatever a user function raises
            return None, f"{type(error).__name__}: {error}"

    def convert(batches):
        for batch in slices(batches):
            results = [call(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([found for found, _ in results], record_type),
                    pa.array([error for _, error in results], pa.string()),
                ],
                names=[*batch.schema.names, "records", "error"],
            )

    return documents.mapInArrow(convert, schema)


def parse_records(extracted: DataFrame, on_error: str = "page") -> DataFrame:
    """Typed page results out of ``records``; all of it inside the row.

    One invalid record empties its whole page (confidence low); ``on_error="row"`` drops only that
    record.
    """
    if on_error not in ("page", "row"):
        raise ValueError(f"on_error must be 'page' or 'row', not {on_error!r}")
    given = F.col("records")
    parsed = extracted.select(
        "*",
        records.parse_endpoints(given, F.col("url")).alias("_e"),
        records.parse_security_schemes(given).alias("_s"),
        records.last_metadata(given).alias("_m"),
    )
    valid = (
        F.forall("_e", lambda e: e["ok"])
        & F.forall("_s", lambda e: e["ok"])
        & F.coalesce(F.col("_m.ok"), F.lit(True))
    )
    # No records at all (the function failed) is a failed page in both modes.
    ok = F.coalesce(valid, F.lit(False)) if on_error == "page" else given.isNotNull()
    meta_ok = ok & F.coalesce(F.col("_m.ok"), F.lit(False))

    def kept(array, field, nothing):
        values = F.transform(F.filter(array, lambda e: e["ok"]), lambda e: e[field])
        return F.when(ok, values).otherwise(_empty(nothing))

    invalid = F.when(~ok, F.coalesce("error", F.lit("invalid record")))
    typed = parsed.select(
        *[c for c in extracted.columns if c not in ("records", "error")],
        kept("_e", "endpoint", NO_ENDPOINTS).alias("endpoints"),
        kept("_s", "scheme", NO_SCHEMES).alias("security_schemes"),
        F.when(meta_ok, F.col("_m.title")).alias("api_title"),
        F.when(meta_ok, F.col("_m.description")).alias("api_description"),
        F.when(meta_ok, F.col("_m.base_url")).alias("base_url"),
        invalid.alias("error"),
    )
    return typed.withColumn("confidence", records.page_confidence(F.col("endpoints")))


def add_detected_schemes(results: DataFrame, text: Column) -> DataFrame:
    """Add the authentication schemes a text describes to those already found on the page."""
    merged = auth.merge_security_schemes(
        F.col("security_schemes"), auth.detect_auth_schemes(text)
    )
    return results.withColumn(
        "security_schemes",
        F.when(F.col("error").isNull(), merged).otherwise(F.col("security_schemes")),
    )


def drop_empty_results(results: DataFrame) -> DataFrame:
    """Drop pages without endpoints, together with their schemes and metadata."""
    return results.filter(F.size("endpoints") > 0)


def result_payload() -> Column:
    """A page result as the JSON text kept in the cache."""
    return F.to_json(F.struct(*RESULT_FIELDS))


def from_payload(frame: DataFrame, column: str = "payload") -> DataFrame:
    """Replace a payload by the page result fields."""
    rest = [c for c in frame.columns if c != column]
    parsed = frame.select(*rest, F.from_json(column, schemas.PAGE_RESULT).alias("_r"))
    return parsed.select(*rest, *[F.col(f"_r.{f}").alias(f) for f in RESULT_FIELDS])


def with_embedded_endpoints(documents: DataFrame, carry_body: bool = False) -> DataFrame:
    """Add ``embedded_endpoints``: those of a description the page is or shows, else none."""
    found = spec_endpoints(F.col("embedded_spec"), F.col("url"), carry_body)
    return (
        find_embedded_spec(documents)
        .withColumn("embedded_endpoints", F.coalesce(found, _empty(NO_ENDPOINTS)))
        .drop("embedded_spec")
    )


def extract_results(
    documents: DataFrame,
    fn: Extractor,
    cache: DataFrame | None = None,
    now: Column | None = None,
    ttl_seconds: int = p.CACHE_TTL_SECONDS,
    on_error: str = "page",
    carry_body: bool = False,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Page results (empty pages dropped) and the new cache entries.

    The cheap way first: a page with an embedded description never reaches ``fn``; of pages with
    equal content only the first does, unless the cache has a fresh answer. Results then go back to
    all pages with that content, salted, since one text may be a large share of all pages.
    Documents that come with ``embedded_endpoints`` are taken as a written table.
    """
    now = fixed_time(documents.sparkSession, now)
    table = documents
    if "embedded_endpoints" not in documents.columns:
        table = materialize(with_embedded_endpoints(documents, carry_body), "documents")
    table = table.withColumnRenamed("embedded_endpoints", "endpoints")
    has_spec = F.size("endpoints") > 0
    of_specs = table.filter(has_spec).select(
        "site",
        "url",
        F.lit("embedded").alias("origin"),
        "endpoints",
        _empty(NO_SCHEMES).alias("security_schemes"),
        *[F.lit(None).cast("string").alias(f) for f in RESULT_FIELDS[2:5]],
        F.lit("high").alias("confidence"),
    )

    keys = table.filter(~has_spec).select("site", "url", "content_hash")
    first = (
        keys.groupBy("content_hash")
        .agg(F.min(F.struct("site", "url")).alias("page"))
        .select("content_hash", "page.*")
    )
    if cache is None:
        cache = documents.sparkSession.createDataFrame([], schemas.CACHE)
    fresh = newest_entries(cache.filter(is_fresh(F.col("created_at"), now, ttl_seconds)), "llm")
    # One row per content on both sides: nothing here can be skewed. Hits and misses come from one
    # written look-up, so that a content is one of them whatever the time and the cache do meanwhile.
    looked_up = materialize(first.join(fresh.select("content_hash", "payload", F.lit(True).alias("hit")), "content_hash", "left"), "looked-up")
    misses = looked_up.filter("hit IS NULL")
    todo = table.select("site", "url", "title", "text", "code_samples", "content_hash").join(
        misses.select("site", "url"), ["site", "url"], "left_semi"
    )
    if partitions:
        todo = todo.repartition(partitions, "content_hash")
    parsed = parse_records(extract_with(with_prompt(todo), fn), on_error)
    whole = t.whole_document(F.col("url"), F.col("title"), F.col("text"), F.col("code_samples"))
    answered = materialize(
        add_detected_schemes(parsed, whole).select(
            "content_hash", result_payload().alias("payload"), "error"
        ),
        "extracted",
    )
    known = answered.select("content_hash", "payload", F.lit("extracted").alias("origin"))
    hits = looked_up.filter("hit").select(
        "content_hash", "payload", F.lit("cache").alias("origin")
    )
    of_texts = from_payload(
        salted_join(keys, known.unionByName(hits), ["content_hash"], ["site", "url"], "inner")
    ).select(*of_specs.columns)
    updates = answered.filter(F.col("error").isNull()).select(
        "content_hash", F.lit("llm").alias("kind"), now.alias("created_at"), "payload"
    )
    return drop_empty_results(of_specs.unionByName(of_texts)), updates
