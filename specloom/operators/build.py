"""Assembling one API description per site.

A description is built as ordered lines, each a piece of its JSON text. No operator gathers a whole
site: only the operations of one path, a bounded run of lines, and documents below a size limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import jsontext as j
from specloom.functions.urls import netloc, normalize_base_url, site_file_name
from specloom.operators.merge import (
    dedup_endpoints,
    distinct_tags,
    first_non_empty_metadata,
    last_response_per_status,
    operation_id,
    resolve_path_collisions,
)
from specloom.operators.skew import with_positions
from specloom.workspace import broadcast_if_small, materialize

OPENAPI_VERSION = "3.0.3"
API_VERSION = "1.0.0"
SERVER_DESCRIPTION = "API server"
DEFAULT_RESPONSES = (
    '{"200":{"description":"Successful response","content":{"application/json":'
    '{"schema":{"type":"object"}}}}}'
)
OBJECT_SCHEMA = '{"type":"object"}'

MAX_DOCUMENT_BYTES = 64 * 1024 * 1024
LINES_PER_CHUNK = 20_000

ORDER = ("rank_key", "url", "seq")


# -- parts, as JSON text --------------------------------------------------------------------------


def build_info(site: Column, title: Column, description: Column) -> Column:
    named = F.coalesce(j.non_empty(title), F.concat(netloc(site), F.lit(" API")))
    told = F.coalesce(
        j.non_empty(description), F.concat(F.lit("API specification generated from "), site)
    )
    return j.obj(
        ("title", j.string(named)),
        ("version", j.string(F.lit(API_VERSION))),
        ("description", j.string(told)),
    )


def build_servers(site: Column, base_url: Column) -> Column:
    address = normalize_base_url(F.coalesce(j.non_empty(base_url), site))
    server = j.obj(
        ("url", j.string(address)), ("description", j.string(F.lit(SERVER_DESCRIPTION)))
    )
    return j.array(F.array(server))


def build_parameter(q: Column) -> Column:
    return j.obj(
        ("name", j.string(q["name"])),
        ("in", j.string(q["location"])),
        ("required", j.boolean(q["required"])),
        ("schema", j.obj(("type", j.string(q["type"])))),
        ("description", j.string(j.non_empty(q["description"]))),
        ("example", j.truthy(q["example"])),
    )


def build_schema(schema: Column) -> Column:
    """Members that are set; a missing schema is any object."""
    built = j.obj(
        ("type", j.string(schema["type"])),
        ("description", j.string(j.non_empty(schema["description"]))),
        ("properties", j.truthy(schema["properties"])),
        ("items", j.truthy(schema["items"])),
        ("required", j.truthy(F.to_json(schema["required"]))),
        ("example", j.truthy(schema["example"])),
        ("additionalProperties", j.boolean(schema["additional_properties"])),
    )
    return F.when(schema.isNull(), OBJECT_SCHEMA).otherwise(built)


def _content(holder: Column) -> Column:
    media = j.obj(
        ("schema", build_schema(holder["schema"])), ("example", j.truthy(holder["example"]))
    )
    return F.concat(F.lit("{"), j.string(holder["content_type"]), F.lit(":"), media, F.lit("}"))


def _request_body(body: Column) -> Column:
    built = j.obj(
        ("description", j.string(F.coalesce(body["description"], F.lit("")))),
        ("required", j.boolean(body["required"])),
        ("content", _content(body)),
    )
    return F.when(body.isNotNull(), built)


def _responses(responses: Column) -> Column:
    """Content only where there is a schema: an example alone is not written."""
    pairs = F.transform(
        last_response_per_status(responses),
        lambda r: F.struct(
            r["status_code"].alias("k"),
            j.obj(
                ("description", j.string(r["description"])),
                ("content", F.when(r["schema"].isNotNull(), _content(r))),
            ).alias("v"),
        ),
    )
    return F.when(F.size(responses) > 0, j.keyed(pairs)).otherwise(DEFAULT_RESPONSES)


def build_operation() -> Column:
    """The operation of an endpoint row."""
    c = F.col
    generated = operation_id(c("method"), c("path"))
    return j.obj(
        ("summary", j.string(j.non_empty(c("summary")))),
        ("description", j.string(j.non_empty(c("description")))),
        ("operationId", j.string(F.coalesce(j.non_empty(c("operation_id")), generated))),
        ("tags", F.when(F.size("tags") > 0, F.to_json("tags"))),
        (
            "parameters",
            F.when(F.size("parameters") > 0, j.array(F.transform("parameters", build_parameter))),
        ),
        ("requestBody", _request_body(c("request_body"))),
        ("responses", _responses(c("responses"))),
        ("deprecated", F.when(c("deprecated"), F.lit("true"))),
    )


def build_security_scheme() -> Column:
    """The scheme of a security scheme row."""
    c = F.col
    return j.obj(
        ("type", j.string(c("type"))),
        ("description", j.string(j.non_empty(c("description")))),
        ("name", j.string(j.non_empty(c("name")))),
        ("in", j.string(j.non_empty(c("location")))),
        ("scheme", j.string(j.non_empty(c("scheme")))),
        ("bearerFormat", j.string(j.non_empty(c("bearer_format")))),
    )


def build_tag(tag: Column) -> Column:
    return j.obj(
        ("name", j.string(tag)), ("description", j.string(F.concat(tag, F.lit(" endpoints"))))
    )


# -- tables ---------------------------------------------------------------------------------------


def _ordered(endpoints: DataFrame) -> DataFrame:
    """Rows with a score go by rank, the others by page."""
    key = -F.col("score") if "score" in endpoints.columns else F.lit(0.0)
    return endpoints.withColumn("rank_key", key)


def unique_operations(endpoints: DataFrame) -> DataFrame:
    """Deduplicated endpoints, one per (site, norm_path, method)."""
    best = dedup_endpoints(_ordered(endpoints), ORDER)
    return resolve_path_collisions(best, ORDER)


def build_paths(operations: DataFrame) -> DataFrame:
    """(site, norm_path, path_order, path_item): the operations of each path as JSON text."""
    entry = F.struct("method_order", F.col("method").alias("k"), build_operation().alias("v"))
    # One row per method at most.
    paths = operations.groupBy("site", "norm_path").agg(
        F.min("path_order").alias("path_order"), F.array_sort(F.collect_list(entry)).alias("_ops")
    )
    return paths.select(
        "site", "norm_path", "path_order", j.keyed(F.col("_ops")).alias("path_item")
    )


# Sections of a document, in order.
HEAD, PATHS, AFTER_PATHS, SCHEMES, AFTER_SCHEMES, TAGS, AFTER_TAGS, END = range(8)


def build_lines(
    sites: DataFrame, metadata: DataFrame, operations: DataFrame, schemes: DataFrame
) -> DataFrame:
    """(site, section, pos, text): concatenated in order, the documents of all sites.

    operations: those of ``unique_operations``, written.
    """
    tags = distinct_tags(operations)
    sites = sites.select("site").distinct()

    def rows(frame, section, body, *keys):
        rank, name, number = keys or (F.lit(0.0), F.lit(""), F.lit(0))
        return frame.select(
            "site",
            F.lit(section).alias("section"),
            rank.cast("double").alias("k1"),
            name.alias("k2"),
            number.cast("long").alias("k3"),
            body.alias("body"),
        )

    c, zero = F.col, F.lit(0.0)
    head = F.concat(
        F.lit(f'{{"openapi":"{OPENAPI_VERSION}","info":'),
        build_info(c("site"), c("api_title"), c("api_description")),
        F.lit(',"servers":'),
        build_servers(c("site"), c("base_url")),
        F.lit(',"paths":{'),
    )
    path = F.concat(j.string(c("norm_path")), F.lit(":"), c("path_item"))
    place = c("path_order")
    pieces = [
        rows(sites.join(metadata, "site", "left"), HEAD, head),
        rows(
            build_paths(operations), PATHS, path, place["rank_key"], place["url"], place["seq"]
        ),
        rows(sites, AFTER_PATHS, F.lit("}")),
        rows(schemes, SCHEMES, build_security_scheme(), zero, c("url"), c("seq")),
        rows(schemes.select("site").distinct(), AFTER_SCHEMES, F.lit("}}")),
        rows(tags, TAGS, build_tag(c("tag")), zero, c("tag"), F.lit(0)),
        rows(tags.select("site").distinct(), AFTER_TAGS, F.lit("]")),
        rows(sites, END, F.lit("}")),
    ]
    lines = pieces[0]
    for piece in pieces[1:]:
        lines = lines.unionByName(piece)
    placed = with_positions(materialize(lines, "pieces"), ["site", "section"], ["k1", "k2", "k3"])
    first, section = c("pos") == 1, c("section")
    scheme = F.concat(F.lit('"security_'), c("pos").cast("string"), F.lit('":'), c("body"))
    opening = (
        F.when(~first, ",")
        .when(section == SCHEMES, ',"components":{"securitySchemes":{')
        .when(section == TAGS, ',"tags":[')
        .otherwise("")
    )
    text = F.concat(opening, F.when(section == SCHEMES, scheme).otherwise(c("body")))
    return placed.select("site", "section", "pos", text.alias("text"))


def assemble_documents(
    lines: DataFrame,
    max_bytes: int = MAX_DOCUMENT_BYTES,
    lines_per_chunk: int = LINES_PER_CHUNK,
) -> DataFrame:
    """(site, part, spec_json): one row per site, part 0.

    A document above ``max_bytes`` stays in parts 1, 2, ... to be read in order: a single value
    could not hold it.
    """
    lines = materialize(lines, "lines")
    total = F.sum(F.octet_length("text"))
    large = materialize(
        lines.groupBy("site").agg(total.alias("n")).filter(F.col("n") > max_bytes).select("site"),
        "large",
    )
    large = broadcast_if_small(large, "site")
    chunk = F.floor((F.col("pos") - 1) / lines_per_chunk)
    chunks = (
        lines.withColumn("chunk", chunk)
        .groupBy("site", "section", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_l"))
        .select("site", "section", "chunk", F.array_join("_l.text", "").alias("text"))
    )
    whole = (
        chunks.join(large, "site", "left_anti")
        .groupBy("site")
        .agg(F.array_sort(F.collect_list(F.struct("section", "chunk", "text"))).alias("_c"))
        .select("site", F.lit(0).cast("long").alias("part"),
                F.array_join("_c.text", "").alias("spec_json"))
    )
    if large.isEmpty():
        return whole
    parts = with_positions(
        materialize(chunks.join(large, "site", "left_semi"), "parts"),
        ["site"],
        ["section", "chunk"],
        "part",
    )
    return whole.unionByName(parts.select("site", "part", F.col("text").alias("spec_json")))


def build_specs(
    sites: DataFrame,
    results: DataFrame,
    endpoints: DataFrame,
    schemes: DataFrame,
    operations: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """(site, part, spec_json) out of page results and their flattened endpoints and schemes.

    ``operations``: the written ``unique_operations`` of the endpoints, if there are any yet.
    """
    if operations is None:
        operations = materialize(unique_operations(endpoints), "operations")
    lines = build_lines(sites, first_non_empty_metadata(results), operations, schemes)
    return assemble_documents(lines, **limits)


def no_schemes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "site STRING, url STRING, seq INT, type STRING, name STRING, location STRING, "
        "scheme STRING, bearer_format STRING, description STRING",
    )


def build_filtered_specs(
    sites: DataFrame, filtered: DataFrame, operations: DataFrame | None = None, **limits
) -> DataFrame:
    """Descriptions of filtered endpoints (with ``score``): rank order, no schemes, no metadata."""
    spark = filtered.sparkSession
    metadata = spark.createDataFrame(
        [], "site STRING, api_title STRING, api_description STRING, base_url STRING"
    )
    if operations is None:
        operations = materialize(unique_operations(filtered), "operations")
    lines = build_lines(sites, metadata, operations, no_schemes(spark))
    return assemble_documents(lines, **limits)


def with_file_facts(specs: DataFrame) -> DataFrame:
    """Add ``file_name``, ``size_bytes`` and ``format`` of each document."""
    return specs.select(
        "*",
        F.concat(site_file_name(F.col("site")), F.lit(".openapi.json")).alias("file_name"),
        F.octet_length("spec_json").cast("long").alias("size_bytes"),
        F.lit("json").alias("format"),
    )
