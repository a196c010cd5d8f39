"""Table schemas (DDL) and the closed value sets of the data model.

Free-form JSON values (examples, property maps) are JSON text: they can be stored in Parquet and
compared. Enumerations are plain strings checked against the sets below.
"""

from __future__ import annotations

# The enumerations of the data model.
HTTP_METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "trace")
SPEC_METHODS = ("get", "post", "put", "delete", "patch", "head", "options")
ADVICE_METHODS = ("get", "post", "put", "delete", "patch")
PARAMETER_LOCATIONS = ("query", "header", "path", "cookie")
DATA_TYPES = ("string", "number", "integer", "boolean", "array", "object")
CONFIDENCE_LEVELS = ("high", "medium", "low")
SECURITY_TYPES = ("apiKey", "http", "oauth2", "openIdConnect")
SECURITY_LOCATIONS = ("query", "header", "cookie")

# Confidence as a rank (which duplicate wins) and as a score (averages).
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
CONFIDENCE_SCORE = {"high": 1.0, "medium": 0.6, "low": 0.3}

# Weights of the quality score.
QUALITY_WEIGHTS = {
    "parameters": 0.25,
    "request_body": 0.20,
    "responses": 0.30,
    "examples": 0.15,
    "confidence": 0.10,
}

PAGES = (
    "site STRING, url STRING, status INT, content_type STRING, html STRING, fetched_at TIMESTAMP"
)

SCHEMA = (
    "STRUCT<type: STRING, description: STRING, properties: STRING, items: STRING, "
    "required: ARRAY<STRING>, example: STRING, additional_properties: BOOLEAN>"
)
PARAMETER = (
    "STRUCT<name: STRING, location: STRING, description: STRING, required: BOOLEAN, "
    "type: STRING, example: STRING, schema: STRING>"
)
REQUEST_BODY = (
    "STRUCT<description: STRING, required: BOOLEAN, content_type: STRING, "
    f"schema: {SCHEMA}, example: STRING>"
)
RESPONSE = (
    "STRUCT<status_code: STRING, description: STRING, content_type: STRING, "
    f"schema: {SCHEMA}, example: STRING>"
)
ENDPOINT_FIELDS = (
    ("path", "STRING"),
    ("method", "STRING"),
    ("summary", "STRING"),
    ("description", "STRING"),
    ("operation_id", "STRING"),
    ("tags", "ARRAY<STRING>"),
    ("parameters", f"ARRAY<{PARAMETER}>"),
    ("request_body", REQUEST_BODY),
    ("responses", f"ARRAY<{RESPONSE}>"),
    ("deprecated", "BOOLEAN"),
    ("confidence", "STRING"),
    ("source_url", "STRING"),
)
ENDPOINT = "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in ENDPOINT_FIELDS) + ">"
ENDPOINTS = "site STRING, url STRING, seq INT, " + ", ".join(f"{n} {t}" for n, t in ENDPOINT_FIELDS)

SECURITY_SCHEME = (
    "STRUCT<type: STRING, name: STRING, location: STRING, scheme: STRING, "
    "bearer_format: STRING, description: STRING>"
)

TOOL_RECORDS = "ARRAY<STRUCT<name: STRING, input: STRING>>"

# What one page yields; the value kept in the extraction cache.
PAGE_RESULT = (
    f"STRUCT<endpoints: ARRAY<{ENDPOINT}>, security_schemes: ARRAY<{SECURITY_SCHEME}>, "
    "api_title: STRING, api_description: STRING, base_url: STRING, confidence: STRING>"
)

CACHE = "content_hash STRING, kind STRING, created_at TIMESTAMP, payload STRING"

# The global order of endpoints: pages of a site by url, records of a page by position.
PAGE_ORDER = ("url", "seq")
