"""Typed rows out of the records an extraction function returns, as column expressions.

A record is (name, input): ``record_endpoint``, ``record_security_scheme`` or
``record_api_metadata`` with its fields as JSON text. Other names are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom import schemas
from specloom.functions import jsontext as j

ENDPOINT_RECORD = "record_endpoint"
SECURITY_RECORD = "record_security_scheme"
METADATA_RECORD = "record_api_metadata"
JSON_TYPE = "application/json"


ENDPOINT_INPUT = j.variants(
    "path",
    "method",
    "summary",
    "description",
    "tags",
    "parameters",
    "request_body",
    "responses",
    "confidence",
)
PARAMETER_INPUT = ("name", "location", "description", "required", "type", "example")
BODY_INPUT = ("description", "required", "content_type", "schema_properties", "example")
RESPONSE_INPUT = ("status_code", "description", "content_type", "schema_properties", "example")

# Records of which every member has the type that is expected of it.
PLAIN_ENDPOINT = (
    "path STRING, method STRING, summary STRING, description STRING, tags ARRAY<STRING>, confidence STRING, "
    "parameters ARRAY<STRUCT<name: STRING, location: STRING, description: STRING, required: BOOLEAN, type: STRING, example: VARIANT>>, "
    "request_body STRUCT<description: STRING, required: BOOLEAN, content_type: STRING, schema_properties: VARIANT, example: VARIANT>, "
    "responses ARRAY<STRUCT<status_code: VARIANT, description: STRING, content_type: STRING, schema_properties: VARIANT, example: VARIANT>>"
)
SECURITY_FIELDS = ("type", "name", "location", "scheme", "bearer_format", "description")
METADATA_FIELDS = ("title", "description", "base_url")

PARAMETER_FIELDS = ("name", "location", "description", "required", "type", "example", "schema")
BODY_FIELDS = ("description", "required", "content_type", "schema", "example")
RESPONSE_FIELDS = ("status_code", "description", "content_type", "schema", "example")


def _in(value: Column, allowed) -> Column:
    return F.coalesce(value.isin(*allowed), F.lit(False))


def _null(type_: str) -> Column:
    return F.lit(None).cast(type_)


def _fields(e: Column, names) -> Column:
    return F.struct(*[e[n].alias(n) for n in names])


def _string_or_default(value: Column, default: str) -> Column:
    """The default when absent; null when the value is no string."""
    return F.when(value.isNull(), default).otherwise(j.as_string(value))


def schema_from_properties(properties: Column, description: Column) -> Column:
    """An object schema when ``schema_properties`` is given, with the holder's description."""
    schema = F.struct(
        F.lit("object").alias("type"),
        description.alias("description"),
        j.as_text(properties).alias("properties"),
        _null("string").alias("items"),
        _null("array<string>").alias("required"),
        _null("string").alias("example"),
        _null("boolean").alias("additional_properties"),
    )
    return F.when(properties.isNotNull(), schema)


def _schema_ok(holder: Column) -> Column:
    properties = holder["schema_properties"]
    return F.when(properties.isNull() | F.is_variant_null(properties), True).otherwise(
        j.is_object(properties)
    )


def _parameter(q: Column) -> Column:
    """Typed parameter out of the struct of its members; ``type_ok`` is half of the check."""
    return F.struct(
        j.text(q["name"]).alias("name"),
        j.text(q["location"]).alias("location"),
        j.text(q["description"]).alias("description"),
        j.as_flag(q["required"]).alias("required"),
        F.when(q["type"].isNull(), "string").otherwise(j.text(q["type"])).alias("type"),
        j.as_text(q["example"]).alias("example"),
        _null("string").alias("schema"),
        (j.is_string(q["name"]) & j.is_optional_string(q["description"])).alias("type_ok"),
    )


def _parameter_ok(e: Column) -> Column:
    return (
        e["type_ok"]
        & e["required"].isNotNull()
        & _in(e["location"], schemas.PARAMETER_LOCATIONS)
        & _in(e["type"], schemas.DATA_TYPES)
    )


def _body(q: Column) -> Column:
    return F.struct(
        j.text(q["description"]).alias("description"),
        j.as_flag(q["required"]).alias("required"),
        _string_or_default(q["content_type"], JSON_TYPE).alias("content_type"),
        schema_from_properties(q["schema_properties"], j.text(q["description"])).alias("schema"),
        j.as_text(q["example"]).alias("example"),
        (j.is_optional_string(q["description"]) & _schema_ok(q)).alias("type_ok"),
    )


def _body_ok(e: Column) -> Column:
    return e["type_ok"] & e["required"].isNotNull() & e["content_type"].isNotNull()


def _response(q: Column) -> Column:
    return F.struct(
        j.text(q["status_code"]).alias("status_code"),
        j.text(q["description"]).alias("description"),
        _string_or_default(q["content_type"], JSON_TYPE).alias("content_type"),
        schema_from_properties(q["schema_properties"], j.text(q["description"])).alias("schema"),
        j.as_text(q["example"]).alias("example"),
        (j.is_string(q["status_code"]) & j.is_string(q["description"]) & _schema_ok(q)).alias(
            "type_ok"
        ),
    )


def _response_ok(e: Column) -> Column:
    return e["type_ok"] & e["content_type"].isNotNull()


def _listed(value: Column, names) -> Column:
    """Members of the elements of a list; none when absent, null when it is no list."""
    nothing = F.array().cast("array<variant>")
    empty = F.when(F.to_json(value).isin("{}", '""'), nothing)
    values = F.when(value.isNull(), nothing).otherwise(F.coalesce(j.as_array(value), empty))
    return F.transform(values, lambda v: j.members(v, *names))


def _checked(ok: Column, source_url: Column, **values: Column) -> Column:
    """(ok, endpoint) out of the fields that a record gives."""
    values |= {"operation_id": _null("string"), "deprecated": F.lit(False), "source_url": source_url}
    endpoint = F.struct(*[values[name].alias(name) for name, _ in schemas.ENDPOINT_FIELDS])
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), endpoint.alias("endpoint"))


def _some(array: Column, doubt) -> Column:
    return F.coalesce(F.exists(array, doubt), F.lit(False))


def _is_plain_endpoint(e: Column, text: Column) -> Column:
    """Whether a record read as PLAIN_ENDPOINT is what a read as VARIANT would give."""
    body = e["request_body"]
    nested = e["parameters"].isNotNull() | body.isNotNull() | e["responses"].isNotNull()
    names = ("description", "required", "content_type", "schema_properties", "example")
    doubt = (
        j.in_doubt(e["path"])
        | j.in_doubt(e["summary"])
        | j.in_doubt(e["description"])
        | _some(e["tags"], j.in_doubt)
        | _some(e["parameters"], lambda q: j.in_doubt(q["name"]) | j.in_doubt(q["description"]))
        | _some(e["responses"], lambda q: j.in_doubt(q["description"]) | j.in_doubt(q["content_type"]))
        # With nothing known in it, a body may be empty: then it is none.
        | F.when(body.isNull(), False).otherwise(
            F.coalesce(*[F.when(body[n].isNotNull(), False) for n in names], F.lit(True))
            | j.in_doubt(body["description"])
            | j.in_doubt(body["content_type"])
        )
    )
    # VARIANT turns down a member with repeated keys inside.
    return e.isNotNull() & j.fits(e) & ~j.has_null(text) & ~doubt & (~nested | F.try_parse_json(text).isNotNull())


def _plain_endpoint(e: Column, source_url: Column) -> Column:
    """(ok, endpoint) of a plain endpoint record."""

    def schema_ok(q):
        return F.when(q["schema_properties"].isNull(), True).otherwise(j.is_object(q["schema_properties"]))

    def content(q):
        return (
            F.coalesce(q["content_type"], F.lit(JSON_TYPE)).alias("content_type"),
            schema_from_properties(q["schema_properties"], q["description"]).alias("schema"),
            F.when(q["example"].isNotNull(), j.as_text(q["example"])).alias("example"),
        )

    def parameter(q):
        return F.struct(
            q["name"].alias("name"),
            q["location"].alias("location"),
            q["description"].alias("description"),
            F.coalesce(q["required"], F.lit(False)).alias("required"),
            F.coalesce(q["type"], F.lit("string")).alias("type"),
            F.when(q["example"].isNotNull(), j.as_text(q["example"])).alias("example"),
            _null("string").alias("schema"),
        )

    def response(q):
        code = q["status_code"]
        return F.struct(j.as_string(code).alias("status_code"), q["description"].alias("description"), *content(q))

    def parameter_ok(q):
        return (
            q["name"].isNotNull()
            & _in(q["location"], schemas.PARAMETER_LOCATIONS)
            & (q["type"].isNull() | _in(q["type"], schemas.DATA_TYPES))
        )

    def response_ok(q):
        return j.is_string(q["status_code"]) & q["description"].isNotNull() & schema_ok(q)

    body = e["request_body"]
    confidence = F.coalesce(e["confidence"], F.lit("medium"))
    ok = (
        e["path"].isNotNull()
        & _in(e["method"], schemas.HTTP_METHODS)
        & _in(confidence, schemas.CONFIDENCE_LEVELS)
        & F.coalesce(F.forall(e["parameters"], parameter_ok), F.lit(True))
        & F.coalesce(F.forall(e["responses"], response_ok), F.lit(True))
        & F.when(body.isNull(), True).otherwise(schema_ok(body))
    )
    required = F.coalesce(body["required"], F.lit(False))
    described = F.struct(body["description"].alias("description"), required.alias("required"), *content(body))

    def listed(array, make, type_):
        return F.when(array.isNull(), F.array().cast(type_)).otherwise(F.transform(array, make))

    return _checked(
        ok,
        source_url,
        path=e["path"],
        method=e["method"],
        summary=e["summary"],
        description=e["description"],
        tags=F.coalesce(e["tags"], F.array().cast("array<string>")),
        parameters=listed(e["parameters"], parameter, f"array<{schemas.PARAMETER}>"),
        request_body=F.when(body.isNotNull(), described),
        responses=listed(e["responses"], response, f"array<{schemas.RESPONSE}>"),
        confidence=confidence,
    )


def parse_endpoints(records: Column, source_url: Column) -> Column:
    """Array of (ok, endpoint) for the endpoint records, in order.

    A record with nothing unexpected is read in one pass, any other as VARIANT: in four passes, each
    binding what the next one needs, so that no value is read twice.
    """
    named = F.filter(records, lambda r: r["name"] == ENDPOINT_RECORD)

    def parts(e):
        body = e["request_body"]
        given = F.when(body.isNotNull(), j.is_truthy(j.as_text(body))).otherwise(False)
        return F.struct(
            e.alias("e"),
            _listed(e["parameters"], PARAMETER_INPUT).alias("parameters"),
            F.when(given, j.members(body, *BODY_INPUT)).alias("body"),
            F.when(given, ~j.is_object(body)).otherwise(False).alias("bad_body"),
            _listed(e["responses"], RESPONSE_INPUT).alias("responses"),
        )

    def typed(e):
        return F.struct(
            e["e"].alias("e"),
            e["bad_body"].alias("bad_body"),
            F.transform(e["parameters"], _parameter).alias("parameters"),
            F.when(e["body"].isNotNull(), _body(e["body"])).alias("body"),
            F.transform(e["responses"], _response).alias("responses"),
            j.text(e["e"]["method"]).alias("method"),
            F.when(e["e"]["confidence"].isNull(), "medium")
            .otherwise(j.text(e["e"]["confidence"]))
            .alias("confidence"),
        )

    def checked(q):
        e, body, tags = q["e"], q["body"], q["e"]["tags"]
        ok = (
            j.is_string(e["path"])
            & _in(q["method"], schemas.HTTP_METHODS)
            & _in(q["confidence"], schemas.CONFIDENCE_LEVELS)
            & j.is_optional_string(e["summary"])
            & j.is_optional_string(e["description"])
            & j.is_string_list(tags)
            & F.forall(q["parameters"], _parameter_ok)
            & F.forall(q["responses"], _response_ok)
            & ~q["bad_body"]
            & F.when(body.isNull(), True).otherwise(_body_ok(body))
        )
        no_list = F.array().cast("array<string>")
        return _checked(
            ok,
            source_url,
            path=j.text(e["path"]),
            method=q["method"],
            summary=j.text(e["summary"]),
            description=j.text(e["description"]),
            tags=F.when(tags.isNull(), no_list).otherwise(j.as_string_list(tags)),
            parameters=F.transform(q["parameters"], lambda v: _fields(v, PARAMETER_FIELDS)),
            request_body=F.when(body.isNotNull(), _fields(body, BODY_FIELDS)),
            responses=F.transform(q["responses"], lambda v: _fields(v, RESPONSE_FIELDS)),
            confidence=q["confidence"],
        )

    def as_variants(text):
        members = F.array(F.from_json(text, ENDPOINT_INPUT))
        return F.get(F.transform(F.transform(F.transform(members, parts), typed), checked), F.lit(0))

    def read(r):
        text = r["input"]
        return j.bound(
            j.typed(text, PLAIN_ENDPOINT),
            lambda e: F.when(_is_plain_endpoint(e, text), _plain_endpoint(e, source_url)).otherwise(as_variants(text)),
        )

    return F.transform(named, read)


def _texts(text: Column, names, read) -> Column:
    """``read(members, text of a member, as_variants)`` of a record whose members should be strings.

    Where they are, they are read at once, else as VARIANT.
    """

    def all_strings(e):
        doubt = j.in_doubt(e[names[0]])
        for name in names[1:]:
            doubt = doubt | j.in_doubt(e[name])
        return e.isNotNull() & j.fits(e) & ~j.has_null(text) & ~doubt

    at_once = j.typed(text, ", ".join(f"{name} STRING" for name in names))
    return j.bound(
        at_once,
        lambda e: F.when(all_strings(e), read(e, lambda name: e[name], False)).otherwise(
            j.bound(F.from_json(text, j.variants(*names)), lambda e: read(e, lambda name: j.text(e[name]), True))
        ),
    )


def parse_security_schemes(records: Column) -> Column:
    """Array of (ok, scheme) for the security records, in order."""
    named = F.filter(records, lambda r: r["name"] == SECURITY_RECORD)
    texts = ("name", "scheme", "bearer_format", "description")

    def read(e, text, as_variants):
        location = e["location"]
        absent = location.isNull() | F.is_variant_null(location) if as_variants else location.isNull()
        ok = _in(text("type"), schemas.SECURITY_TYPES) & F.when(absent, True).otherwise(
            _in(text("location"), schemas.SECURITY_LOCATIONS)
        )
        for name in texts if as_variants else ():
            ok = ok & j.is_optional_string(e[name])
        scheme = F.struct(*[text(name).alias(name) for name in SECURITY_FIELDS])
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), scheme.alias("scheme"))

    return F.transform(named, lambda r: _texts(r["input"], SECURITY_FIELDS, read))


def last_metadata(records: Column) -> Column:
    """(ok, title, description, base_url) of the last metadata record, also when it resets them."""
    named = F.filter(records, lambda r: r["name"] == METADATA_RECORD)
    last = F.slice(named, F.greatest(F.size(named), F.lit(1)), F.lit(1))

    def read(e, text, as_variants):
        ok = F.lit(True)
        for name in METADATA_FIELDS if as_variants else ():
            ok = ok & j.is_optional_string(e[name])
        return F.struct(ok.alias("ok"), *[text(name).alias(name) for name in METADATA_FIELDS])

    return F.get(F.transform(last, lambda r: _texts(r["input"], METADATA_FIELDS, read)), F.lit(0))


def page_confidence(endpoints: Column) -> Column:
    """Level of a page by its share of endpoints with high confidence."""
    high = F.size(F.filter(endpoints, lambda e: e["confidence"] == "high"))
    share = F.when(F.size(endpoints) > 0, high / F.size(endpoints))
    return F.when(share > 0.7, "high").when(share > 0.3, "medium").otherwise("low")
