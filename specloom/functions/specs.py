"""Endpoints out of API descriptions (JSON text), as column expressions.

Order matters in a description (paths, methods, status codes) and is kept by reading objects as
MAP of text; types matter too and are read from VARIANT. Every level is bound by its own
``transform`` so that nothing is parsed twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom import schemas
from specloom.functions import jsontext as j

TEXT_MAP = "MAP<STRING, STRING>"
VALUE_MAP = "MAP<STRING, VARIANT>"


def _entries(text: Column, type_: str = TEXT_MAP) -> Column:
    return F.map_entries(F.from_json(text, type_))


def _is_object_text(text: Column) -> Column:
    return F.coalesce(text.startswith("{"), F.lit(False))


def has_paths(spec: Column) -> Column:
    """A JSON object with a member ``paths`` (whatever it is)."""
    return F.coalesce(F.map_contains_key(F.from_json(spec, TEXT_MAP), "paths"), F.lit(False))


def paths_text(spec: Column) -> Column:
    """JSON text of ``paths`` when it is an object, else null."""
    # Bound by the filter: it is often read inside a lambda, where equal expressions are computed again.
    paths = F.from_json(spec, "paths STRING")["paths"]
    return F.get(F.filter(F.array(paths), _is_object_text), F.lit(0))


def _path_items(spec: Column) -> Column:
    """(path, members) of the path items that are objects, in document order."""

    def apart():
        items = F.filter(_entries(paths_text(spec)), lambda e: _is_object_text(e["value"]))
        return F.transform(
            items,
            lambda e: F.struct(
                e["key"].alias("path"), F.from_json(e["value"], TEXT_MAP).alias("members")
            ),
        )

    def at_once(given):
        items = F.filter(F.map_entries(given["paths"]), lambda e: e["value"].isNotNull())
        return F.transform(
            items, lambda e: F.struct(e["key"].alias("path"), e["value"].alias("members"))
        )

    read = j.typed(spec, f"paths MAP<STRING, {TEXT_MAP}>")
    return j.bound(read, lambda given: F.when(j.fits(given), at_once(given)).otherwise(apart()))


# The members of an operation anything here looks at.
OPERATION = j.variants(
    "summary", "description", "operationId", "tags", "parameters", "requestBody", "responses"
)


def _operation_texts(spec: Column, methods, any_case: bool) -> Column:
    """(path, method, text) of every operation of a description, in document order."""

    def counted(e):
        name = F.lower(e["key"]) if any_case else e["key"]
        return name.isin(*methods)

    return F.flatten(
        F.transform(
            _path_items(spec),
            lambda item: F.transform(
                F.filter(F.map_entries(item["members"]), counted),
                lambda e: F.struct(
                    item["path"].alias("path"),
                    e["key"].alias("method"),
                    e["value"].alias("text"),
                ),
            ),
        )
    )


def _read_operation(text: Column) -> Column:
    """The struct of an operation's members as VARIANT; null if it is no object."""
    return F.when(_is_object_text(text), F.from_json(text, OPERATION))


def operations(spec: Column, methods=schemas.SPEC_METHODS, any_case: bool = True) -> Column:
    """(path, method, text, op) of every operation of a description, in document order.

    ``text`` is the operation as JSON text, ``op`` the struct of its members as VARIANT. Path items
    that are no objects and members that are no method are passed over; operations that are no
    objects stay, with a null ``op``.
    """
    return F.transform(
        _operation_texts(spec, methods, any_case),
        lambda e: F.struct(
            *[e[name].alias(name) for name in ("path", "method", "text")],
            _read_operation(e["text"]).alias("op"),
        ),
    )


def _null(type_: str) -> Column:
    return F.lit(None).cast(type_)


def _parameters(given: Column) -> Column:
    """Valid parameters of an operation; each invalid one is passed over alone."""
    names = ("name", "in", "description", "required", "schema", "type")
    objects = F.filter(j.as_array(given), j.is_object)
    members = F.transform(objects, lambda v: j.members(v, *names))

    def read(q):
        schema, type_ = q["schema"], q["type"]
        inner = j.member(schema, "type")
        declared = F.when(
            F.when(schema.isNotNull(), j.is_object(schema)).otherwise(False),
            F.when(inner.isNull(), "string").otherwise(j.text(inner)),
        ).otherwise(F.when(type_.isNull(), "string").otherwise(j.text(type_)))
        return F.struct(
            F.when(q["name"].isNull(), "unknown").otherwise(j.as_string(q["name"])).alias("name"),
            F.when(q["in"].isNull(), "query").otherwise(j.text(q["in"])).alias("location"),
            j.text(q["description"]).alias("description"),
            j.as_flag(q["required"]).alias("required"),
            declared.alias("type"),
            _null("string").alias("example"),
            _null("string").alias("schema"),
            j.is_optional_string(q["description"]).alias("ok"),
        )

    return _valid_parameters(F.transform(members, read))


def _valid_parameters(read: Column) -> Column:
    valid = F.filter(
        read,
        lambda e: e["ok"]
        & e["name"].isNotNull()
        & e["required"].isNotNull()
        & F.coalesce(e["location"].isin(*schemas.PARAMETER_LOCATIONS), F.lit(False))
        & F.coalesce(e["type"].isin(*schemas.DATA_TYPES), F.lit(False)),
    )
    fields = ("name", "location", "description", "required", "type", "example", "schema")
    return F.transform(valid, lambda e: F.struct(*[e[f].alias(f) for f in fields]))


def _responses(text: Column) -> Column:
    """Status and description, in document order; responses without a text are passed over."""
    listed = F.map_entries(F.from_json(text, f"responses {VALUE_MAP}")["responses"])
    entries = F.filter(listed, lambda e: j.is_object(e["value"]))
    described = F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("k"), j.member(e["value"], "description").alias("d")),
    )
    read = F.transform(
        described,
        lambda e: F.struct(
            e["k"].alias("status_code"),
            F.when(e["d"].isNull(), "").otherwise(j.as_string(e["d"])).alias("description"),
            F.lit("application/json").alias("content_type"),
            _null(schemas.SCHEMA).alias("schema"),
            _null("string").alias("example"),
        ),
    )
    return F.filter(read, lambda e: e["description"].isNotNull())


def _is_usable(op: Column) -> Column:
    """Whether an operation makes an endpoint: its parts have the types they must have."""
    parameters, responses = op["parameters"], op["responses"]
    iterable = F.rlike(j.kind(parameters), F.lit(j.HOLDER))
    return (
        F.when(parameters.isNull(), True).otherwise(iterable)
        & ~j.is_other_than_object(responses)
        & j.is_optional_string(op["summary"])
        & j.is_optional_string(op["description"])
        & j.is_string_list(op["tags"])
    )


def _as_body(op: Column) -> Column:
    """Request body of an operation: first media type, its schema type and its example."""
    body = op["requestBody"]
    media = F.element_at(F.map_entries(j.as_map(j.member(body, "content"))), 1)
    body_schema = j.member(media["value"], "schema")
    struct = F.struct(
        j.as_string(j.member(body, "description")).alias("description"),
        F.coalesce(j.as_flag(j.member(body, "required")), F.lit(False)).alias("required"),
        F.coalesce(media["key"], F.lit("application/json")).alias("content_type"),
        F.when(
            j.is_object(body_schema),
            F.struct(
                F.coalesce(j.as_string(j.member(body_schema, "type")), F.lit("object")).alias("type"),
                j.as_string(j.member(body_schema, "description")).alias("description"),
                j.as_text(j.member(body_schema, "properties")).alias("properties"),
                j.as_text(j.member(body_schema, "items")).alias("items"),
                j.as_string_list(j.member(body_schema, "required")).alias("required"),
                j.as_text(j.member(body_schema, "example")).alias("example"),
                F.try_variant_get(body_schema, "$.additionalProperties", "boolean").alias(
                    "additional_properties"
                ),
            ).cast(schemas.SCHEMA),
        ).alias("schema"),
        j.as_text(j.member(media["value"], "example")).alias("example"),
    )
    return F.when(j.is_object(body), struct.cast(schemas.REQUEST_BODY))


# An operation of which every member has the type that is expected of it.
PLAIN_OPERATION = (
    "summary STRING, description STRING, tags ARRAY<STRING>, parameters ARRAY<STRUCT<name: STRING, `in`: STRING, "
    "description: STRING, required: BOOLEAN, schema: STRUCT<type: STRING>, type: STRING>>, "
    "responses MAP<STRING, STRUCT<description: STRING>>"
)


def _is_plain(op: Column, text: Column) -> Column:
    """Whether an operation read as PLAIN_OPERATION is what a read as VARIANT would give."""

    def some(array, doubt):
        return F.coalesce(F.exists(array, doubt), F.lit(False))

    doubt = (
        j.in_doubt(op["summary"])
        | j.in_doubt(op["description"])
        | some(op["tags"], j.in_doubt)
        | some(op["parameters"], lambda q: j.in_doubt(q["name"]) | j.in_doubt(q["description"]))
        | some(F.map_values(op["responses"]), lambda r: j.in_doubt(r["description"]))
    )
    return j.fits(op) & ~j.has_null(text) & ~doubt


def _plain_parameters(given: Column) -> Column:
    """``_parameters`` of a plain operation."""

    def read(q):
        declared = F.when(q["schema"].isNotNull(), q["schema"]["type"]).otherwise(q["type"])
        return F.struct(
            F.coalesce(q["name"], F.lit("unknown")).alias("name"),
            F.coalesce(q["in"], F.lit("query")).alias("location"),
            q["description"].alias("description"),
            F.coalesce(q["required"], F.lit(False)).alias("required"),
            F.coalesce(declared, F.lit("string")).alias("type"),
            _null("string").alias("example"),
            _null("string").alias("schema"),
            F.lit(True).alias("ok"),
        )

    return _valid_parameters(F.transform(given, read))


def _plain_responses(given: Column) -> Column:
    """``_responses`` of a plain operation."""
    return F.transform(
        F.map_entries(given),
        lambda e: F.struct(
            e["key"].alias("status_code"),
            F.coalesce(e["value"]["description"], F.lit("")).alias("description"),
            F.lit("application/json").alias("content_type"),
            _null(schemas.SCHEMA).alias("schema"),
            _null("string").alias("example"),
        ),
    )


def spec_endpoints(spec: Column, source_url: Column, carry_body: bool = False) -> Column:
    """Endpoints of a description (canonical JSON text), in document order, confidence high.

    By default request bodies are left behind, as a pipeline run does; ``carry_body`` keeps them.
    Null when ``paths`` is no object. An operation with nothing unexpected is read in one pass, any other
    as VARIANT.
    """
    no_list = F.array().cast("array<string>")
    no_parameters = F.array().cast(f"array<{schemas.PARAMETER}>")
    no_responses = F.array().cast(f"array<{schemas.RESPONSE}>")

    def endpoint(e, body, summary, description, tags, parameters, responses):
        values = {
            "path": e["path"],
            "method": F.lower(e["method"]),
            "summary": summary,
            "description": description,
            "operation_id": _null("string"),
            "tags": tags,
            "parameters": F.coalesce(parameters, no_parameters),
            "request_body": body,
            "responses": F.coalesce(responses, no_responses),
            "deprecated": F.lit(False),
            "confidence": F.lit("high"),
            "source_url": source_url,
        }
        return F.struct(*[v.alias(name) for name, v in values.items()])

    def body(op):
        return _as_body(op) if carry_body else _null(schemas.REQUEST_BODY)

    def plain(e, op):
        return endpoint(
            e,
            body(op),
            F.coalesce(op["summary"], F.lit("")),
            op["description"],
            F.coalesce(op["tags"], no_list),
            _plain_parameters(op["parameters"]),
            _plain_responses(op["responses"]),
        )

    def other(e, op):
        tags, summary = op["tags"], op["summary"]
        found = endpoint(
            e,
            body(op),
            F.when(summary.isNull(), "").otherwise(j.text(summary)),
            j.text(op["description"]),
            F.when(tags.isNull(), no_list).otherwise(j.as_string_list(tags)),
            F.when(op["parameters"].isNotNull(), _parameters(op["parameters"])),
            F.when(op["responses"].isNotNull(), _responses(e["text"])),
        )
        return F.when(_is_usable(op), found)

    given = f"{PLAIN_OPERATION}, requestBody VARIANT" if carry_body else PLAIN_OPERATION

    def read(e):
        text = e["text"]
        found = j.bound(
            j.typed(text, given),
            lambda op: F.when(_is_plain(op, text), plain(e, op)).otherwise(
                j.bound(F.from_json(text, OPERATION), lambda op: other(e, op))
            ),
        )
        return F.when(_is_object_text(text), found)

    texts = _operation_texts(spec, schemas.SPEC_METHODS, True)
    return F.filter(F.transform(texts, read), lambda e: e.isNotNull())
