"""Tables of API descriptions: parsing, exploding, coverage, advice, validation, comparison.

Reports work on rows. ``walk`` reads each text once and returns a row per operation (or per path or
description that has none); ``operation_rows`` makes the same rows out of endpoints that are not
assembled yet. Coverage and advice are aggregates over them, rules that need other rows (an id that is
repeated, a reference without a target) are decided by counts per name. So no report needs a whole
description, and the rows of a large one are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom import schemas
from specloom.functions import jsontext as j
from specloom.functions import specs as s
from specloom.functions.text import strip
from specloom.operators.build import OPENAPI_VERSION, build_operation, build_security_scheme
from specloom.operators.merge import explode_rows, number_security_schemes

# Advice sentences, with the coverage below which the first four are given.
COVERAGE_ADVICE = (
    ("parameters", 50, "Add parameter definitions to more endpoints"),
    ("request_body", 30, "Document request body schemas for POST/PUT/PATCH endpoints"),
    ("responses", 70, "Add response schemas and status codes"),
    ("examples", 40, "Include examples for requests and responses"),
)
SECURITY_ADVICE = "Consider adding security schemes if the API requires authentication"
MISSING_ADVICE = (
    ("descriptions", "Consider adding descriptions to %d/%d operations"),
    ("examples", "Consider adding examples to %d/%d operations"),
)


def parse_specs(specs: DataFrame, column: str = "spec_json") -> DataFrame:
    """Add ``spec`` (canonical text, null when broken), ``version``, ``paths_count``, ``error``.

    A broken description becomes a row with an error; it never fails the job.
    """
    parsed = specs.withColumn("spec", j.canonical(F.col(column)))
    is_object = F.coalesce(strip(F.col("spec")).startswith("{"), F.lit(False))
    parsed = parsed.withColumn("spec", F.when(is_object, F.col("spec")))
    spec = F.col("spec")
    version = F.from_json(spec, "openapi STRING")["openapi"]
    paths = F.from_json(s.paths_text(spec), s.TEXT_MAP)
    return parsed.select(
        "*",
        F.coalesce(version, F.lit("unknown")).alias("version"),
        F.coalesce(F.size(F.map_keys(paths)), F.lit(0)).cast("long").alias("paths_count"),
        F.when(spec.isNull(), "Failed to parse spec").alias("error"),
    )


def explode_spec(specs: DataFrame, key: str = "spec_id", carry_body: bool = False) -> DataFrame:
    """One row per operation of each description: (key, seq, endpoint fields)."""
    url = F.col(key).cast("string")
    parsed = specs.select(key, j.canonical(F.col("spec_json")).alias("spec"))
    found = s.spec_endpoints(F.col("spec"), url, carry_body)
    return explode_rows(parsed.select(key, found.alias("e")), "e")


def find_embedded_spec(documents: DataFrame) -> DataFrame:
    """Add ``embedded_spec``: the description a page consists of, or shows in a code sample.

    A page whose whole text is a description with unusable paths counts as having none, whatever
    its samples say.
    """
    text = F.col("text")
    whole = F.contains(text, F.lit('"openapi"')) & F.contains(text, F.lit('"paths"'))
    shown = F.filter(
        F.col("code_samples"),
        lambda c: F.contains(c, F.lit('"paths"'))
        & (F.contains(c, F.lit('"openapi"')) | F.contains(c, F.lit('"swagger"'))),
    )
    candidates = F.concat(
        F.when(whole, F.array(strip(text))).otherwise(F.array(F.lit(None).cast("string"))),
        F.coalesce(shown, F.array().cast("array<string>")),
    )
    # One Arrow call at most per row: the whole text first, then the samples.
    some = F.exists(candidates, lambda c: c.isNotNull())
    parsed = documents.withColumn(
        "_parsed",
        F.when(
            some,
            F.concat(
                F.array(j.canonical(F.get(candidates, F.lit(0)))),
                j.canonical_list(F.slice(candidates, F.lit(2), F.size(candidates))),
            ),
        ),
    )
    first = F.get(F.col("_parsed"), F.lit(0))
    samples = F.slice("_parsed", F.lit(2), F.size("_parsed"))
    usable = F.filter(samples, lambda c: s.paths_text(c).isNotNull())
    return parsed.withColumn(
        "embedded_spec",
        F.when(s.has_paths(first), F.when(s.paths_text(first).isNotNull(), first)).otherwise(
            F.get(usable, F.lit(0))
        ),
    ).drop("_parsed")


# -- coverage and advice --------------------------------------------------------------------------


def _has_key(value: Column, *names: str) -> Column:
    found = j.member(value, names[0]).isNotNull()
    for name in names[1:]:
        found = found | j.member(value, name).isNotNull()
    return found


def _has_media_example(holder: Column) -> Column:
    media = F.map_values(j.as_map(j.member(holder, "content")))
    return F.coalesce(F.exists(media, lambda m: _has_key(m, "example", "examples")), F.lit(False))


def _has_response_example(op: Column) -> Column:
    responses = F.map_values(j.as_map(op["responses"]))
    return F.coalesce(F.exists(responses, _has_media_example), F.lit(False))


def _given(op: Column, name: str) -> Column:
    value = op[name]
    return F.when(value.isNotNull(), j.is_truthy(j.as_text(value))).otherwise(False)


def _malformed_content(holder: Column) -> Column:
    content = j.member(holder, "content")

    def is_scalar(media):
        return ~F.rlike(j.kind(media), F.lit(j.HOLDER))

    scalar = F.exists(F.map_values(j.as_map(content)), is_scalar)
    return j.is_other_than_object(content) | F.coalesce(scalar, F.lit(False))


def _malformed(op: Column) -> Column:
    """Parts of an operation that a walk through it would stumble over."""
    body, responses = op["requestBody"], op["responses"]
    bad_response = F.exists(
        F.map_values(j.as_map(responses)), lambda r: ~j.is_object(r) | _malformed_content(r)
    )
    return (
        op.isNull()
        | F.when(body.isNull(), False).otherwise(
            j.is_other_than_object(body) | _malformed_content(body)
        )
        | F.when(responses.isNull(), False).otherwise(
            j.is_other_than_object(responses) | F.coalesce(bad_response, F.lit(False))
        )
    )


# -- rows of descriptions -------------------------------------------------------------------------

VIOLATION = "STRUCT<rule: STRING, location: STRING>"
# What a security scheme of each type must have, and where an API key may be.
SCHEME_FIELDS = {"apiKey": ("name", "in"), "http": ("scheme",), "oauth2": ("flows",), "openIdConnect": ("openIdConnectUrl",)}
KEY_PLACES = ("query", "header", "cookie")
STATUS_CODE = r"^([1-5]([0-9][0-9]|XX)|default|x-.*)$"
# Rules that other rows of the description decide: by a second row of the name, by a missing target.
SCHEME_RULE = "security_scheme_fields"
REPEATED, UNRESOLVED, TARGET, KNOWN = "operation_id_unique", "reference_resolved", "target", "known"
REFERENCE = r'"\$ref"\s*:\s*"(#/components/[^"/]+/[^"/]+)'


def _violation(rule: str, broken: Column, location: Column) -> Column:
    return F.when(
        F.coalesce(broken, F.lit(False)),
        F.struct(F.lit(rule).alias("rule"), location.alias("location")).cast(VIOLATION),
    )


def _named(rule: str, locations: Column) -> Column:
    """A violation (or what decides one) for each of the names."""
    each = F.transform(locations, lambda x: F.struct(F.lit(rule).alias("rule"), x.alias("location")).cast(VIOLATION))
    return F.coalesce(each, F.array().cast(f"array<{VIOLATION}>"))


def _pointers(text: Column) -> Column:
    """Targets among the components that a text refers to."""
    plain = F.transform(
        F.regexp_extract_all(text, F.lit(REFERENCE)),
        lambda r: F.replace(F.replace(r, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")),
    )
    return F.when(F.contains(text, F.lit("$ref")), F.array_distinct(plain))


def _repeats(names: Column) -> Column:
    """Whether a name is in the list twice."""
    some = F.array_compact(names)
    return F.size(F.array_distinct(some)) < F.size(some)


def _array_without_items(schema: Column) -> Column:
    return F.coalesce(j.as_string(j.member(schema, "type")) == "array", F.lit(False)) & j.member(schema, "items").isNull()


def lacks_fields(scheme: Column) -> Column:
    """Whether a security scheme (VARIANT) has no known type or lacks a field that its type needs."""
    type_ = j.as_string(j.member(scheme, "type"))
    out = ~F.coalesce(type_.isin(*SCHEME_FIELDS), F.lit(False))
    for name, fields in SCHEME_FIELDS.items():
        missing = F.lit(False)
        for field in fields:
            missing = missing | j.member(scheme, field).isNull()
        if name == "apiKey":
            missing = missing | ~F.coalesce(j.as_string(j.member(scheme, "in")).isin(*KEY_PLACES), F.lit(False))
        out = out | F.coalesce(type_ == name, F.lit(False)) & missing
    return out & j.member(scheme, "$ref").isNull()


def _document_violations(m: Column, info: Column, components: Column, version: Column, paths: Column) -> Column:
    """What a description breaks above its paths, with nulls between; ``m``: its members as texts, null if
    it is no object; ``info`` and ``components``: those two, read."""
    nowhere, is_json = F.lit(""), m.isNotNull()
    tags = F.transform(F.from_json(m["tags"], "ARRAY<STRUCT<name: STRING>>"), lambda t: t["name"])
    schemes = F.map_entries(F.from_json(components["securitySchemes"], s.VALUE_MAP))
    types = F.map_entries(F.from_json(components["schemas"], s.VALUE_MAP))

    key = lambda entries: F.transform(entries, lambda e: e["key"])
    single = F.array(
        _violation("is_json_object", ~is_json, nowhere),
        _violation("openapi_version", is_json & ~F.coalesce(F.rlike(version, F.lit(r"^3\.[0-9]+")), F.lit(False)), nowhere),
        _violation("info_title", is_json & j.as_string(info["title"]).isNull(), nowhere),
        _violation("info_version", is_json & j.as_string(info["version"]).isNull(), nowhere),
        _violation("paths_required", is_json & paths.isNull(), nowhere),
        _violation("tag_unique", _repeats(tags), nowhere),
    )
    nothing = F.array().cast(f"array<{VIOLATION}>")
    lacking = _named(SCHEME_RULE, key(F.filter(schemes, lambda e: lacks_fields(e["value"]))))
    lists = _named("array_items", key(F.filter(types, lambda e: _array_without_items(e["value"]))))
    return F.concat(
        single,
        F.when(components["securitySchemes"].isNotNull(), lacking).otherwise(nothing),
        F.when(components["schemas"].isNotNull(), lists).otherwise(nothing),
    )


def _version(spec: Column, m: Column, v: Column) -> Column:
    """The version, if it is a string; of a text that VARIANT cannot hold it is read alone."""
    alone = F.when(v.isNull() & m.isNotNull(), F.from_json(spec, j.variants("openapi"))["openapi"])
    return j.as_string(F.coalesce(j.member(v, "openapi"), alone))


def _operation_violations(rows: DataFrame) -> DataFrame:
    """Add ``of_operation``: what an operation breaks, with nulls between; null in rows without one.

    What several rules read is a column of its own, so that it is read once.
    """
    op, path, text, body = F.col("op"), F.col("path"), F.col("text"), F.col("op")["requestBody"]
    nothing = F.array().cast("array<variant>")
    counts = F.coalesce(F.col("method").isin(*schemas.HTTP_METHODS), F.lit(False))
    rows = rows.withColumns(
        {
            "_counts": counts,
            "_responses": F.when(counts, j.as_map(op["responses"])),
            "_own": F.when(counts, F.coalesce(j.as_array(op["parameters"]), nothing)),
        }
    )
    parameters = F.concat("_own", F.coalesce(j.as_array(F.col("shared")), nothing))
    rows = rows.withColumn("_read", F.transform(parameters, lambda v: j.members(v, "$ref", "in", "name", "required", "schema")))
    rows = rows.withColumn("_inline", F.filter("_read", lambda v: v["$ref"].isNull()))
    where = F.concat(F.upper("method"), F.lit(" "), path)
    responses, own, read, inline = F.col("_responses"), F.col("_own"), F.col("_read"), F.col("_inline")
    has_reference = F.size(inline) < F.size(read)
    declared = F.transform(
        F.filter(inline, lambda v: (j.as_string(v["in"]) == "path") & F.try_variant_get(v["required"], "$", "boolean")),
        lambda v: j.as_string(v["name"]),
    )
    placeholders = F.regexp_extract_all(path, F.lit(r"\{([^{}/]*)\}"))
    undeclared = F.contains(path, F.lit("{")) & (F.size(F.array_except(placeholders, declared)) > 0) & ~has_reference
    bad_place = F.exists(inline, lambda v: ~F.coalesce(j.as_string(v["in"]).isin(*schemas.PARAMETER_LOCATIONS), F.lit(False)))

    def bad_type(v):
        given = j.member(v["schema"], "type")
        return j.is_string(given) & ~j.text(given).isin(*schemas.DATA_TYPES)

    names = F.transform(own, lambda v: F.concat(j.as_string(j.member(v, "in")), F.lit(" "), j.as_string(j.member(v, "name"))))
    bad_description = F.exists(
        F.map_values(responses),
        lambda r: j.as_string(j.member(r, "description")).isNull() & j.member(r, "$ref").isNull(),
    )
    media = F.concat(
        F.array(body), F.coalesce(F.map_values(responses), nothing)
    )
    schemas_of = lambda holder: F.transform(F.map_values(j.as_map(j.member(holder, "content"))), lambda m: j.member(m, "schema"))
    lists = F.exists(inline, lambda v: _array_without_items(v["schema"])) | F.exists(
        media, lambda h: F.coalesce(F.exists(schemas_of(h), _array_without_items), F.lit(False))
    )
    # A type is written out in the texts of an operation and its path's parameters, or escaped.
    told = F.concat_ws(" ", text, F.when(F.size(own) < F.size(read), F.to_json("shared")))
    some_list = F.contains(told, F.lit("array")) | F.contains(told, F.lit("\\u"))
    operation_id = j.as_string(op["operationId"])
    single = F.array(
        _violation("operation_is_object", op.isNull(), where),
        _violation("responses_required", op.isNotNull() & (F.coalesce(F.size(responses), F.lit(0)) < 1), where),
        _violation("response_description", bad_description, where),
        _violation("path_parameters_declared", undeclared, where),
        _violation("parameter_location", bad_place, where),
        _violation("parameter_type", F.exists(inline, bad_type), where),
        _violation("parameter_unique", (F.size(own) > 1) & _repeats(names), where),
        _violation("request_body_content", body.isNotNull() & j.is_object(body) & j.member(body, "content").isNull() & j.member(body, "$ref").isNull(), where),
        _violation("status_code", F.exists(F.map_keys(responses), lambda k: ~F.rlike(k, F.lit(STATUS_CODE))), where),
        _violation("array_items", some_list & lists, where),
        _violation(REPEATED, operation_id.isNotNull(), operation_id),
    )
    refers = F.when(F.contains(text, F.lit("$ref")), _named(UNRESOLVED, _pointers(text)))
    found = F.concat(single, F.coalesce(refers, F.array().cast(f"array<{VIOLATION}>")))
    return rows.withColumn("of_operation", F.when(F.col("_counts"), found))


def walk(specs: DataFrame, key: str = "spec_id", column: str = "spec_json") -> DataFrame:
    """(key, is_json, version, has_paths, paths, secured, bad, path, method, text, op, shared, found).

    A row per description, per path and per operation. What is known of the whole description stands in its
    own row and is null in the others: ``paths``, their number, and what it breaks (``found``). ``bad``: paths or a path item are no object. ``op``: the
    operation's members as VARIANT, null if it is no object; ``shared``: the parameters of its path.
    """
    parsed = j.with_canonical(specs.select(key, column), column, "spec", "v")
    # Objects come from VARIANT: the names of all paths would fill the symbol table of the text parser.
    too_large = F.when(F.col("v").isNull() & strip(F.col("spec")).startswith("{"), F.from_json("spec", s.TEXT_MAP))
    top = parsed.withColumn("m", F.coalesce(F.try_variant_get("v", "$", s.TEXT_MAP), too_large))
    given = F.col("m")["paths"]
    paths = F.when(F.coalesce(given.startswith("{"), F.lit(False)), F.from_json(given, s.TEXT_MAP))
    top = top.withColumn("items", F.coalesce(F.try_variant_get("v", "$.paths", s.TEXT_MAP), paths))

    keys, version = F.map_keys("m"), _version(F.col("spec"), F.col("m"), F.col("v"))
    inside = F.from_json(F.col("m")["components"], s.TEXT_MAP)
    components = F.from_json(F.col("m")["components"], "MAP<STRING, MAP<STRING, STRING>>")
    targets = F.flatten(
        F.transform(
            F.map_entries(components),
            lambda e: F.transform(F.map_keys(e["value"]), lambda k: F.concat(F.lit("#/components/"), e["key"], F.lit("/"), k)),
        )
    )
    refers = F.flatten(F.transform(F.map_values(inside), _pointers))
    decided = F.when(F.contains("spec", F.lit("$ref")), F.concat(_named(TARGET, targets), _named(UNRESOLVED, refers)))
    nothing = F.array().cast(f"array<{VIOLATION}>")
    given = F.col("m")["components"]
    top = top.withColumns(
        {
            "version": version,
            "info": F.from_json(F.col("m")["info"], j.variants("title", "version")),
            "components": F.from_json(given, "securitySchemes STRING, schemas STRING"),
        }
    )
    head = {
        "is_json": F.col("m").isNotNull(),
        "version": F.col("version"),
        "has_paths": F.coalesce(F.map_contains_key("m", "paths"), F.lit(False)),
        "paths": F.coalesce(F.size("items"), F.lit(0)),
        "secured": F.coalesce(F.array_contains(keys, "security") | F.array_contains(keys, "components"), F.lit(False)),
        "bad": F.coalesce(F.map_contains_key("m", "paths") & F.col("items").isNull(), F.lit(False)),
        "found": F.concat(_document_violations(F.col("m"), F.col("info"), F.col("components"), F.col("version"), F.col("items")), F.coalesce(decided, nothing)),
    }
    # Every row carries what is its own and no more: the whole description's facts, a path, an operation.
    # The arrays are columns of their own and exploded in the outer form: they are computed once.
    whole = F.struct(*[v.alias(n) for n, v in head.items()])
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    nobody = F.slice(F.array(none), 1, 0)
    each = F.concat(F.array(none), F.coalesce(F.map_entries("items"), nobody))
    rows = top.select(key, whole.alias("whole"), each.alias("each")).select(key, "whole", F.posexplode_outer("each").alias("nth", "e"))
    of_whole = F.when(F.col("nth") == 0, F.col("whole"))
    rows = rows.select(key, *[of_whole[n].alias(n) for n in head], F.col("e.key").alias("path"), F.col("e.value").alias("item"))

    is_item = F.coalesce(F.col("item").startswith("{"), F.lit(False))
    rows = rows.withColumn("members", F.when(is_item, F.from_json("item", s.TEXT_MAP))).withColumn("is_item", is_item).drop("item")
    parameters = F.col("members")["parameters"]
    shared = F.from_json(F.concat(F.lit('{"v":'), F.when(parameters.startswith("["), parameters), F.lit("}")), "v VARIANT")["v"]
    methods = F.filter(F.map_entries("members"), lambda e: F.lower(e["key"]).isin(*schemas.HTTP_METHODS))
    rows = rows.withColumn("shared", shared).withColumn("methods", F.concat(F.array(none), F.coalesce(methods, nobody)))
    rows = rows.drop("members").select("*", F.posexplode_outer("methods").alias("at", "o")).drop("methods")
    first, text = F.col("at") == 0, F.col("o.value")
    return rows.select(
        key, "is_json", "version", "has_paths", "paths", "secured",
        F.when(first, F.coalesce("bad", F.lit(False)) | (F.col("path").isNotNull() & ~F.col("is_item"))).alias("bad"),
        "path",
        F.col("o.key").alias("method"),
        text.alias("text"),
        F.when(text.startswith("{"), F.from_json(text, s.OPERATION)).alias("op"),
        F.when(~first, F.col("shared")).alias("shared"),
        "found",
    )


def operation_rows(sites: DataFrame, operations: DataFrame, schemes: DataFrame) -> DataFrame:
    """``walk`` over the descriptions that are built of these, without building them; the key is ``site``.

    operations: the deduplicated ones. What is known of a whole description stands in a row of its own.
    """
    null = {"is_json": "boolean", "version": "string", "has_paths": "boolean", "paths": "int", "secured": "boolean", "path": "string",
            "method": "string", "text": "string", "shared": "variant", "found": f"array<{VIOLATION}>"}

    def rows(frame: DataFrame, **given: Column) -> DataFrame:
        op = F.from_json(given.get("text", F.lit(None).cast("string")), s.OPERATION)
        columns = [given.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in null.items()]
        return frame.select("site", *columns[:5], F.lit(False).alias("bad"), *columns[5:8], op.alias("op"), *columns[8:])

    built = operations.select("site", "norm_path", "method", build_operation().alias("text"))
    named = number_security_schemes(schemes).select("site", "scheme_name", F.parse_json(build_security_scheme()).alias("scheme"))
    target = F.concat(F.lit("#/components/securitySchemes/"), "scheme_name")
    broken = F.array_compact(F.array(_violation(SCHEME_RULE, lacks_fields(F.col("scheme")), F.col("scheme_name")), _violation(TARGET, F.lit(True), target)))
    counted = operations.select("site", "norm_path").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("paths"))
    secured = schemes.select("site").distinct().withColumn("secured", F.lit(True))
    heads = sites.select("site").distinct().join(counted, "site", "left").join(secured, "site", "left")
    yes = F.lit(True)
    return (
        rows(heads, is_json=yes, version=F.lit(OPENAPI_VERSION), has_paths=yes, paths=F.coalesce("paths", F.lit(0)), secured=F.coalesce("secured", F.lit(False)))
        .unionByName(rows(built, path=F.col("norm_path"), method=F.col("method"), text=F.col("text")))
        .unionByName(rows(named, found=broken))
    )


# -- reports on rows ------------------------------------------------------------------------------


def coverage_of(rows: DataFrame, key: str = "spec_id") -> DataFrame:
    """Operation counts, percentages (one decimal) and advice per description."""
    op = F.col("op")
    counts = F.coalesce(F.lower("method").isin(*schemas.SPEC_METHODS), F.lit(False))
    flags = {
        "parameters": _given(op, "parameters"),
        "request_body": _given(op, "requestBody"),
        "responses": _given(op, "responses"),
        "examples": _has_media_example(op["requestBody"]) | _has_response_example(op),
    }
    names = [name for name, _, _ in COVERAGE_ADVICE]
    flagged = rows.select(
        key, "is_json", "secured", counts.alias("counts"),
        (F.coalesce("bad", F.lit(False)) | counts & _malformed(op)).alias("bad"),
        *[(counts & flags[name]).alias(name) for name in names],
    )
    counted = flagged.groupBy(key).agg(
        F.bool_and(F.coalesce("is_json", F.lit(True))).alias("is_json"),
        F.bool_or(F.coalesce("secured", F.lit(False))).alias("secured"),
        F.bool_or("bad").alias("bad"),
        F.count_if("counts").alias("n"),
        *[F.count_if(name).alias(f"with_{name}") for name in names],
    )
    failed, n = ~F.col("is_json") | F.col("bad"), F.col("n")
    share = {name: F.when(n > 0, F.col(f"with_{name}") / n * 100) for name in names}
    advice = [F.when(share[name] < low, text) for name, low, text in COVERAGE_ADVICE]
    advice.append(F.when(~F.col("secured"), SECURITY_ADVICE))
    return counted.select(
        key,
        F.when(failed, 0).otherwise(n).cast("long").alias("total_endpoints"),
        *[F.when(~failed, F.bround(F.coalesce(share[name], F.lit(0.0)), 1)).alias(f"pct_{name}") for name in names],
        F.when(~failed, F.array_compact(F.array(*advice))).alias("recommendations"),
        F.when(failed, "Analysis failed").alias("error"),
    )


def recommendations_of(rows: DataFrame, key: str = "spec_id") -> DataFrame:
    """Advice on missing descriptions, response examples and security; none without ``paths``."""
    op = F.col("op")
    counts = F.coalesce(F.col("method").isin(*schemas.ADVICE_METHODS), F.lit(False))
    flagged = rows.select(
        key, "has_paths", "secured", counts.alias("counts"),
        (counts & ~_given(op, "description")).alias("descriptions"),
        (counts & ~_has_response_example(op)).alias("examples"),
    )
    counted = flagged.groupBy(key).agg(
        F.bool_or(F.coalesce("has_paths", F.lit(False))).alias("has_paths"),
        F.bool_or(F.coalesce("secured", F.lit(False))).alias("secured"),
        F.count_if("counts").alias("n"),
        *[F.count_if(name).alias(name) for name, _ in MISSING_ADVICE],
    )
    advice = [F.when(F.col(name) > 0, F.format_string(text, F.col(name), F.col("n"))) for name, text in MISSING_ADVICE]
    advice.append(F.when(~F.col("secured"), SECURITY_ADVICE))
    given = F.when(F.col("has_paths"), F.array_compact(F.array(*advice)))
    return counted.select(key, F.coalesce(given, F.array().cast("array<string>")).alias("recommendations"))


def violations_of(rows: DataFrame, key: str = "spec_id") -> DataFrame:
    """One row (key, rule, location) per broken rule and place."""
    nothing = F.array().cast(f"array<{VIOLATION}>")
    slash = F.array(_violation("path_starts_with_slash", ~F.col("path").startswith("/"), F.col("path")))
    found = F.concat(F.coalesce("found", nothing), slash, F.coalesce("of_operation", nothing))
    judged = _operation_violations(rows).select(key, found.alias("found"))
    each = judged.select(key, F.explode_outer("found").alias("v")).filter(F.col("v").isNotNull()).select(key, "v.*")
    rule = F.when(F.col("rule") == TARGET, UNRESOLVED).otherwise(F.col("rule"))
    met = each.groupBy(key, rule.alias("rule"), "location").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule") == TARGET).alias("targets"))
    repeated = (F.col("rule") != REPEATED) | (F.col("n") > 1)
    return met.filter(repeated & (F.col("targets") == 0)).select(key, "rule", "location")


def verdicts_of(rows: DataFrame, violations: DataFrame, key: str = "spec_id") -> DataFrame:
    """(key, is_valid, n_errors, rules, paths_count): whether a description breaks no rule, at how many
    places it does, which rules it breaks, and its number of paths."""
    broken = violations.groupBy(key).agg(F.count(F.lit(1)).alias("n_errors"), F.array_sort(F.collect_set("rule")).alias("rules"))
    judged = rows.filter("is_json IS NOT NULL").select(key, "paths").join(broken, key, "left")
    n = F.coalesce("n_errors", F.lit(0)).cast("long")
    rules = F.coalesce("rules", F.array().cast("array<string>"))
    return judged.select(key, (n == 0).alias("is_valid"), n.alias("n_errors"), rules.alias("rules"), F.col("paths").cast("long").alias("paths_count"))


def spec_coverage(specs: DataFrame, key: str = "spec_id") -> DataFrame:
    """``coverage_of`` descriptions given as text."""
    return coverage_of(walk(specs, key), key)


def spec_recommendations(specs: DataFrame, key: str = "spec_id") -> DataFrame:
    """``recommendations_of`` descriptions given as text."""
    return recommendations_of(walk(specs, key), key)


def spec_violations(specs: DataFrame, key: str = "spec_id") -> DataFrame:
    """``violations_of`` descriptions given as text."""
    return violations_of(walk(specs, key), key)


def validate_specs(specs: DataFrame, key: str = "spec_id") -> DataFrame:
    """(key, is_valid, errors, version, paths_count) per description."""
    rows = walk(specs, key)
    # what is known of the whole goes with the violations, as a rule of its own
    known = F.struct(F.lit(KNOWN).alias("rule"), F.to_json(F.struct("version", "paths")).alias("location")).cast(VIOLATION)
    marked = rows.withColumn("found", F.when(F.col("is_json").isNotNull(), F.concat("found", F.array(known))))
    found = violations_of(marked, key)
    error = F.concat("rule", F.when(F.col("location") != "", F.concat(F.lit(": "), "location")).otherwise(""))
    is_known = F.col("rule") == KNOWN
    judged = found.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(~is_known, error))).alias("errors"),
        F.max(F.when(is_known, F.col("location"))).alias("known"),
    )
    facts = F.from_json("known", "version STRING, paths LONG")
    return judged.select(
        key,
        (F.size("errors") == 0).alias("is_valid"),
        "errors",
        F.coalesce(facts["version"], F.lit("unknown")).alias("version"),
        F.coalesce(facts["paths"], F.lit(0).cast("long")).alias("paths_count"),
    )


def spec_path_diff(official: DataFrame, generated: DataFrame, key: str = "spec_id") -> DataFrame:
    """Paths that only one of two tables of descriptions has: (key, path, side)."""

    def paths(specs, side):
        spec = j.canonical(F.col("spec_json"))
        named = specs.select(key, spec.alias("spec")).select(
            key,
            F.explode(F.map_keys(F.from_json(s.paths_text(F.col("spec")), s.TEXT_MAP))).alias("path"),
        )
        return named.withColumn("side", F.lit(side))

    both = paths(official, "official").unionByName(paths(generated, "generated"))
    sides = both.groupBy(key, "path").agg(F.min("side").alias("a"), F.max("side").alias("side"))
    return sides.filter(F.col("a") == F.col("side")).select(key, "path", "side")
