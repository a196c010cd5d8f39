"""Tables of API descriptions."""

import json

import pytest
from pyspark.sql import functions as F

from specloom.operators import specs as s


def table(spark, *texts):
    texts = [t if isinstance(t, str) else json.dumps(t) for t in texts]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "spec_id INT, spec_json STRING")


def spec(paths, **more):
    return {"openapi": "3.0.3", "info": {"title": "T", "version": "1"}, "paths": paths, **more}


OK = {"responses": {"200": {"description": "ok"}}}
QUERY = {"name": "q", "in": "query"}


def test_explode_order_and_fields(spark):
    text = spec(
        {
            "/b": {
                "post": {
                    "summary": "S", "description": "D", "tags": ["t"],
                    "parameters": [
                        {"name": "id", "in": "path", "required": True, "schema": {"type": "integer"}},
                        {"$ref": "#/x"},
                        {"name": "bad", "in": "nowhere"},
                        {"name": "list", "schema": {"type": ["string", "null"]}},
                        {"name": "old", "in": "header", "type": "number", "required": "yes"},
                        "no object",
                        {"name": 5},
                    ],
                    "responses": {
                        "404": {"description": "no"}, "200": {}, "500": "x",
                        "501": {"description": None},
                    },
                    "requestBody": {"content": {"text/xml": {"example": "<a/>"}}},
                },
                "parameters": [],
                "trace": {},
                "GET": {},
            },
            "/a": {"get": {"responses": {}}},
            "/list": [],
            "/null": None,
        }
    )
    rows = s.explode_spec(table(spark, text)).orderBy("seq").collect()
    assert [(r["path"], r["method"]) for r in rows] == [("/b", "post"), ("/b", "get"), ("/a", "get")]
    first = rows[0]
    assert [(p["name"], p["location"], p["required"], p["type"]) for p in first["parameters"]] == [
        ("id", "path", True, "integer"),
        ("unknown", "query", False, "string"),
        ("old", "header", True, "number"),
    ]
    assert [(r["status_code"], r["description"]) for r in first["responses"]] == [
        ("404", "no"), ("200", ""),
    ]
    assert (first["summary"], first["description"], first["tags"]) == ("S", "D", ["t"])
    assert first["request_body"] is None and first["confidence"] == "high"
    assert (rows[1]["summary"], rows[1]["tags"], rows[1]["parameters"]) == ("", [], [])
    carried = s.explode_spec(table(spark, text), carry_body=True).filter("method = 'post'").first()
    assert carried["request_body"]["content_type"] == "text/xml"
    assert carried["request_body"]["example"] == '"<a/>"'


def test_explode_drops_unusable_operations(spark):
    paths = {
        "/1": {"get": {"parameters": None}},
        "/2": {"get": {"responses": None}},
        "/3": {"get": {"responses": []}},
        "/4": {"get": {"summary": 1}},
        "/5": {"get": {"tags": "x"}},
        "/6": {"get": {"tags": [1]}},
        "/7": {"get": {"tags": None, "summary": None, "description": None}},
        "/8": {"get": {"parameters": {}}},
        "/9": {"get": None, "put": "x"},
    }
    rows = s.explode_spec(table(spark, spec(paths))).orderBy("seq").collect()
    assert [r["path"] for r in rows] == ["/7", "/8"]
    assert (rows[0]["tags"], rows[0]["summary"]) == (None, None)


def test_broken_and_repeated_keys(spark):
    repeated = '{"paths":{"/a":{"get":{"summary":"1"},"get":{"summary":"2"}},"/b":{"get":{}},"/a":{"put":{}}}}'
    rows = s.explode_spec(table(spark, "not json", '{"paths":[]}', repeated, "[1]", '{"x":1}'))
    got = [(r["spec_id"], r["path"], r["method"]) for r in rows.orderBy("spec_id", "seq").collect()]
    assert got == [(2, "/a", "put"), (2, "/b", "get")]


def test_find_embedded_spec(spark):
    good = json.dumps(spec({"/a": {"get": {}}}))
    other = json.dumps({"swagger": "2.0", "paths": {"/s": {"get": {}}}})
    cases = [
        (f"  {good}\n", [], good),
        ("prose", ["curl example", other, good], other),
        ('says "openapi" and "paths"', [good], good),
        ('{"openapi": "3", "paths": []}', [good], None),
        ('{"openapi": "3", "x": {"paths": 1}}', [good], good),
        ("prose", ['{"openapi": "3", "paths": []}', good], good),
        ('{"openapi":"3","paths":{}} tail', [], None),
        ('{"openapi":"2","openapi":"3","paths":{}}', [], '{"openapi": "3", "paths": {}}'),
        (good.replace("openapi", "swagger"), [], None),
        ("prose", [], None),
    ]
    frame = spark.createDataFrame(
        [(i, t, c) for i, (t, c, _) in enumerate(cases)], "i INT, text STRING, code_samples ARRAY<STRING>"
    )
    got = {r["i"]: r["embedded_spec"] for r in s.find_embedded_spec(frame).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_spec_coverage(spark):
    example = {"content": {"application/json": {"example": 1}}}
    full = {"parameters": [{"name": "q", "in": "query"}], "responses": {"200": {"description": "", **example}}}
    specs = table(
        spark,
        spec({"/test": {"get": full}}),
        spec({"/a": {"GET": full, "post": {"requestBody": example}, "put": {}}}, security=[]),
        spec({}),
        "broken",
        spec({"/a": []}),
        spec({"/a": {"get": {"requestBody": None}}}),
        {"openapi": "3.0.3"},
    )
    rows = {r["spec_id"]: r for r in s.spec_coverage(specs).collect()}

    def percents(i):
        names = ("parameters", "request_body", "responses", "examples")
        return (rows[i]["total_endpoints"], *[rows[i][f"pct_{n}"] for n in names])

    assert percents(0) == (1, 100.0, 0.0, 100.0, 100.0)
    assert rows[0]["recommendations"] == [s.COVERAGE_ADVICE[1][2], s.SECURITY_ADVICE]
    assert percents(1) == (3, 33.3, 33.3, 33.3, 66.7)
    assert rows[1]["recommendations"] == [s.COVERAGE_ADVICE[0][2], s.COVERAGE_ADVICE[2][2]]
    assert percents(2) == (0, 0.0, 0.0, 0.0, 0.0)
    assert rows[2]["recommendations"] == [s.SECURITY_ADVICE]
    assert [rows[i]["error"] is None for i in range(7)] == [True] * 3 + [False] * 3 + [True]
    assert rows[4]["total_endpoints"] == 0 and rows[4]["pct_examples"] is None


def test_spec_recommendations(spark):
    specs = table(
        spark,
        spec({"/a": {"get": OK, "GET": OK, "head": OK, "post": {"description": "d"}}}),
        {"openapi": "3.0.3"},
        spec({}, components={}),
    )
    got = {r["spec_id"]: r["recommendations"] for r in s.spec_recommendations(specs).collect()}
    assert got == {
        0: [
            "Consider adding descriptions to 1/2 operations",
            "Consider adding examples to 2/2 operations",
            s.SECURITY_ADVICE,
        ],
        1: [],
        2: [],
    }


RULES = [
        (spec({"/test": {"get": OK}}), set()),
        ("broken", {"is_json_object"}),
        ("[1]", {"is_json_object"}),
        ({"openapi": "2.0"}, {"openapi_version", "info_title", "info_version", "paths_required"}),
        (spec({"a": {"get": OK}}), {"path_starts_with_slash"}),
        (spec({"/a": {"get": {}}}), {"responses_required"}),
        (spec({"/a": {"get": {"responses": {"200": {}}}}}), {"response_description"}),
        (spec({"/a": {"get": {"responses": {"200": {"$ref": "#/r"}}}}}), set()),
        (spec({"/a/{id}": {"get": OK}}), {"path_parameters_declared"}),
        (
            spec({"/a/{id}": {"parameters": [{"name": "id", "in": "path", "required": True}], "get": OK}}),
            set(),
        ),
        (
            spec({"/a": {"get": {**OK, "parameters": [{"name": "q", "in": "x"}]}}}),
            {"parameter_location"},
        ),
        (
            spec({"/a": {"get": {**OK, "parameters": [{"name": "q", "in": "query", "schema": {"type": "x"}}]}}}),
            {"parameter_type"},
        ),
        (
            spec({"/a": {"get": {**OK, "operationId": "o"}, "put": {**OK, "operationId": "o"}}}),
            {"operation_id_unique"},
        ),
        (spec({"/a": {"get": "x"}}), {"operation_is_object"}),
        (spec({"/a": {"get": {**OK, "parameters": [QUERY, QUERY]}}}), {"parameter_unique"}),
        (spec({"/a": {"parameters": [QUERY], "get": {**OK, "parameters": [QUERY, {"name": "q", "in": "header"}]}}}), set()),
        (spec({"/a": {"get": {"responses": {"200": {"$ref": "#/components/responses/R"}}}}}), {"reference_resolved"}),
        (spec({"/a": {"get": {"responses": {"200": {"$ref": "#/components/responses/R~1S"}}}}}, components={"responses": {"R/S": {"description": ""}}}), set()),
        (spec({"/a": {"get": OK}}, components={"schemas": {"A": {"$ref": "#/components/schemas/B"}, "C": {"$ref": "#/components/schemas/A/x"}}}), {"reference_resolved"}),
        (spec({"/a": {"get": {**OK, "requestBody": {"description": "x"}}}}), {"request_body_content"}),
        (spec({"/a": {"get": {**OK, "requestBody": {"$ref": "#/x"}}}}), set()),
        (spec({"/a": {"get": {"responses": {"2000": {"description": ""}, "4XX": {"description": ""}, "default": {"description": ""}}}}}), {"status_code"}),
        (spec({"/a": {"get": {**OK, "parameters": [{**QUERY, "schema": {"type": "array"}}]}}}), {"array_items"}),
        (spec({"/a": {"get": {**OK, "parameters": [{**QUERY, "schema": {"type": "array", "items": {}}}]}}}), set()),
        (spec({"/a": {"get": {"responses": {"200": {"description": "", "content": {"a/b": {"schema": {"type": "array"}}}}}}}}), {"array_items"}),
        (spec({}, components={"schemas": {"L": {"type": "array"}}}), {"array_items"}),
        *[
            (spec({}, components={"securitySchemes": {"s": scheme}}), rules)
            for scheme, rules in (
                ({"type": "apiKey", "name": "k", "in": "header"}, set()),
                ({"type": "apiKey", "name": "k"}, {"security_scheme_fields"}),
                ({"type": "apiKey", "name": "k", "in": "path"}, {"security_scheme_fields"}),
                ({"type": "http", "scheme": "basic"}, set()),
                ({"type": "http"}, {"security_scheme_fields"}),
                ({"type": "oauth2"}, {"security_scheme_fields"}),
                ({"type": "oauth2", "flows": {}}, set()),
                ({"type": "openIdConnect", "openIdConnectUrl": "https://x"}, set()),
                ({"type": "other"}, {"security_scheme_fields"}),
                ({"$ref": "#/x"}, set()),
            )
        ],
        (spec({}, tags=[{"name": "a"}, {"name": "b"}, {"name": "a"}]), {"tag_unique"}),
        (spec({}, tags=[{"name": "a"}, {"name": "b"}, {}]), set()),
        ({"openapi": 3.0, "info": {"title": "t", "version": "1"}, "paths": {}}, {"openapi_version"}),
        ({"openapi": "3.0", "info": {"title": "t", "version": "1"}, "paths": {}}, set()),
]


def test_validation_rules(spark):
    frame = table(spark, *[text for text, _ in RULES])
    found = {}
    for r in s.spec_violations(frame).collect():
        found.setdefault(r["spec_id"], set()).add(r["rule"])
    rows = {r["spec_id"]: r for r in s.validate_specs(frame).collect()}
    assert len(rows) == len(RULES)
    for i, (text, rules) in enumerate(RULES):
        assert found.get(i, set()) == rules, text
        assert rows[i]["is_valid"] == (not rules) and {e.split(":")[0] for e in rows[i]["errors"]} == rules


def test_verdicts(spark):
    frame = table(spark, spec({"/a": {"get": OK}, "/b": {}}), spec({"x": {"get": {}}}), "broken")
    rows = s.walk(frame)
    got = s.verdicts_of(rows, s.violations_of(rows)).orderBy("spec_id").collect()
    assert [tuple(r)[1:] for r in got] == [
        (True, 0, [], 2), (False, 2, ["path_starts_with_slash", "responses_required"], 1), (False, 1, ["is_json_object"], 0),
    ]


def test_parse_specs_and_diff(spark):
    rows = s.parse_specs(table(spark, spec({"/a": {}, "/b": {}}), "x", {"info": 1})).collect()
    got = [(r["version"], r["paths_count"], r["error"]) for r in sorted(rows, key=lambda r: r["spec_id"])]
    assert got == [("3.0.3", 2, None), ("unknown", 0, "Failed to parse spec"), ("unknown", 0, None)]
    a, b = table(spark, spec({"/a": {}, "/b": {}})), table(spark, spec({"/b": {}, "/c": {}}))
    diff = s.spec_path_diff(a, b).orderBy("path").collect()
    assert [(r["path"], r["side"]) for r in diff] == [("/a", "official"), ("/c", "generated")]


def test_walk_computes_its_arrays_once(spark):
    """No filter is inferred from exploding, which would compute the arrays again."""
    frame = table(spark, spec({"/a": {"get": OK}}))
    plan = s.validate_specs(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (size(" not in plan
    texts = [spec({f"/p{i}": {"get": OK}}) for i in range(3)] + [
        {"openapi": "3.0.3", "info": {"title": "T", "version": "1"}, "paths": json.dumps({"/in/text": {"get": json.dumps(OK)}})},
        "  " + json.dumps(spec({"/a": {}})), {"openapi": 3.1, "info": "x", "paths": []}, "{} {}", "[1]", "null",
    ]
    rows = s.walk(table(spark, *texts)).filter("is_json IS NOT NULL").orderBy("spec_id").collect()
    assert [(r["is_json"], r["version"], r["paths"], r["bad"]) for r in rows] == [
        *[(True, "3.0.3", 1, False)] * 5, (True, None, 0, True), *[(False, None, 0, False)] * 3,
    ]


def test_plain_operations_are_not_read_as_variant(spark, monkeypatch):
    """Every member has its type: one typed pass is enough."""
    from specloom.functions import specs as f

    monkeypatch.setattr(f, "_is_usable", lambda op: F.raise_error(F.lit("read as VARIANT")).cast("boolean"))
    post = {
        "summary": "1-URGENT list", "description": "nullable", "tags": ["t"],
        "parameters": [
            {"name": "id", "in": "path", "required": True, "schema": {"type": "integer"}},
            {"$ref": "#/x"}, {"name": "no", "in": "moon"}, {"name": "old", "type": "number", "schema": {}},
        ],
        "responses": {"404": {"description": "no"}, "200": {"content": {"a/b": {"schema": {"nullable": True}}}}},
    }
    text = spec({"/b": {"parameters": [], "post": post, "GET": {}}, "/none": None})
    rows = s.explode_spec(table(spark, text, spec({}), "{broken")).orderBy("seq").collect()
    assert [(r["path"], r["method"], r["summary"], r["description"], r["tags"]) for r in rows] == [
        ("/b", "post", "1-URGENT list", "nullable", ["t"]), ("/b", "get", "", None, []),
    ]
    assert [tuple(p)[:5] for p in rows[0]["parameters"]] == [
        ("id", "path", None, True, "integer"), ("unknown", "query", None, False, "string"), ("old", "query", None, False, "string"),
    ]
    assert [tuple(r)[:3] for r in rows[0]["responses"]] == [
        ("404", "no", "application/json"), ("200", "", "application/json"),
    ]


def test_strings_that_look_like_other_values(spark):
    looks = ["200", "-1.5e3", "true", "null", "{}", "[1]", '"q"', "NaN", "a, null", ""]
    strings = spec({f"/{i}": {"get": {"summary": x, "tags": [x], "responses": {"200": {"description": x}}}} for i, x in enumerate(looks)})
    rows = s.explode_spec(table(spark, strings)).orderBy("seq").collect()
    assert [(r["summary"], r["tags"], r["responses"][0]["description"]) for r in rows] == [(x, [x], x) for x in looks]
    others = [200, -1.5, True, {}, [1]]
    values = spec({f"/{i}": {"get": {"summary": x}, "put": {"responses": {"200": {"description": x}, "404": {}}}} for i, x in enumerate(others)})
    rows = s.explode_spec(table(spark, values)).orderBy("seq").collect()
    assert [(r["method"], [x["status_code"] for x in r["responses"]]) for r in rows] == [("put", ["404"])] * len(others)
    text = spec({"/a": json.dumps({"get": {"summary": "in a string"}}), "/b": {"get": json.dumps({"summary": "here, too"})}})
    assert [r["summary"] for r in s.explode_spec(table(spark, text)).orderBy("seq").collect()] == ["in a string", "here, too"]
