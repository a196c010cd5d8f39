"""Merging endpoints and assembling descriptions."""

import json

import pytest
from pyspark.sql import functions as F

from specloom import schemas
from specloom.operators import build as b
from specloom.operators import coverage as c
from specloom.operators import merge as m
from specloom.operators import skew
from specloom.operators.specs import explode_spec, validate_specs

SITE = "https://api.example.com"
FIELDS = ["site", "url", "seq", *[name for name, _ in schemas.ENDPOINT_FIELDS]]
RESULTS = "site STRING, url STRING, api_title STRING, api_description STRING, base_url STRING"


def endpoint(path, method="get", seq=0, url="u1", confidence="medium", site=SITE, **more):
    row = dict.fromkeys(FIELDS)
    row.update(site=site, url=url, seq=seq, path=path, method=method, confidence=confidence)
    row.update(tags=[], parameters=[], responses=[], deprecated=False)
    row.update(more)
    return tuple(row[f] for f in FIELDS)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ENDPOINTS)


def metadata(spark, *rows):
    return spark.createDataFrame(list(rows), RESULTS)


def schemes(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "site STRING, url STRING, seq INT, type STRING, name STRING, location STRING, "
        "scheme STRING, bearer_format STRING, description STRING",
    )


def build(spark, endpoints, results=(), found=(), sites=(SITE,), **limits):
    sites = spark.createDataFrame([(s,) for s in sites], "site STRING")
    specs = b.build_specs(
        sites, metadata(spark, *results), table(spark, *endpoints), schemes(spark, *found), **limits
    )
    parts = {}
    for row in specs.orderBy("site", "part").collect():
        parts[row["site"]] = parts.get(row["site"], "") + row["spec_json"]
    return {site: json.loads(text) for site, text in parts.items()}


def test_dedup_keeps_best_then_first(spark):
    rows = table(
        spark,
        endpoint("/users", seq=0, summary="v1"),
        endpoint("/users", seq=1, confidence="high", summary="v2"),
        endpoint("/users", seq=2, confidence="high", summary="v3"),
        endpoint("/t", seq=3, url="u2", summary="b"),
        endpoint("/t", seq=9, url="u1", summary="a"),
        endpoint("/t", seq=0, site="other", summary="o", confidence="low"),
    )
    best = m.dedup_endpoints(rows)
    assert sorted(r["summary"] for r in best.collect()) == ["a", "o", "v2"]
    again = m.dedup_endpoints(best)
    assert sorted(map(str, again.collect())) == sorted(map(str, best.collect()))


def test_path_collision_keeps_the_later_in_the_first_place(spark):
    got = build(
        spark,
        [
            endpoint("users", seq=0, summary="first"),
            endpoint("/zoo", seq=1),
            endpoint("/users", seq=2, summary="later"),
            endpoint("/users", "post", seq=3),
        ],
    )[SITE]
    assert list(got["paths"]) == ["/users", "/zoo"]
    assert list(got["paths"]["/users"]) == ["get", "post"]
    assert got["paths"]["/users"]["get"]["summary"] == "later"


def test_metadata_first_non_empty(spark):
    rows = [
        (SITE, "u2", "T2", "D2", None),
        (SITE, "u1", None, "", ""),
        (SITE, "u3", "T3", "D3", "B3"),
        ("s", "u", None, None, None),
    ]
    got = {r["site"]: tuple(r)[1:] for r in m.first_non_empty_metadata(metadata(spark, *rows)).collect()}
    assert got == {SITE: ("T2", "D2", "B3"), "s": (None, None, None)}


def test_empty_site(spark):
    assert build(spark, [])[SITE] == {
        "openapi": "3.0.3",
        "info": {
            "title": "api.example.com API",
            "version": "1.0.0",
            "description": f"API specification generated from {SITE}",
        },
        "servers": [{"url": SITE, "description": "API server"}],
        "paths": {},
    }


def test_full_operation(spark):
    schema = ("object", "sd", '{"b":{"type":"string"},"a":1}', "{}", ["b"], "0", False)
    bare = ("array", "", None, '{"type":"string"}', [], None, None)
    row = endpoint(
        "/users/{id}/profile",
        "put",
        summary='say "hi"\n',
        description="",
        tags=["é", "a"],
        parameters=[
            ("id", "path", "the id", True, "integer", "5", None),
            ("q", "query", None, False, "string", '""', None),
        ],
        request_body=(None, True, "text/xml", schema, '"<a/>"'),
        responses=[
            ("200", "first", "application/json", schema, "1"),
            ("404", "none", "application/json", None, '{"lost":1}'),
            ("200", "last", "application/json", bare, '{"kept":1}'),
        ],
        deprecated=True,
    )
    got = build(
        spark,
        [row, endpoint("/", seq=1, operation_id="root")],
        [(SITE, "u1", "Title", "About", "api.example.com/v2")],
        [
            (SITE, "u1", 0, "apiKey", "K", "header", None, None, "d"),
            (SITE, "u2", 0, "http", None, None, "bearer", "JWT", ""),
        ],
    )[SITE]
    assert got["info"] == {"title": "Title", "version": "1.0.0", "description": "About"}
    assert got["servers"][0]["url"] == "https://api.example.com/v2"
    assert got["paths"]["/"]["get"] == {
        "operationId": "root",
        "responses": {
            "200": {
                "description": "Successful response",
                "content": {"application/json": {"schema": {"type": "object"}}},
            }
        },
    }
    full = {
        "type": "object", "description": "sd", "properties": {"b": {"type": "string"}, "a": 1},
        "required": ["b"], "additionalProperties": False,
    }
    assert got["paths"]["/users/{id}/profile"]["put"] == {
        "summary": 'say "hi"\n',
        "operationId": "put_users_by_id_profile",
        "tags": ["é", "a"],
        "parameters": [
            {
                "name": "id", "in": "path", "required": True, "schema": {"type": "integer"},
                "description": "the id", "example": 5,
            },
            {"name": "q", "in": "query", "required": False, "schema": {"type": "string"}},
        ],
        "requestBody": {
            "description": "",
            "required": True,
            "content": {"text/xml": {"schema": full, "example": "<a/>"}},
        },
        "responses": {
            "200": {
                "description": "last",
                "content": {
                    "application/json": {
                        "schema": {"type": "array", "items": {"type": "string"}},
                        "example": {"kept": 1},
                    }
                },
            },
            "404": {"description": "none"},
        },
        "deprecated": True,
    }
    assert got["components"] == {
        "securitySchemes": {
            "security_1": {"type": "apiKey", "description": "d", "name": "K", "in": "header"},
            "security_2": {"type": "http", "scheme": "bearer", "bearerFormat": "JWT"},
        }
    }
    assert got["tags"] == [
        {"name": "a", "description": "a endpoints"}, {"name": "é", "description": "é endpoints"},
    ]


def many(n=60, sites=(SITE, "https://b.example.com")):
    return [
        endpoint(f"/p{i % 23}/{{id}}", ("get", "post")[i % 2], seq=i, url=f"u{i % 3}", site=site,
                 tags=[f"t{i % 5}"], confidence=("high", "low")[i % 2])
        for i in range(n)
        for site in sites
    ]


def test_large_documents_are_split_into_ordered_parts(spark, monkeypatch):
    found = [(SITE, f"u{i}", 0, "oauth2", None, None, None, None, f"d{i}") for i in range(7)]
    sites = (SITE, "https://b.example.com")
    whole = build(spark, many(), found=found, sites=sites)
    split = build(spark, many(), found=found, sites=sites, max_bytes=500, lines_per_chunk=3)
    assert whole == split
    assert list(whole[SITE]["paths"]) == list(split[SITE]["paths"])


def test_positions_of_large_groups(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 7919) % 1000, i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "g STRING, k INT, i INT")
    small = skew.with_positions(frame, ["g"], ["k", "i"])
    large = skew.with_positions(frame, ["g"], ["k", "i"], limit=100)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salted_join_equals_join(spark, how, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 20)
    left = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        "id",
    )
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("zz", 3)], "k STRING, v INT")
    want = left.join(right, ["k"], how).collect()
    got = skew.salted_join(left, right, ["k"], ["id"], how, share=0.1).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 0


def test_round_trip_and_order_independence(spark):
    frame = table(spark, *many())
    sites = frame.select("site").distinct()
    none = schemes(spark)

    def specs(parts):
        return b.build_specs(sites, metadata(spark), frame.repartition(parts), none)

    first = {r["site"]: r["spec_json"] for r in specs(1).collect()}
    assert first == {r["site"]: r["spec_json"] for r in specs(8).collect()}
    back = explode_spec(specs(2), "site").select("site", "path", "method").distinct()
    want = frame.select("site", "path", "method").distinct()
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    errors = validate_specs(specs(2), "site").first()["errors"]
    assert {e.split(":")[0] for e in errors} == {"path_parameters_declared"}


def test_number_security_schemes(spark):
    rows = schemes(
        spark,
        (SITE, "u2", 0, "http", None, None, "basic", None, "x"),
        (SITE, "u1", 1, "http", None, None, "basic", None, "y"),
        (SITE, "u1", 0, "oauth2", None, None, None, None, None),
    )
    got = [(r["scheme_name"], r["url"]) for r in m.number_security_schemes(rows).orderBy("pos").collect()]
    assert got == [("security_1", "u1"), ("security_2", "u1"), ("security_3", "u2")]
    deduped = m.number_security_schemes(rows, dedup=True).orderBy("pos").collect()
    assert [(r["scheme_name"], r["description"]) for r in deduped] == [("security_1", None), ("security_2", "y")]


def test_coverage_counts(spark):
    p = [("q", "query", None, False, "string", None, None)]
    rows = table(
        spark,
        endpoint("/a", parameters=p, confidence="high"),
        endpoint("/b", parameters=[(*p[0][:5], "0", None)], confidence="low"),
        endpoint("/c", parameters=[(*p[0][:5], '"x"', None)]),
        endpoint("/d", request_body=(None, False, "a/b", None, "{}")),
        endpoint("/d", request_body=(None, False, "a/b", None, "[1]")),
        endpoint("/e", responses=[("200", "", "a/b", None, "1")]),
    )
    sites = spark.createDataFrame([(SITE,), ("empty",)], "site STRING")
    got = {r["site"]: r for r in c.coverage_report(rows, sites).collect()}
    r = got[SITE]
    assert [r[f"endpoints_with_{k}"] for k in ("parameters", "request_body", "responses", "examples")] == [3, 2, 1, 3]
    assert [r[f"confidence_{k}"] for k in ("high", "medium", "low")] == [1, 4, 1]
    assert r["average_confidence"] == pytest.approx((1 + 4 * 0.6 + 0.3) / 6)
    assert 0 <= r["quality_score"] <= 100
    assert got["empty"]["total_endpoints"] == 0 and got["empty"]["quality_score"] == 0.0


def test_quality_formula(spark):
    row = (100, 80, 30, 90, 50, 0.8)
    names = ["total_endpoints", *[f"endpoints_with_{k}" for k in ("parameters", "request_body", "responses", "examples")]]
    frame = spark.createDataFrame([row], [*names, "average_confidence"])
    for level in schemas.CONFIDENCE_LEVELS:
        frame = frame.withColumn(f"confidence_{level}", F.lit(0))
    r = c.with_quality(frame).first()
    assert (r["parameter_coverage"], r["response_coverage"]) == (80.0, 90.0)
    assert r["quality_score"] == pytest.approx(68.5)


def test_tags_paths_and_summary(spark):
    rows = table(spark, endpoint("users", tags=["users"]), endpoint("/users", tags=["posts", "users"]))
    assert sorted(r["tag"] for r in m.distinct_tags(rows).collect()) == ["posts", "users"]
    assert m.path_count(rows).first()["path_count"] == 1
    sites = spark.createDataFrame([(SITE,), ("empty",)], "site STRING")
    summary = c.run_summary(sites, rows, c.coverage_report(rows))
    assert {tuple(r)[:4] for r in summary.collect()} == {(SITE, True, 2, 2), ("empty", False, 0, 0)}
    assert c.success_rate(summary).first()["success_rate"] == 50.0
