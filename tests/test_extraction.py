"""Extraction functions, records, cache, relevance."""

import datetime as dt
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from specloom import schemas
from specloom.operators import cache as k
from specloom.operators import extraction as x
from specloom.operators import relevance as r

DOCS = "site STRING, url STRING, title STRING, text STRING, code_samples ARRAY<STRING>, content_hash STRING"


def parsed(spark, *records, on_error="page", error=None):
    rows = [(None if error else [(n, v if isinstance(v, str) else json.dumps(v)) for n, v in records], error)]
    frame = spark.createDataFrame(rows, f"records {schemas.TOOL_RECORDS}, error STRING")
    frame = frame.select(F.lit("s").alias("site"), F.lit("u").alias("url"), "*")
    return x.parse_records(frame, on_error).first()


def point(**fields):
    return ("record_endpoint", {"path": "/a", "method": "get", "summary": "s", **fields})


def test_endpoint_record_fields(spark):
    row = parsed(
        spark,
        point(
            parameters=[{"name": "q", "location": "query", "type": "integer", "example": 0},
                        {"name": "p", "location": "path", "required": True, "example": "x"}],
            request_body={"description": "d", "schema_properties": {"b": 1}, "example": {"z": 1}},
            responses=[{"status_code": "200", "description": "ok", "schema_properties": None},
                       {"status_code": "404", "description": ""}],
            tags=["t"], confidence="high",
        ),
        point(request_body={}, tags=None, description=None),
        ("something_else", {}),
    )
    first, second = row["endpoints"]
    assert [(p["name"], p["required"], p["type"], p["example"]) for p in first["parameters"]] == [
        ("q", False, "integer", "0"), ("p", True, "string", '"x"'),
    ]
    body = first["request_body"]
    assert (body["content_type"], body["required"], body["example"]) == ("application/json", False, '{"z":1}')
    assert (body["schema"]["type"], body["schema"]["description"], body["schema"]["properties"]) == (
        "object", "d", '{"b":1}',
    )
    assert first["responses"][0]["schema"]["properties"] is None
    assert first["responses"][0]["schema"]["type"] == "object"
    assert first["responses"][1]["schema"] is None
    assert (second["request_body"], second["tags"], second["confidence"]) == (None, None, "medium")
    assert (row["confidence"], row["error"], first["source_url"]) == ("medium", None, "u")


BAD = [
    {"path": None}, {"path": 1}, {"method": "GET"}, {"method": None}, {"confidence": "sure"},
    {"parameters": None}, {"parameters": [{"location": "query"}]},
    {"parameters": [{"name": "a", "location": "body"}]},
    {"parameters": [{"name": "a", "location": "query", "type": "str"}]},
    {"parameters": [{"name": "a", "location": "query", "required": None}]},
    {"parameters": ["a"]}, {"request_body": "text"}, {"request_body": {"content_type": None}},
    {"request_body": {"schema_properties": "x"}}, {"responses": [{"status_code": 200, "description": ""}]},
    {"responses": [{"status_code": "200"}]}, {"tags": "a"}, {"tags": [1]}, {"summary": 1},
]


def test_one_bad_record_empties_its_page(spark):
    rows = [
        ("s", f"u{i:02}", [(n, json.dumps(v)) for n, v in (point(), point(**fields))], None)
        for i, fields in enumerate(BAD)
    ]
    frame = spark.createDataFrame(
        rows, f"site STRING, url STRING, records {schemas.TOOL_RECORDS}, error STRING"
    )
    for row in x.parse_records(frame).collect():
        bad = BAD[int(row["url"][1:])]
        assert (row["endpoints"], row["confidence"]) == ([], "low"), bad
        assert row["error"] == "invalid record", bad
    for row in x.parse_records(frame, on_error="row").collect():
        assert len(row["endpoints"]) == 1, BAD[int(row["url"][1:])]


def test_schemes_and_metadata(spark):
    row = parsed(
        spark,
        point(),
        ("record_api_metadata", {"title": "T", "description": "D", "base_url": "B"}),
        ("record_security_scheme", {"type": "apiKey", "name": "K", "location": "header"}),
        ("record_api_metadata", {"title": "T2"}),
    )
    assert (row["api_title"], row["api_description"], row["base_url"]) == ("T2", None, None)
    assert [(s["type"], s["location"]) for s in row["security_schemes"]] == [("apiKey", "header")]
    for bad in ({"type": "magic"}, {}, {"type": "http", "location": "path"}, {"type": "http", "name": 1}):
        assert parsed(spark, point(), ("record_security_scheme", bad))["endpoints"] == []
    assert parsed(spark, point(), ("record_api_metadata", {"title": 1}))["error"] == "invalid record"
    assert parsed(spark, error="boom")["error"] == "boom"
    assert parsed(spark, error="boom", on_error="row")["error"] == "boom"


def test_page_confidence(spark):
    from specloom.functions.records import page_confidence

    cases = [(8, 10, "high"), (7, 10, "medium"), (4, 10, "medium"), (3, 10, "low"), (0, 0, "low")]
    rows = [(w, [("high" if i < h else "low",) for i in range(n)]) for h, n, w in cases]
    frame = spark.createDataFrame(rows, "want STRING, e ARRAY<STRUCT<confidence: STRING>>")
    got = frame.select("want", page_confidence(F.col("e")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def documents(spark, *rows):
    rows = [("s", u, "T", t, c, md5(t)) for u, t, c in rows]
    return spark.createDataFrame(rows, DOCS)


def find(document):
    import re

    if "fail" in document["text"]:
        raise RuntimeError("no answer")
    for method, path in re.findall(r"\b(GET|POST|PUT|DELETE|PATCH) (/\S*)", document["text"]):
        yield "record_endpoint", {"path": path, "method": method.lower(), "summary": document["url"]}


SPEC = json.dumps({"openapi": "3.0.3", "paths": {"/e": {"get": {}}}})


def test_extract_results(spark):
    docs = documents(
        spark,
        ("u1", "GET /a and Bearer token", []),
        ("u2", "GET /a and Bearer token", []),
        ("u3", "nothing here", []),
        ("u4", "fail GET /x", []),
        ("u5", SPEC, [SPEC]),
        ("u6", "POST /cached", []),
        ("u7", "POST /stale", []),
        ("u8", '{"openapi":"3","paths":{}} ', ["GET /not/seen"]),
    )
    now = dt.datetime(2024, 1, 10)
    payload = {"endpoints": [{"path": "/from/cache", "method": "put", "confidence": "high"}], "security_schemes": []}
    entries = [
        (md5("POST /cached"), "llm", now - dt.timedelta(seconds=86400), json.dumps(payload)),
        (md5("POST /cached"), "llm", now - dt.timedelta(seconds=86401), "{}"),
        (md5("POST /stale"), "llm", now - dt.timedelta(seconds=86401), json.dumps(payload)),
        (md5("GET /a and Bearer token"), "http", now, json.dumps(payload)),
    ]
    cache = spark.createDataFrame(entries, schemas.CACHE)
    results, updates = x.extract_results(docs, find, cache, F.lit(now))
    got = {r["url"]: r for r in results.collect()}
    assert {u: (r["origin"], [e["path"] for e in r["endpoints"]]) for u, r in got.items()} == {
        "u1": ("extracted", ["/a"]),
        "u2": ("extracted", ["/a"]),
        "u5": ("embedded", ["/e"]),
        "u6": ("cache", ["/from/cache"]),
        "u7": ("extracted", ["/stale"]),
    }
    # Equal pages get the answer of the first one.
    assert got["u2"]["endpoints"][0]["summary"] == "u1"
    assert got["u2"]["endpoints"][0]["source_url"] == "u1"
    assert [s["scheme"] for s in got["u1"]["security_schemes"]] == ["bearer"]
    kept = {r["content_hash"]: r for r in updates.collect()}
    assert md5("fail GET /x") not in kept and md5("nothing here") in kept
    # What was cached answers the next run.
    again, none = x.extract_results(docs, find, updates.unionByName(cache), F.lit(now))
    origins = {r["url"]: r["origin"] for r in again.collect()}
    assert origins == {"u1": "cache", "u2": "cache", "u5": "embedded", "u6": "cache", "u7": "cache"}
    assert none.isEmpty()


def test_cache_lookup_boundary_and_stats(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [
        ("edge", "llm", now - dt.timedelta(seconds=3600), "old"),
        ("late", "llm", now - dt.timedelta(seconds=3601), "x"),
        ("two", "llm", now - dt.timedelta(seconds=100), "a"),
        ("two", "llm", now - dt.timedelta(seconds=50), "b"),
        ("page", "http", now, "é"),
    ]
    cache = spark.createDataFrame(rows, schemas.CACHE)
    docs = spark.createDataFrame([("s", u, u) for u in ("edge", "late", "two", "page", "new")], "site STRING, url STRING, content_hash STRING")
    got = {q["url"]: q["payload"] for q in k.cache_lookup(docs, cache, F.lit(now), 3600).collect()}
    assert got == {"edge": "old", "late": None, "two": "b", "page": None, "new": None}
    stats = k.cache_stats(cache, 3600).first()
    assert (stats["http_cache_count"], stats["llm_cache_count"], stats["cache_ttl_hours"]) == (1, 4, 1.0)
    assert stats["total_size_mb"] == pytest.approx((2 + 6) / 1048576)


SEARCHED = [
    ("/payments", "New payment", "Makes a payment transaction", ["Payments"]),
    ("/users", "List users", "Get all users", ["users"]),
    ("/auth/login", "User login", "Log a user in, get a token", ["Authentication"]),
    ("/products", "List products", None, None),
]


def searched(spark, rows=SEARCHED):
    rows = [("s", "u", i, p, "get", s, d, t) for i, (p, s, d, t) in enumerate(rows)]
    return spark.createDataFrame(
        rows,
        "site STRING, url STRING, seq INT, path STRING, method STRING, summary STRING, "
        "description STRING, tags ARRAY<STRING>",
    )


def test_relevance_scores(spark):
    def scores(query, rows=SEARCHED):
        frame = r.score_endpoints(searched(spark, rows), query)
        return {q["path"]: q["score"] for q in frame.collect()}

    assert set(scores("").values()) == {1.0} and set(scores("all the endpoints").values()) == {1.0}
    assert scores("payment endpoints") == {
        "/payments": pytest.approx(2 / 6 + 0.2), "/users": 0, "/auth/login": 0, "/products": 0,
    }
    user = scores("user")
    assert user["/users"] == pytest.approx(0.2) and user["/auth/login"] == pytest.approx(0.2)
    login = scores("authentication login")["/auth/login"]
    assert login == pytest.approx(4 / 8 + 0.2)
    assert all(0 <= v <= 1 for v in scores("größe user-profile").values())
    boosted = scores("payment", [("/api/payment/new", "Create", None, None), ("/api/create", "New payment", None, None)])
    assert boosted == {"/api/payment/new": pytest.approx(1 / 6 + 0.2), "/api/create": pytest.approx(1 / 6)}


def test_filter_rank_summary_and_site_queries(spark):
    frame = searched(spark)
    kept = r.filter_endpoints(frame, "payment user", 0.05)
    assert kept.count() <= frame.count()
    ranked = [q["path"] for q in r.rank_endpoints(kept).collect()]
    assert ranked == ["/payments", "/users", "/auth/login"]
    summary = r.filter_summary(frame, "payment", 0.3).first()
    assert (summary["original_count"], summary["filtered_count"]) == (4, 1)
    assert summary["top_matches"][0]["path"] == "/payments"
    nothing = r.filter_summary(frame, "zebra", 0.3).first()
    assert (nothing["filtered_count"], nothing["average_score"], nothing["top_matches"]) == (0, 0.0, [])
    queries = spark.createDataFrame([("s", "user"), ("s", "payment"), ("z", "user")], "site STRING, query STRING")
    both = r.score_site_queries(frame, queries)
    assert both.count() == 8
    for query in ("user", "payment"):
        one = {q["path"]: q["score"] for q in both.filter(F.col("query") == query).collect()}
        assert one == {q["path"]: q["score"] for q in r.score_endpoints(frame, query).collect()}


def test_an_entry_that_expires_during_the_run_keeps_its_page(spark):
    docs = documents(spark, ("u1", "GET /one", []), ("u2", "GET /two", []))
    payload = {"endpoints": [{"path": "/kept", "method": "get", "confidence": "high"}], "security_schemes": []}
    created = dt.datetime.now() - dt.timedelta(seconds=98)
    cache = spark.createDataFrame([(md5("GET /one"), "llm", created, json.dumps(payload))], schemas.CACHE)
    results, updates = x.extract_results(docs, find, cache, ttl_seconds=100)
    time.sleep(3)  # the limit passes between the run and the reading of its results
    got = {r["url"] for r in results.collect()}
    assert got == {"u1", "u2"} and updates.count() in (1, 2)


def test_a_text_counts_to_its_end(spark):
    from specloom.operators.content import extract_content

    long = "word " * 130_000
    rows = [("s", f"u{i}", 200, "text/html", f"<main><p>{long} {end}</p></main>", None) for i, end in enumerate(("GET /a Bearer token", "GET /b"))]
    docs = extract_content(spark.createDataFrame(rows, schemas.PAGES))
    results, _ = x.extract_results(docs, find)
    got = {r["url"]: r for r in results.collect()}
    assert {u: [e["path"] for e in r["endpoints"]] for u, r in got.items()} == {"u0": ["/a"], "u1": ["/b"]}
    assert [s["scheme"] for s in got["u0"]["security_schemes"]] == ["bearer"]


def test_plain_records_are_not_read_as_variant(spark, monkeypatch):
    """Every member has its type: one typed pass is enough."""
    from specloom.functions import records as f

    broken = lambda *values: F.raise_error(F.lit("read as VARIANT")).cast("boolean")
    monkeypatch.setattr(f.j, "is_string_list", broken)
    monkeypatch.setattr(f.j, "is_optional_string", broken)
    row = parsed(
        spark,
        point(
            summary="1-URGENT list",
            parameters=[{"name": "q", "location": "query", "type": "integer", "example": 0},
                        {"name": "p", "location": "path", "required": True, "example": "x"}],
            request_body={"description": "d", "schema_properties": {"b": 1}, "example": {"z": 1}},
            responses=[{"status_code": "200", "description": "ok", "content_type": "a/b"}],
            tags=["t"], confidence="high",
        ),
        point(),
        ("record_security_scheme", {"type": "apiKey", "name": "K", "location": "header"}),
        ("record_api_metadata", {"title": "T", "base_url": "B"}),
    )
    first, second = row["endpoints"]
    assert (first["summary"], first["tags"], first["confidence"]) == ("1-URGENT list", ["t"], "high")
    assert [tuple(p)[:6] for p in first["parameters"]] == [
        ("q", "query", None, False, "integer", "0"), ("p", "path", None, True, "string", '"x"'),
    ]
    body = first["request_body"]
    assert (body["description"], body["required"], body["content_type"], body["example"]) == ("d", False, "application/json", '{"z":1}')
    assert (body["schema"]["description"], body["schema"]["properties"]) == ("d", '{"b":1}')
    assert tuple(first["responses"][0]) == ("200", "ok", "a/b", None, None)
    assert (second["parameters"], second["request_body"], second["responses"], second["confidence"]) == ([], None, [], "medium")
    assert [(x["type"], x["name"], x["location"]) for x in row["security_schemes"]] == [("apiKey", "K", "header")]
    assert (row["api_title"], row["api_description"], row["base_url"]) == ("T", None, "B")


def test_records_in_doubt(spark):
    """Strings that look like other values stay strings; repeated keys and empty bodies as VARIANT has them."""
    for text in ("200", "-1.5e3", "true", "null", "{}", "[1]", '"q"', "NaN", "a, null", ""):
        row = parsed(spark, point(path=text, summary=text, tags=[text], request_body={"description": text}), ("record_api_metadata", {"title": text}))
        (found,) = row["endpoints"]
        assert (found["path"], found["summary"], found["tags"], found["request_body"]["description"]) == (text, text, [text], text)
        assert row["api_title"] == text
    twice = '{"path":"/a","method":"get","parameters":[{"name":"a","name":"b","location":"query"}]}'
    assert parsed(spark, ("record_endpoint", twice))["endpoints"][0]["parameters"] == []
    assert parsed(spark, ("record_endpoint", twice.replace(',"location"', ',"x"').replace('"name":"b"', '"y":1')))["endpoints"] == []
    assert parsed(spark, point(request_body={}))["endpoints"][0]["request_body"] is None
    assert parsed(spark, point(request_body={"x": 1}))["endpoints"][0]["request_body"]["content_type"] == "application/json"
