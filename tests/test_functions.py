"""Column expressions against hand-derived values and the Python standard library."""

import hashlib
import itertools
import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from specloom.functions import auth
from specloom.functions import jsontext as j
from specloom.functions import text as t
from specloom.functions import urls as u
from specloom.functions.relevance import keywords, query_keywords
from specloom.operators.merge import normalize_path, operation_id


def evaluate(spark, make, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    rows = frame.select("i", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_strip_takes_every_white_space(spark):
    values = ["  a b\t", "\n\x1c x   ", "\x85y\x1f", "", " \n ", "z"]
    assert evaluate(spark, t.strip, values) == [v.strip() for v in values]


def test_clean_text(spark):
    values = [
        "GET\nPOST\n\n \n\nlong   line here\nab\nabcd",
        "  x  \n\n\n\nwords and words",
        "a\x85\n\t\n\nbcde",
    ]
    assert evaluate(spark, t.clean_text, values) == [
        "POST\n\nlong line here\nabcd",
        "words and words",
        "bcde",
    ]


def test_title_estimate_hash(spark, one):
    frame = spark.createDataFrame(
        [(" T \n", "H"), (None, " H "), ("", "H"), (" ", "H"), (None, None), (None, "")],
        "t STRING, h STRING",
    )
    got = [r[0] for r in frame.select(t.page_title(F.col("t"), F.col("h"))).collect()]
    assert got == ["T", "H", "H", "", "Untitled", ""]
    assert one(t.token_estimate, "a STRING, b ARRAY<STRING>", "abcdé", ["xyz", "12345"]) == 3
    long = "é" * 60_000
    assert one(t.content_hash, "v STRING", long) == hashlib.md5(long[:50_000].encode()).hexdigest()


def test_prompt(one):
    got = one(
        t.document_prompt,
        "u STRING, t STRING, x STRING, s ARRAY<STRING>",
        "U", "T", "text", [f"s{i}" for i in range(12)],
    )
    assert got.startswith("URL: U\nTitle: T\n\ntext\n\nCode Samples:\n\nSample 1:\n```\ns0\n```\n")
    assert "Sample 10:" in got and "Sample 11:" not in got
    assert one(lambda v: t.truncate(v, 3), "v STRING", "abcd") == "abc\n\n[... truncated ...]"
    assert one(lambda v: t.truncate(v, 4), "v STRING", "abcd") == "abcd"


def test_resolve_url_equals_standard_library(spark):
    bases = [
        "https://h.example.com/a/b/c?x=1#f",
        "https://h.example.com",
        "http://u@h.example.com:8080/a/",
        "https://h.example.com/a/./b/../c",
    ]
    links = [
        "", "d", "./d", "../d", "../../../d", "/d/./e/../f", "//o.example.com/z", "?q=1", "#s",
        "mailto:a@b.c", "javascript:void(0)", "https://o.example.com/p", "d/", "d/..", "d/.",
        "..", ".", "a//b", " /lead", "d?x=../y", "../d#../z", "/", "g;x=1/../y",
    ]
    pairs = list(itertools.product(bases, links))
    frame = spark.createDataFrame([(i, b, v) for i, (b, v) in enumerate(pairs)], "i INT, b STRING, v STRING")
    rows = frame.select("i", u.resolve_url(F.col("b"), F.col("v")).alias("r")).collect()
    got = {r["i"]: r["r"] for r in rows}
    wrong = [(p, got[i], urljoin(*p)) for i, p in enumerate(pairs) if got[i] != urljoin(*p)]
    assert wrong == []


def test_url_parts(spark):
    assert evaluate(spark, u.netloc, ["https://u@h:1/x", "mailto:a@b", "/p", "//h/x"]) == [
        "u@h:1", "", "", "h",
    ]
    assert evaluate(spark, u.normalize_base_url, ["a.b", "http://a", "https://a"]) == [
        "https://a.b", "http://a", "https://a",
    ]
    assert evaluate(spark, u.site_file_name, ["https://api.example.com/v1"]) == ["api_example_com"]
    assert evaluate(spark, u.is_likely_doc_url, ["https://api.x.com/", "https://x.com/about"]) == [
        True, False,
    ]


def test_is_api_documentation(spark):
    frame = spark.createDataFrame(
        [
            (1, "https://x.com/api/v1/docs", ""),
            (2, "https://x.com/docs", "an API endpoint"),
            (3, "https://x.com/docs", "an endpoint"),
            (4, "https://x.com/about", '{"OpenAPI": 1}'),
            (5, "https://x.com/about", "get post put delete json"),
            (6, "https://x.com/about", "get post put delete"),
            (7, "https://x.com/about", "GET /a POST /b"),
        ],
        "i INT, url STRING, html STRING",
    )
    rows = frame.select("i", u.is_api_documentation(F.col("url"), F.col("html")).alias("r"))
    assert {r["i"]: r["r"] for r in rows.collect()} == {
        1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False,
    }


def test_operation_id_and_path(spark):
    frame = spark.createDataFrame(
        [("get", "/users/{id}/profile"), ("get", "/"), ("post", "a-b//{x}.json/")],
        "m STRING, p STRING",
    )
    got = [r[0] for r in frame.select(operation_id(F.col("m"), F.col("p"))).collect()]
    assert got == ["get_users_by_id_profile", "get_", "post_a_b_by_id_json"]
    assert evaluate(spark, normalize_path, ["users", "/users"]) == ["/users", "/users"]


AUTH = [
    ('Include your API key in the header.\nUse "X-API-Key".', [("apiKey", "header")]),
    ("Pass ?api_key=KEY as a URL query parameter", [("apiKey", "query")]),
    ("Bearer token authentication", [("http", "bearer")]),
    ("Use HTTP Basic Authentication", [("http", "basic")]),
    ("We support OAuth 2.0 with the authorization code flow", [("oauth2", None)]),
    ("api key ſent in the HEADER", [("apiKey", "header")]),
    (
        "API key as query parameter\nBearer token\nBasic auth\nOAuth 2.0",
        [("apiKey", "query"), ("http", "bearer"), ("http", "basic"), ("oauth2", None)],
    ),
    ("api key\nheader", []),
]


@pytest.mark.parametrize("text,expected", AUTH)
def test_detect_auth_schemes(one, text, expected):
    got = one(auth.detect_auth_schemes, "v STRING", text)
    assert [(s["type"], s["location"] or s["scheme"]) for s in got] == expected


def test_auth_details(one):
    jwt = one(auth.detect_auth_schemes, "v STRING", "Send the JWT as a Bearer token")[0]
    assert (jwt["bearer_format"], jwt["description"]) == ("JWT", "Bearer token authentication (JWT)")
    oauth = one(auth.detect_auth_schemes, "v STRING", "oauth2: authorization code, implicit flow")
    assert oauth[0]["description"] == "OAuth 2.0 (authorization_code, implicit)"
    assert one(auth.auth_header_name, "v STRING", "header `x-Auth-Token`") == "x-Auth-Token"
    assert one(auth.auth_header_name, "v STRING", "'X-My-Key' is the header") == "X-My-Key"
    assert one(auth.auth_header_name, "v STRING", "X-Other header") == "X-API-Key"


def test_merge_security_schemes(one):
    schema = (
        "g ARRAY<STRUCT<type:STRING,name:STRING,location:STRING,scheme:STRING,"
        "bearer_format:STRING,description:STRING>>, v STRING"
    )
    bearer = ("http", None, None, "bearer", None, "given")
    key = ("apiKey", "K", "header", None, None, "given")
    text = "API key in the header. Bearer token."

    def merged(given):
        got = one(
            lambda g, v: auth.merge_security_schemes(g, auth.detect_auth_schemes(v)), schema,
            given, text,
        )
        return [(s["type"], s["description"] == "given") for s in got]

    assert merged([bearer]) == [("http", True), ("apiKey", False)]
    assert merged([key, bearer]) == [("apiKey", True), ("http", True)]
    assert merged([]) == [("apiKey", False), ("http", False)]
    assert merged([("apiKey", None, None, None, None, "given")]) == [
        ("apiKey", True), ("apiKey", False), ("http", False),
    ]


def test_keywords(spark):
    queries = ["payment endpoints", "user", "authentication login", "", "only the API", "Größe 2²x"]
    want = [sorted(query_keywords(q)) for q in queries]
    assert evaluate(spark, keywords, queries) == want
    assert want[0] == ["billing", "charge", "invoice", "pay", "payment", "transaction"]
    assert want[4] == []


def test_canonical_json_equals_standard_library(spark):
    texts = [
        '{"a":1}', "{'a':1}", '{"a":1} x', '{"a":1}],[1', '{"a":1}} ', '{"a":1},{"b":2}',
        '{"a":1,"b":{"c":1,"c":2},"a":3}', '{"a":NaN}', "[1,2]", '"x"', "", "nul", " null ",
        '{"a":1,}', '{"a":"x\ny"}', '{"é":"\\u00e9"}', '1,"k":2', "}", "1 2",
    ]

    def want(v):
        try:
            return json.loads(v)
        except ValueError:
            return "broken"

    got = evaluate(spark, j.canonical, texts)
    read = ["broken" if g is None else json.loads(g) for g in got]
    assert [json.dumps(g) for g in read] == [json.dumps(want(v)) for v in texts]


def test_json_truth_and_strings(spark):
    values = ["null", '""', "false", "0", "0.0", "-0", "[]", "{}", '"0"', "1", "true", "[0]", None]
    assert evaluate(spark, j.is_truthy, values) == [False] * 8 + [True] * 4 + [False]
    texts = ['a"b', "x/y\\", "é\n\x01", ""]
    assert [json.loads(v) for v in evaluate(spark, j.string, texts)] == texts


def test_auth_words_are_needed_by_every_pattern():
    from specloom import patterns as p

    for family, found_by in p.AUTH_PATTERNS.items():
        for pattern in found_by:
            assert any(word in pattern for word in p.AUTH_WORDS[family]), pattern
