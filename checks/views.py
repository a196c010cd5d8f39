"""Derived tables: API documentation planted in the given tables, one SQL text for both engines.

Every view keeps all rows of the table it is made of. ``@orders`` stands for a given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import schemas
from specloom.workspace import total_bytes

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    # One site holds a third of all endpoints; seq is unique.
    "endpoints_raw": """
SELECT r.*, concat(site, '/p', lpad(concat('', page_id), 2, '0')) AS url FROM (
SELECT concat('https://s', lpad(concat('', CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey % 20 END), 2, '0'),
    '.example.com') AS site,
  o_orderkey AS seq, o_custkey % 97 AS page_id,
  concat(CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '/' END,
    CASE o_orderkey % 10 WHEN 0 THEN 'payments' WHEN 1 THEN 'users' WHEN 2 THEN 'auth/login'
      WHEN 3 THEN 'products' WHEN 4 THEN 'orders' WHEN 5 THEN 'search' WHEN 6 THEN 'reports'
      WHEN 7 THEN 'files' WHEN 8 THEN 'user-sessions' ELSE 'admin/config' END,
    CASE WHEN o_orderkey % 3 = 0 THEN '/{id}' ELSE '' END) AS path,
  CASE o_orderstatus WHEN 'O' THEN 'get' WHEN 'F' THEN 'post' ELSE 'delete' END AS method,
  concat(o_orderpriority, ' ', CASE o_custkey % 4 WHEN 0 THEN 'payment' WHEN 1 THEN 'user account'
    WHEN 2 THEN 'token' ELSE 'list' END) AS summary,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('Handles "', o_orderpriority, '" calls') END AS description,
  CASE o_custkey % 6 WHEN 0 THEN 'billing' WHEN 1 THEN 'people' END AS tag,
  CASE WHEN o_orderkey % 11 < 3 THEN 'high' WHEN o_orderkey % 11 < 8 THEN 'medium' ELSE 'low' END
    AS confidence,
  o_orderkey % 3 <> 1 AS has_params, o_orderkey % 5 = 0 AS has_body,
  o_custkey % 4 <> 0 AS has_responses, o_custkey % 7 < 2 AS has_example
FROM @orders) r""",
    # Documents with planted authentication sentences.
    "api_docs": """
SELECT doc_id, concat(CASE doc_id % 8
  WHEN 0 THEN 'Include your API key in the "X-API-Key" header.'
  WHEN 1 THEN 'Pass ?api_key=KEY as a URL query parameter.'
  WHEN 2 THEN 'Authorization: Bearer TOKEN (JWT).'
  WHEN 3 THEN 'Use HTTP Basic auth.'
  WHEN 4 THEN 'We support OAuth 2.0 with the authorization code flow.'
  WHEN 5 THEN 'Client credentials flow for machine-to-machine OAuth2.'
  WHEN 6 THEN 'Bearer token and API key in "X-Team-Key" header.'
  ELSE 'No credentials.' END, ' ', text) AS text
FROM @documents""",
    # Pages with planted urls, sentences, code and links.
    "site_pages": """
SELECT page_id, substr(url, 1, instr(substr(url, 9), '/') + 7) AS site, url,
  CASE WHEN page_id % 11 = 10 THEN 404 WHEN page_id % 13 = 12 THEN 204 ELSE 200 END AS status,
  CASE WHEN page_id % 9 = 8 THEN 'Application/JSON; charset=utf-8' ELSE 'text/html' END
    AS content_type, html
FROM (SELECT page_id, concat(CASE page_id % 6 WHEN 0 THEN 'https://api.example.com/docs/'
    WHEN 1 THEN 'https://shop.example.com/guide/' WHEN 2 THEN 'https://shop.example.com/about/'
    WHEN 3 THEN 'https://data.example.org/reference/' WHEN 4 THEN 'https://blog.example.net/'
    ELSE 'https://blog.example.net/help/' END, page_id) AS url,
  concat(html, CASE page_id % 5 WHEN 0 THEN '<p>The endpoint returns a JSON response body.</p>'
    WHEN 1 THEN '<pre><code>GET /users HTTP/1.1</code></pre>'
    WHEN 2 THEN '<p>{"openapi": "3.0.3"}</p>'
    WHEN 3 THEN '<a href="/api/reference">ref</a><a href="mailto:a@b.c">mail</a><a href="https://other.example.com/x">x</a>'
    ELSE '' END) AS html
  FROM @pages) p""",
    # Eight pages per site: usual paths, the start page, others. The start page links to three.
    "crawl_pages": """
SELECT page_id, site, concat(site, place) AS url, place,
  CASE WHEN page_id % 7 = 6 THEN 404 ELSE 200 END AS status, 'text/html' AS content_type,
  concat(html, CASE WHEN page_id % 5 < 2 THEN '<p>The endpoint returns a JSON response body.</p>'
    ELSE '' END, CASE WHEN place = '' THEN concat('<a href="/help">h</a><a href="', site,
    '/docs/x">d</a><a href="/graphql#top">no page</a><a href="graphql">g</a>') ELSE '' END) AS html
FROM (SELECT page_id, html,
    concat('https://c', CAST(floor(page_id / 8) AS BIGINT), '.example.com') AS site,
    CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN '/docs' WHEN 2 THEN '/help' WHEN 3 THEN '/docs/x'
      WHEN 4 THEN '/graphql' WHEN 5 THEN '/api/reference' WHEN 6 THEN '/about' ELSE '/blog' END
      AS place FROM @pages) p""",
    # One small description per order. Every 13th is broken JSON; "parameters" of the path and
    # "trace" are no operations; every 10th repeats a key.
    "spec_docs": """
SELECT seq AS spec_id, CASE WHEN seq % 13 = 0 THEN '{broken' ELSE concat(
  '{"openapi":"3.0.', seq % 4, '","info":{"title":"S', seq, '","version":"1"},"paths":{',
  CASE WHEN seq % 10 = 9 THEN concat('"/', seq % 50, '":{"get":{"summary":"dropped"}},') ELSE '' END,
  '"/', seq % 50, '":{"parameters":[],"', CASE WHEN seq % 6 = 1 THEN upper(method) ELSE method END,
  '":{"summary":"', summary, '"',
  CASE WHEN seq % 4 = 0 THEN ',"description":"told"' ELSE '' END,
  CASE WHEN has_params THEN
    ',"parameters":[{"name":"id","in":"query","schema":{"type":"string"}},{"name":"no","in":"moon"}]'
    ELSE '' END,
  CASE WHEN has_body THEN
    ',"requestBody":{"content":{"application/json":{"schema":{"type":"object"}}}}' ELSE '' END,
  CASE WHEN has_responses THEN concat(',"responses":{"200":{"description":"ok"',
    CASE WHEN has_example THEN ',"content":{"application/json":{"example":{"a":1}}}' ELSE '' END,
    '}}') ELSE '' END,
  '},"trace":{"summary":"t"}},"/second":{"put":{"responses":{"404":{"description":"n"},"200":{}}}}}',
  CASE WHEN seq % 8 = 0 THEN ',"components":{}' ELSE '' END, '}') END AS spec_json
FROM endpoints_raw""",
    "cache_rows": """
SELECT event_id AS cache_id, md5(concat('doc-', user_id)) AS content_hash,
  CASE WHEN event_id % 3 = 0 THEN 'http' ELSE 'llm' END AS kind, ts AS created_at,
  props AS payload
FROM @events""",
    # Every 5th sitemap is cut off; every 3rd site has both files.
    "sitemaps": """
SELECT site, priority, xml FROM (
SELECT concat('https://s', c_custkey, '.example.com') AS site, 1 + c_custkey % 2 AS priority,
  concat('<urlset><url><loc> https://s', c_custkey, '.example.com/docs/a?x=1&amp;y=2 </loc></url><url><loc>https://s',
    c_custkey, '.example.com/blog/', c_mktsegment, '</loc></url>',
    CASE WHEN c_custkey % 5 = 0 THEN '<url><loc>https://s/docs/cut' ELSE '</urlset>' END) AS xml
FROM @customer
UNION ALL
SELECT concat('https://s', c_custkey, '.example.com'), 2 - c_custkey % 2,
  concat('<urlset><loc>https://s', c_custkey, '.example.com/guides/', c_nationkey, '</loc></urlset>')
FROM @customer WHERE c_custkey % 3 = 0) m""",
    # Robots files; every 4th site has none, some answer 403 or 503.
    "robots_pages": """
SELECT c_custkey, concat('https://s', c_custkey, '.example.com') AS site,
  concat('https://s', c_custkey, '.example.com/robots.txt') AS url,
  CASE WHEN c_custkey % 9 = 5 THEN 403 WHEN c_custkey % 9 = 7 THEN 404 ELSE 200 END AS status,
  'text/plain' AS content_type,
  concat('User-agent: SlowBot', chr(10), 'Crawl-delay: ', c_nationkey, chr(10), 'Disallow: /slow',
    chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /private # all of it', chr(10),
    'Allow: /private/docs', chr(10), 'Disallow: /admin', chr(10),
    CASE WHEN c_custkey % 2 = 0 THEN concat('Sitemap: https://s', c_custkey, '.example.com/sitemap.xml')
      ELSE '' END, chr(10)) AS html
FROM @customer WHERE c_custkey % 4 <> 0""",
    # A third of the urls are on one site.
    "robots_urls": """
SELECT o_orderkey, concat('https://s', k, '.example.com') AS site,
  concat('https://s', k, '.example.com', CASE o_orderkey % 6 WHEN 0 THEN '/private/x'
    WHEN 1 THEN '/private/docs' WHEN 2 THEN '/admin' WHEN 3 THEN '/slow/' WHEN 4 THEN '' ELSE '/api' END,
    CASE WHEN o_orderkey % 4 = 0 THEN concat('?n=', o_orderkey) ELSE '' END) AS url
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS k FROM @orders) o""",
    # What an extraction function recorded on a page: two endpoints, a scheme, sometimes metadata.
    # Every 17th page has a bad method, every 19th a missing path.
    "record_pages": """
SELECT site, concat(site, '/r', lpad(concat('', seq), 9, '0')) AS url, seq,
  concat('{"path":"', path, '","method":"', CASE WHEN seq % 17 = 0 THEN 'fetch' ELSE method END,
    '","summary":"', summary, '","confidence":"', confidence, '"',
    CASE WHEN has_params THEN
      ',"parameters":[{"name":"id","location":"path","type":"integer","required":true,"example":7}]'
      ELSE '' END,
    CASE WHEN has_body THEN
      ',"request_body":{"description":"b","schema_properties":{"a":{"type":"string"}}}' ELSE '' END,
    CASE WHEN has_responses THEN
      ',"responses":[{"status_code":"200","description":"ok","example":"e"},{"status_code":"404","description":"no","schema_properties":{"m":1}}]'
      ELSE '' END, '}') AS first_input,
  CASE WHEN seq % 19 = 0 THEN '{"method":"get","summary":"x"}'
    ELSE '{"path":"/status","method":"get","summary":"x","confidence":"high"}' END AS second_input,
  CASE WHEN seq % 3 = 0 THEN '{"type":"http","scheme":"bearer"}'
    ELSE '{"type":"apiKey","name":"K","location":"header"}' END AS scheme_input,
  CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 5 = 1 THEN '{"title":""}'
    ELSE concat('{"title":"T', seq % 1000, '","description":"D', seq % 7, '"}') END AS meta_input
FROM endpoints_raw""",
    # Search queries made of order priorities and part names.
    "search_queries": """
SELECT p_partkey, concat('Show all ', p_name, ' ', CASE p_partkey % 7 WHEN 0 THEN 'payment endpoints'
  WHEN 1 THEN 'user' WHEN 2 THEN 'auth and Login' WHEN 3 THEN 'admin, email' WHEN 4 THEN 'cart'
  WHEN 5 THEN 'report-file' ELSE 'the API' END) AS query
FROM @part""",
}


def _closure(names) -> list[str]:
    """The views needed, dependencies first."""
    needed = []
    for name in names:
        text = VIEWS[name]
        for other in _closure([v for v in VIEWS if v != name and f"FROM {v}" in text]) + [name]:
            if other not in needed:
                needed.append(other)
    return needed


def _with(sql: str, names, table) -> str:
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _closure(names)]
    text = f"WITH {', '.join(parts)} {sql.strip()}" if parts else sql.strip()
    for name in sorted(TABLES, key=len, reverse=True):
        text = text.replace(f"@{name}", table(name))
    return text


def oracle(sql: str, *views: str) -> str:
    """DuckDB text: the views as common table expressions, then the question."""
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        # One WITH list only.
        head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in _closure(views))
        sql = f"WITH {head}, {sql[5:]}" if head else sql
        for name in sorted(TABLES, key=len, reverse=True):
            sql = sql.replace(f"@{name}", name)
        return sql
    return _with(sql, views, lambda name: name)


def view(spark: SparkSession, folder: str, name: str, early: bool = False) -> DataFrame:
    """A derived table. ``early`` spreads the given tables, whose rows are far narrower than those with the planted
    texts; rows then lie in other places, which shows where a result numbers rows of equal keys."""
    if not early:
        return spread(spark.sql(_with(f"SELECT * FROM {name}", [name], lambda t: f"parquet.`{folder}/{t}.parquet`")))
    text = _with(f"SELECT * FROM {name}", [name], lambda t: f"\0{t}\0")
    given = {t: table(spark, folder, t) for t in TABLES if f"\0{t}\0" in text}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in given:
        text = text.replace(f"\0{t}\0", f"{{{t}}}")
    return spark.sql(text, **given)


BYTES_PER_TASK = 4 * 1024 * 1024


def spread(frame: DataFrame) -> DataFrame:
    """A table of fewer files than its size asks for, which Spark reads in as many tasks, spread over more; others as
    they are. The number follows the bytes, so that a task stays short on a large table."""
    spark, files = frame.sparkSession, frame.inputFiles()
    tasks = max(spark.sparkContext.defaultParallelism, -(-total_bytes(spark, files) // BYTES_PER_TASK))
    return frame.repartition(tasks) if len(files) < tasks else frame


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """``endpoints_raw`` as typed endpoints."""
    c = F.col
    raw = view(spark, folder, "endpoints_raw")
    example = c("has_example")
    in_params = example & c("has_params")
    in_body = example & ~c("has_params") & c("has_body")
    in_responses = example & ~c("has_params") & ~c("has_body")
    null = F.lit(None).cast("string")
    parameter = F.struct(
        F.lit("id"), F.when(c("path").contains("{id}"), "path").otherwise("query"), null,
        c("path").contains("{id}"), F.lit("string"), F.when(in_params, '"x"'), null,
    )
    body_schema = F.struct(
        F.lit("object"), null, F.lit('{"a":{"type":"string"}}'), null, F.array(F.lit("a")), null,
        F.lit(False),
    ).cast(schemas.SCHEMA)
    body = F.struct(
        c("description"), c("seq") % 2 == 0, F.lit("application/json"),
        F.when(c("seq") % 4 == 0, body_schema), F.when(in_body, '{"a":1}'),
    )
    response = F.struct(
        F.lit("200"), F.lit("ok"), F.lit("application/json"),
        F.when(c("seq") % 3 == 0, body_schema), F.when(in_responses, "1"),
    )
    nothing = F.array()
    return raw.select(
        "site", "url", "seq", "path", "method", "summary", "description",
        F.when(c("seq") % 17 == 0, F.concat(F.lit("op"), c("seq"))).alias("operation_id"),
        F.when(c("tag").isNotNull(), F.array("tag")).otherwise(nothing.cast("array<string>")).alias("tags"),
        F.when(c("has_params"), F.array(parameter)).otherwise(nothing)
        .cast(f"array<{schemas.PARAMETER}>").alias("parameters"),
        F.when(c("has_body"), body).cast(schemas.REQUEST_BODY).alias("request_body"),
        F.when(c("has_responses"), F.array(response)).otherwise(nothing)
        .cast(f"array<{schemas.RESPONSE}>").alias("responses"),
        (c("seq") % 23 == 0).alias("deprecated"),
        "confidence",
        c("url").alias("source_url"),
    )


def records(spark: SparkSession, folder: str, early: bool = False) -> DataFrame:
    """``record_pages`` as the output of an extraction function."""
    pairs = [
        ("record_endpoint", "first_input"),
        ("record_security_scheme", "scheme_input"),
        ("record_endpoint", "second_input"),
        ("record_api_metadata", "meta_input"),
    ]
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(v).alias("input")) for n, v in pairs])
    return view(spark, folder, "record_pages", early).select(
        "site", "url", "seq",
        F.filter(listed, lambda r: r["input"].isNotNull()).cast(schemas.TOOL_RECORDS).alias("records"),
        F.lit(None).cast("string").alias("error"),
    )


def pages(spark: SparkSession, folder: str, name: str = "site_pages") -> DataFrame:
    return view(spark, folder, name).withColumn("fetched_at", F.lit(None).cast("timestamp"))
