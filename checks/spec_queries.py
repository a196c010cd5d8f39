"""Queries over API descriptions: reading, exploding, judging and assembling them."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.endpoint_queries import BEST, LOW, QUERY, SCORED, UNIQUE, VALID
from checks.registry import query
from checks.views import endpoints, records, view
from specloom import schemas
from specloom.functions import jsontext as j
from specloom.functions import specs as sp
from specloom.operators import build, extraction, merge, relevance, specs
from specloom.sources import tables
from specloom.workspace import materialize, new_folder

c = F.col


def spec_docs(spark, folder):
    return view(spark, folder, "spec_docs")


@query(
    "s5_read_specs",
    "spec_docs",
    sql="""SELECT spec_id, CASE WHEN json_valid(spec_json) THEN json_extract_string(spec_json, '$.openapi')
    ELSE 'unknown' END AS version,
  CASE WHEN json_valid(spec_json) THEN len(list_distinct(json_keys(spec_json, '$.paths'))) ELSE 0 END AS paths_count,
  NOT json_valid(spec_json) AS is_error FROM spec_docs""",
)
def read_specs(spark, folder):
    return specs.parse_specs(spec_docs(spark, folder)).select(
        "spec_id", "version", "paths_count", c("error").isNotNull().alias("is_error")
    )


@query(
    "s6_write_specs",
    "spec_docs",
    sql="""SELECT spec_id, concat('api', spec_id, '_example_com.openapi.json') AS file_name,
  strlen(spec_json) AS size_bytes, 'json' AS format, md5(spec_json) AS text_hash FROM spec_docs""",
)
def write_specs(spark, folder):
    """All documents written to an archive and read back."""
    site = F.concat(F.lit("https://api"), "spec_id", F.lit(".example.com/v1"))
    docs = spec_docs(spark, folder).select(site.alias("site"), F.lit(0).cast("long").alias("part"), "spec_json")
    path = new_folder(spark, "archive")
    tables.write_archive(docs, path)
    number = F.regexp_extract("site", "api([0-9]+)", 1).cast("long")
    return tables.read_archive(spark, path).select(
        number.alias("spec_id"), "file_name", "size_bytes", "format", F.md5("spec_json").alias("text_hash")
    )


@query(
    "f9_method_filter",
    "spec_docs",
    "endpoints_raw",
    sql="""SELECT seq AS spec_id, CASE WHEN seq % 13 <> 0 THEN 2 ELSE 0 END AS n_spec_methods,
  CASE WHEN seq % 13 = 0 THEN 0 WHEN seq % 6 = 1 THEN 1 ELSE 2 END AS n_advice_methods
FROM endpoints_raw""",
)
def method_filter(spark, folder):
    canonical = spec_docs(spark, folder).select("spec_id", j.canonical(c("spec_json")).alias("spec"))
    advised = sp.operations(c("spec"), schemas.ADVICE_METHODS, any_case=False)
    return canonical.select(
        "spec_id",
        F.coalesce(F.size(sp.operations(c("spec"))), F.lit(0)).alias("n_spec_methods"),
        F.coalesce(F.size(advised), F.lit(0)).alias("n_advice_methods"),
    )


@query(
    "x1_explode_spec",
    "spec_docs",
    "endpoints_raw",
    sql="""SELECT seq AS spec_id, 0 AS seq, concat('/', seq % 50) AS path, method, summary,
  CASE WHEN seq % 4 = 0 THEN 'told' END AS description,
  CASE WHEN has_params THEN 'id:query:string:false' ELSE '' END AS parameters,
  CASE WHEN has_responses THEN '200=ok' ELSE '' END AS responses FROM endpoints_raw WHERE seq % 13 <> 0
UNION ALL SELECT seq, 1, '/second', 'put', '', NULL, '', '404=n,200=' FROM endpoints_raw WHERE seq % 13 <> 0""",
)
def explode_spec(spark, folder):
    rows = specs.explode_spec(spec_docs(spark, folder))
    parameters = F.transform(
        "parameters",
        lambda q: F.concat_ws(":", q["name"], q["location"], q["type"], q["required"].cast("string")),
    )
    responses = F.transform("responses", lambda r: F.concat_ws("=", r["status_code"], r["description"]))
    return rows.select(
        "spec_id", "seq", "path", "method", "summary", "description",
        F.array_join(parameters, ",").alias("parameters"),
        F.array_join(responses, ",").alias("responses"),
    )


@query(
    "x2_find_embedded_spec",
    "spec_docs",
    sql="""SELECT spec_id, CASE WHEN spec_id % 5 < 3 AND spec_id % 13 <> 0 THEN 2 ELSE 0 END AS n_endpoints
FROM spec_docs""",
)
def find_embedded_spec(spark, folder):
    kind, spec = c("spec_id") % 5, c("spec_json")
    swagger = F.replace(spec, F.lit('"openapi"'), F.lit('"swagger"'))
    prose = F.lit('See "openapi" and its "paths" below')
    text = F.when(kind == 0, F.concat(F.lit("\n "), spec)).when(kind == 4, swagger).otherwise(prose)
    samples = (
        F.when(kind == 1, F.array(F.lit("curl https://x"), spec))
        .when(kind == 2, F.array(F.lit('{"paths" "swagger"'), swagger))
        .otherwise(F.array(F.lit('a sample with "paths" only')))
    )
    documents = spec_docs(spark, folder).select(
        "spec_id", text.alias("text"), samples.alias("code_samples")
    )
    found = specs.find_embedded_spec(documents)
    n = F.size(sp.spec_endpoints(c("embedded_spec"), F.lit("")))
    return found.select("spec_id", F.coalesce(n, F.lit(0)).alias("n_endpoints"))


PERCENTS = """judged AS (SELECT seq, seq % 13 <> 0 AS good, has_params AS p, has_body AS b, has_responses AS r,
    has_responses AND has_example AS e, seq % 8 = 0 AS secured FROM endpoints_raw)"""


@query(
    "a5_spec_coverage",
    "endpoints_raw",
    sql=f"""WITH {PERCENTS} SELECT seq AS spec_id, CASE WHEN good THEN 2 ELSE 0 END::BIGINT AS total_endpoints,
  CASE WHEN good THEN CASE WHEN p THEN 50.0 ELSE 0.0 END END::DOUBLE AS pct_parameters,
  CASE WHEN good THEN CASE WHEN b THEN 50.0 ELSE 0.0 END END::DOUBLE AS pct_request_body,
  CASE WHEN good THEN CASE WHEN r THEN 100.0 ELSE 50.0 END END::DOUBLE AS pct_responses,
  CASE WHEN good THEN CASE WHEN e THEN 50.0 ELSE 0.0 END END::DOUBLE AS pct_examples FROM judged""",
)
def spec_coverage(spark, folder):
    return specs.spec_coverage(spec_docs(spark, folder)).drop("recommendations", "error")


@query(
    "a6_spec_coverage_recommendations",
    "endpoints_raw",
    sql=f"""WITH {PERCENTS} SELECT seq AS spec_id, CASE WHEN NOT good THEN '' ELSE concat_ws('|',
  CASE WHEN NOT p THEN 'Add parameter definitions to more endpoints' END,
  CASE WHEN NOT b THEN 'Document request body schemas for POST/PUT/PATCH endpoints' END,
  CASE WHEN NOT r THEN 'Add response schemas and status codes' END,
  CASE WHEN NOT e THEN 'Include examples for requests and responses' END,
  CASE WHEN NOT secured THEN 'Consider adding security schemes if the API requires authentication' END) END
  AS recommendations FROM judged""",
)
def spec_coverage_recommendations(spark, folder):
    judged = specs.spec_coverage(spec_docs(spark, folder))
    advice = F.coalesce(F.array_join("recommendations", "|"), F.lit(""))
    return judged.select("spec_id", advice.alias("recommendations"))


@query(
    "a7_spec_recommendations",
    "endpoints_raw",
    sql="""SELECT seq AS spec_id, CASE WHEN seq % 13 = 0 THEN '' ELSE concat_ws('|',
  CASE WHEN seq % 6 = 1 THEN 'Consider adding descriptions to 1/1 operations'
    WHEN seq % 4 = 0 THEN 'Consider adding descriptions to 1/2 operations'
    ELSE 'Consider adding descriptions to 2/2 operations' END,
  CASE WHEN seq % 6 = 1 THEN 'Consider adding examples to 1/1 operations'
    WHEN has_responses AND has_example THEN 'Consider adding examples to 1/2 operations'
    ELSE 'Consider adding examples to 2/2 operations' END,
  CASE WHEN seq % 8 <> 0 THEN 'Consider adding security schemes if the API requires authentication' END) END
  AS recommendations FROM endpoints_raw""",
)
def spec_recommendations(spark, folder):
    advised = specs.spec_recommendations(spec_docs(spark, folder))
    return advised.select("spec_id", F.array_join("recommendations", "|").alias("recommendations"))


@query(
    "b11_validate_specs",
    "endpoints_raw",
    sql="""WITH broken AS (
  SELECT seq AS spec_id, 'is_json_object' AS err FROM endpoints_raw WHERE seq % 13 = 0
  UNION ALL SELECT seq, 'response_description: PUT /second' FROM endpoints_raw WHERE seq % 13 <> 0
  UNION ALL SELECT seq, concat('responses_required: ', upper(method), ' /', seq % 50) FROM endpoints_raw
    WHERE seq % 13 <> 0 AND seq % 6 <> 1 AND NOT has_responses
  UNION ALL SELECT seq, concat('parameter_location: ', upper(method), ' /', seq % 50) FROM endpoints_raw
    WHERE seq % 13 <> 0 AND seq % 6 <> 1 AND has_params
  UNION ALL SELECT seq, concat('responses_required: TRACE /', seq % 50) FROM endpoints_raw WHERE seq % 13 <> 0)
SELECT spec_id, false AS is_valid, string_agg(err, '|' ORDER BY err) AS errors FROM broken GROUP BY spec_id""",
)
def validate_specs(spark, folder):
    judged = specs.validate_specs(spec_docs(spark, folder))
    return judged.select("spec_id", "is_valid", F.array_join("errors", "|").alias("errors"))


ODD = """odd AS (SELECT seq, seq % 12 AS k, concat('{"openapi":"3.1.0","info":{"title":"T","version":"1"},"paths":{"/', seq, '":{"get":{"operationId":"o', seq,
    '","responses":{"', CASE WHEN seq % 12 = 1 THEN '20' ELSE '200' END, '":{"description":"ok"',
    CASE seq % 12 WHEN 2 THEN ',"content":{"a/b":{"schema":{"$ref":"#/components/schemas/B"}}}'
      WHEN 3 THEN ',"content":{"a/b":{"schema":{"$ref":"#/components/schemas/A"}}}'
      WHEN 4 THEN ',"content":{"a/b":{"schema":{"type":"array"}}}' ELSE '' END, '}}',
    CASE seq % 12 WHEN 5 THEN ',"parameters":[{"name":"q","in":"query"},{"name":"q","in":"query"}]'
      WHEN 6 THEN ',"parameters":[{"name":"q","in":"query"},{"name":"q","in":"header"}]' ELSE '' END,
    CASE WHEN seq % 12 = 7 THEN ',"requestBody":{"description":"none"}' ELSE '' END, '}}},"tags":[{"name":"a"}',
    CASE WHEN seq % 12 = 8 THEN ',{"name":"a"}' ELSE ',{"name":"b"}' END, '],"components":{"schemas":{"A":{"type":"object"}},"securitySchemes":{',
    CASE seq % 12 WHEN 9 THEN '"s":{"type":"apiKey","name":"k"}' WHEN 10 THEN '"s":{"type":"oauth2"}'
      WHEN 11 THEN '"s":{"type":"http","scheme":"basic"}' ELSE '' END, '}}}') AS spec_json FROM endpoints_raw)"""


@query(
    "b11_more_rules",
    "endpoints_raw",
    sql=f"""WITH {ODD} SELECT seq AS spec_id, CASE k WHEN 1 THEN concat('status_code: GET /', seq)
    WHEN 2 THEN 'reference_resolved: #/components/schemas/B' WHEN 4 THEN concat('array_items: GET /', seq)
    WHEN 5 THEN concat('parameter_unique: GET /', seq) WHEN 7 THEN concat('request_body_content: GET /', seq)
    WHEN 8 THEN 'tag_unique' WHEN 9 THEN 'security_scheme_fields: s' WHEN 10 THEN 'security_scheme_fields: s' ELSE '' END AS errors,
  k NOT IN (1, 2, 4, 5, 7, 8, 9, 10) AS is_valid FROM odd""",
)
def more_rules(spark, folder):
    view(spark, folder, "endpoints_raw").createOrReplaceTempView("endpoints_raw")
    odd = spark.sql(f"WITH {ODD} SELECT seq AS spec_id, spec_json FROM odd")
    judged = specs.validate_specs(odd)
    return judged.select("spec_id", "is_valid", F.array_join("errors", "|").alias("errors"))


@query(
    "u3_spec_path_diff",
    "endpoints_raw",
    sql="""SELECT seq AS spec_id, '/second' AS path, 'official' AS side FROM endpoints_raw WHERE seq % 13 <> 0 AND seq % 2 = 0
UNION ALL SELECT seq, '/third', 'generated' FROM endpoints_raw WHERE seq % 13 <> 0 AND seq % 2 = 0""",
)
def spec_path_diff(spark, folder):
    official = spec_docs(spark, folder)
    renamed = F.replace("spec_json", F.lit('"/second"'), F.lit('"/third"'))
    text = F.when(c("spec_id") % 2 == 0, renamed).otherwise(c("spec_json"))
    return specs.spec_path_diff(official, official.select("spec_id", text.alias("spec_json")))


# -- assembly --------------------------------------------------------------------------------------

METAS = f"""metas AS (SELECT site,
    arg_min(concat('T', seq % 1000), url) FILTER (WHERE {VALID} AND seq % 5 >= 2) AS title,
    arg_min(concat('D', seq % 7), url) FILTER (WHERE {VALID} AND seq % 5 >= 2) AS description
  FROM record_pages GROUP BY site)"""


@query(
    "b1_build_info",
    "record_pages",
    sql=f"""WITH {METAS} SELECT site, concat('{{"title":"', coalesce(title, concat(substr(site, 9), ' API')),
  '","version":"1.0.0","description":"', coalesce(description, concat('API specification generated from ', site)),
  '"}}') AS info FROM metas""",
)
def build_info(spark, folder):
    metadata = merge.first_non_empty_metadata(extraction.parse_records(records(spark, folder)))
    info = build.build_info(c("site"), c("api_title"), c("api_description"))
    return metadata.select("site", info.alias("info"))


@query(
    "b2_build_servers",
    "endpoints_raw",
    sql="""SELECT seq, concat('[{"url":"', CASE seq % 3 WHEN 0 THEN site WHEN 1 THEN concat('https://v', seq, '.example.com')
  ELSE concat('http://v', seq, '.example.com') END, '","description":"API server"}]') AS servers FROM endpoints_raw""",
)
def build_servers(spark, folder):
    host = F.concat(F.lit("v"), "seq", F.lit(".example.com"))
    base = F.when(c("seq") % 3 == 1, host).when(c("seq") % 3 == 2, F.concat(F.lit("http://"), host))
    rows = view(spark, folder, "endpoints_raw")
    return rows.select("seq", build.build_servers(c("site"), base).alias("servers"))


PARAMETER = """concat('{"name":"id","in":"', CASE WHEN path LIKE '%{id}%' THEN 'path' ELSE 'query' END, '","required":',
    CASE WHEN path LIKE '%{id}%' THEN 'true' ELSE 'false' END, ',"schema":{"type":"string"}',
    CASE WHEN has_example THEN ',"example":"x"' ELSE '' END, '}')"""
FULL_SCHEMA = '{"type":"object","properties":{"a":{"type":"string"}},"required":["a"],"additionalProperties":false}'


@query(
    "b3_build_parameter",
    "endpoints_raw",
    sql=f"SELECT seq, {PARAMETER} AS parameter FROM endpoints_raw WHERE has_params",
)
def build_parameter(spark, folder):
    rows = endpoints(spark, folder).select("seq", F.explode("parameters").alias("q"))
    return rows.select("seq", build.build_parameter(c("q")).alias("parameter"))


@query(
    "b4_build_schema",
    "endpoints_raw",
    sql=f"""SELECT seq, CASE WHEN seq % 4 = 0 THEN '{FULL_SCHEMA}' ELSE '{{"type":"object"}}' END AS body_schema
FROM endpoints_raw WHERE has_body""",
)
def build_schema(spark, folder):
    rows = endpoints(spark, folder).filter("request_body IS NOT NULL")
    return rows.select("seq", build.build_schema(c("request_body.schema")).alias("body_schema"))


def operation_sql():
    generated = """lower(concat(method, '_', regexp_replace(regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'),
      '\\{.*?\\}', 'by_id', 'g'), '[^a-zA-Z0-9]+', '_', 'g')))"""
    media = "concat('\"application/json\":{{\"schema\":', {0}, {1}, '}}')"
    body_schema = f"CASE WHEN seq % 4 = 0 THEN '{FULL_SCHEMA}' ELSE '{{\"type\":\"object\"}}' END"
    body_example = "CASE WHEN has_example AND NOT has_params THEN ',\"example\":{\"a\":1}' ELSE '' END"
    response_example = (
        "CASE WHEN has_example AND NOT has_params AND NOT has_body THEN ',\"example\":1' ELSE '' END"
    )
    body_media = media.format(body_schema, body_example)
    response_media = media.format(f"'{FULL_SCHEMA}'", response_example)
    return f"""concat('{{"summary":', to_json(summary),
    CASE WHEN description IS NOT NULL THEN concat(',"description":', to_json(description)) ELSE '' END,
    ',"operationId":"', CASE WHEN seq % 17 = 0 THEN concat('op', seq) ELSE {generated} END, '"',
    CASE WHEN tag IS NOT NULL THEN concat(',"tags":["', tag, '"]') ELSE '' END,
    CASE WHEN has_params THEN concat(',"parameters":[', {PARAMETER}, ']') ELSE '' END,
    CASE WHEN has_body THEN concat(',"requestBody":{{"description":', to_json(coalesce(description, '')),
      ',"required":', CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END, ',"content":{{', {body_media}, '}}}}') ELSE '' END,
    ',"responses":', CASE WHEN has_responses THEN concat('{{"200":{{"description":"ok"',
      CASE WHEN seq % 3 = 0 THEN concat(',"content":{{', {response_media}, '}}') ELSE '' END, '}}}}')
      ELSE '{build.DEFAULT_RESPONSES}' END,
    CASE WHEN seq % 23 = 0 THEN ',"deprecated":true' ELSE '' END, '}}')"""


OPERATION = operation_sql()


@query(
    "b5_build_operation",
    "endpoints_raw",
    sql=f"SELECT seq, {OPERATION} AS operation FROM endpoints_raw",
)
def build_operation(spark, folder):
    return endpoints(spark, folder).select("seq", build.build_operation().alias("operation"))


ITEMS = f"""{UNIQUE}, firsts AS (SELECT *, min(url || '|' || lpad(CAST(seq AS VARCHAR), 12, '0'))
      OVER (PARTITION BY site, norm_path, method) AS method_place FROM placed),
  items AS (SELECT site, norm_path, min(place) AS place, concat('{{', string_agg(
      concat('"', method, '":', {OPERATION}), ',' ORDER BY method_place), '}}') AS path_item
    FROM firsts WHERE last_rn = 1 GROUP BY site, norm_path)"""


@query(
    "b6_build_paths",
    "endpoints_raw",
    sql=f"WITH {ITEMS} SELECT site, norm_path, path_item FROM items",
)
def build_paths(spark, folder):
    operations = build.unique_operations(endpoints(spark, folder))
    return build.build_paths(operations).select("site", "norm_path", "path_item")


@query(
    "b7_build_components",
    "record_pages",
    sql=f"""SELECT site, concat('security_', row_number() OVER (PARTITION BY site ORDER BY url)) AS scheme_name,
  CASE WHEN seq % 3 = 0 THEN '{{"type":"http","scheme":"bearer"}}'
    ELSE '{{"type":"apiKey","name":"K","in":"header"}}' END AS scheme_json
FROM record_pages WHERE {VALID}""",
)
def build_components(spark, folder):
    results = materialize(extraction.parse_records(records(spark, folder)), "results")
    numbered = merge.number_security_schemes(merge.flatten_security_schemes(results))
    return numbered.select("site", "scheme_name", build.build_security_scheme().alias("scheme_json"))


@query(
    "b8_build_tags",
    "endpoints_raw",
    sql=f"""WITH {BEST} SELECT DISTINCT site, concat('{{"name":"', tag, '","description":"', tag, ' endpoints"}}')
  AS tag_json FROM best WHERE tag IS NOT NULL""",
)
def build_tags(spark, folder):
    tags = merge.distinct_tags(merge.dedup_endpoints(endpoints(spark, folder)))
    return tags.select("site", build.build_tag(c("tag")).alias("tag_json"))


SPEC_JSON = """concat('{{"openapi":"3.0.3","info":{{"title":"', {title}, '","version":"1.0.0","description":"', {told},
    '"}},"servers":[{{"url":"', s.site, '","description":"API server"}}],"paths":{{', paths, '}}', {components},
    CASE WHEN tags IS NULL THEN '' ELSE concat(',"tags":[', tags, ']') END, '}}')"""


@query(
    "b9_build_spec",
    "endpoints_raw",
    "record_pages",
    sql=f"""WITH {METAS}, {ITEMS},
  p AS (SELECT site, string_agg(concat('"', norm_path, '":', path_item), ',' ORDER BY place) AS paths FROM items GROUP BY site),
  schemes AS (SELECT site, url, concat('"security_', row_number() OVER (PARTITION BY site ORDER BY url), '":',
      CASE WHEN seq % 3 = 0 THEN '{{"type":"http","scheme":"bearer"}}' ELSE '{{"type":"apiKey","name":"K","in":"header"}}' END) AS js
    FROM record_pages WHERE {VALID}),
  k AS (SELECT site, string_agg(js, ',' ORDER BY url) AS schemes FROM schemes GROUP BY site),
  t AS (SELECT site, string_agg(concat('{{"name":"', tag, '","description":"', tag, ' endpoints"}}'), ',' ORDER BY tag) AS tags
    FROM (SELECT DISTINCT site, tag FROM placed WHERE last_rn = 1 AND tag IS NOT NULL) d GROUP BY site)
SELECT s.site, md5({SPEC_JSON.format(
        title="coalesce(title, concat(substr(s.site, 9), ' API'))",
        told="coalesce(description, concat('API specification generated from ', s.site))",
        components='''CASE WHEN schemes IS NULL THEN '' ELSE concat(',"components":{"securitySchemes":{', schemes, '}}') END''',
    )}) AS spec_hash, 1::BIGINT AS parts
FROM (SELECT DISTINCT site FROM endpoints_raw) s LEFT JOIN metas m ON s.site = m.site LEFT JOIN p ON s.site = p.site
LEFT JOIN k ON s.site = k.site LEFT JOIN t ON s.site = t.site""",
)
def build_spec(spark, folder):
    rows = endpoints(spark, folder)
    results = materialize(extraction.parse_records(records(spark, folder)), "results")
    built = build.build_specs(
        rows.select("site").distinct(), results, rows, merge.flatten_security_schemes(results)
    )
    return built.select("site", F.md5("spec_json").alias("spec_hash"), (c("part") + 1).alias("parts"))


@query(
    "b10_filter_then_build",
    "endpoints_raw",
    sql=f"""WITH {SCORED}, kept AS (SELECT *, lpad(CAST(CAST(round((2 - score) * 1000000) AS BIGINT) AS VARCHAR), 8, '0')
      || '|' || url || '|' || lpad(CAST(seq AS VARCHAR), 12, '0') AS place FROM scored WHERE score >= {LOW}),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, path, method ORDER BY
      CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, place) AS rn FROM kept) r
    WHERE rn = 1),
  named AS (SELECT *, CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END AS norm_path FROM best),
  placed AS (SELECT *, row_number() OVER (PARTITION BY site, norm_path, method ORDER BY place DESC) AS last_rn,
      min(place) OVER (PARTITION BY site, norm_path) AS path_place,
      min(place) OVER (PARTITION BY site, norm_path, method) AS method_place FROM named),
  items AS (SELECT site, norm_path, min(path_place) AS path_place, concat('{{', string_agg(concat('"', method, '":', {OPERATION}),
      ',' ORDER BY method_place), '}}') AS path_item FROM placed WHERE last_rn = 1 GROUP BY site, norm_path),
  p AS (SELECT site, string_agg(concat('"', norm_path, '":', path_item), ',' ORDER BY path_place) AS paths FROM items GROUP BY site),
  t AS (SELECT site, string_agg(concat('{{"name":"', tag, '","description":"', tag, ' endpoints"}}'), ',' ORDER BY tag) AS tags
    FROM (SELECT DISTINCT site, tag FROM placed WHERE last_rn = 1 AND tag IS NOT NULL) d GROUP BY site)
SELECT s.site, md5({SPEC_JSON.format(
        title="concat(substr(s.site, 9), ' API')",
        told="concat('API specification generated from ', s.site)",
        components="''",
    )}) AS spec_hash FROM p s LEFT JOIN t ON s.site = t.site""",
)
def filter_then_build(spark, folder):
    kept = relevance.filter_endpoints(endpoints(spark, folder), QUERY, LOW)
    built = build.build_filtered_specs(kept.select("site").distinct(), kept)
    return built.select("site", F.md5("spec_json").alias("spec_hash"))
