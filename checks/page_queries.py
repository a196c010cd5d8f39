"""Queries over pages and texts: sources, predicates, discovery, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import doc_url, is_doc, keyword_count, literal, matches_any, query, strip
from checks.views import pages, table, view
from specloom import patterns as p
from specloom import schemas
from specloom.functions import auth
from specloom.functions import jsontext as j
from specloom.functions import text as t
from specloom.functions import urls as u
from specloom.functions.html import with_parsed_html
from specloom.functions.relevance import keywords
from specloom.operators import content, discovery, robots
from specloom.sources import tables
from specloom.workspace import new_folder

c = F.col


def text_lines(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", "text", F.split("text", "\n").alias("lines")
    )


# -- sources ----------------------------------------------------------------------------------------


@query(
    "s1_read_pages",
    "site_pages",
    sql="""SELECT url, status, CASE WHEN status BETWEEN 200 AND 299 AND contains(lower(content_type), 'application/json')
    THEN 'JSON API Spec' END AS title, md5(html) AS text_hash, strlen(html) AS size_bytes FROM site_pages""",
)
def read_pages(spark, folder):
    """All pages through the source: written as a table of pages, read back, JSON answers told apart."""
    path = new_folder(spark, "pages")
    pages(spark, folder).select([f.split()[0] for f in schemas.PAGES.split(", ")]).write.parquet(path)
    found = tables.read_pages(spark, path)
    documents = content.extract_content(found).filter(c("title") == content.JSON_TITLE).select("url", "title")
    read = found.select("url", "status", F.md5("html").alias("text_hash"), F.octet_length("html").cast("long").alias("size_bytes"))
    return read.join(documents, "url", "left")


@query(
    "s2_select_pages_by_url",
    "site_pages",
    sql="SELECT site, url FROM site_pages WHERE page_id % 3 = 0",
)
def select_pages_by_url(spark, folder):
    site_pages = pages(spark, folder)
    wanted = F.when(c("page_id") % 3 == 0, c("url")).otherwise(F.concat("url", F.lit("/no")))
    listed = site_pages.select(
        "site", F.concat(F.lit(" "), wanted, F.lit(" , "), c("site")).alias("urls")
    )
    chosen = discovery.select_pages_by_url(site_pages, discovery.listed_urls(listed))
    return chosen.select("site", "url")


COMMON = f"""SELECT site, url FROM crawl_pages
WHERE status = 200 AND place IN ({", ".join(literal(x) for x in p.COMMON_PATHS)})
AND {is_doc("url", "html")}"""


@query("s3_common_path_candidates", "crawl_pages", sql=COMMON)
def common_path_candidates(spark, folder):
    return discovery.common_path_candidates(pages(spark, folder, "crawl_pages"))


@query(
    "s4_sitemap_urls",
    "sitemaps",
    sql=f"""WITH firsts AS (SELECT site, xml,
    row_number() OVER (PARTITION BY site ORDER BY priority) AS rn FROM sitemaps),
  found AS (SELECT site, replace(trim(unnest(regexp_extract_all(xml, '<loc>(.*?)</loc>', 1))),
    '&amp;', '&') AS url FROM firsts WHERE rn = 1)
SELECT DISTINCT site, url FROM found WHERE {doc_url("url")}""",
)
def sitemap_urls(spark, folder):
    return discovery.sitemap_locations(view(spark, folder, "sitemaps"))


# -- predicates --------------------------------------------------------------------------------------


@query(
    "f1_is_api_documentation",
    "site_pages",
    sql=f"SELECT url, {is_doc('url', 'html')} AS is_doc FROM site_pages",
)
def is_api_documentation(spark, folder):
    found = u.is_api_documentation(c("url"), c("html"))
    return pages(spark, folder).select("url", found.alias("is_doc"))


@query(
    "f2_is_likely_doc_url",
    "site_pages",
    sql=f"SELECT url, {doc_url('url')} AS is_likely FROM site_pages",
)
def is_likely_doc_url(spark, folder):
    return pages(spark, folder).select("url", u.is_likely_doc_url(c("url")).alias("is_likely"))


@query(
    "a12_keyword_count",
    "site_pages",
    sql=f"SELECT url, {keyword_count('html')} AS n_keywords FROM site_pages",
)
def count_keywords(spark, folder):
    return pages(spark, folder).select("url", u.keyword_count(c("html")).alias("n_keywords"))


LINKS = r"""links AS (SELECT site, url, pos - 1 AS pos,
    CASE WHEN href LIKE 'mailto:%' OR href LIKE 'http%' THEN href
      WHEN href LIKE '/%' THEN concat(site, href)
      ELSE concat(regexp_extract(concat(url, '/'), '^(https://[^/]*/)', 1), href) END AS link
  FROM (SELECT site, url, generate_subscripts(hrefs, 1) AS pos, unnest(hrefs) AS href
    FROM (SELECT site, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS hrefs
      FROM site_pages) h) l)"""
HOST = "regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
OWN = f"({HOST} = '' OR {HOST} = substr(site, 9))"


@query(
    "x3_extract_links",
    "site_pages",
    sql=f"WITH {LINKS} SELECT url, CAST(pos AS INTEGER) AS pos, link FROM links",
)
def extract_links(spark, folder):
    return discovery.extract_links(pages(spark, folder)).select("url", "pos", "link")


@query(
    "f3_is_same_domain",
    "site_pages",
    sql=f"WITH {LINKS} SELECT url, CAST(pos AS INTEGER) AS pos, {OWN} AS is_own FROM links",
)
def is_same_domain(spark, folder):
    links = discovery.extract_links(pages(spark, folder))
    return links.select("url", "pos", u.is_same_domain(c("link"), c("site")).alias("is_own"))


@query(
    "w6_first_links_per_page",
    "site_pages",
    sql=f"""WITH {LINKS}, ranked AS (SELECT url, link, row_number() OVER (PARTITION BY url
    ORDER BY CASE WHEN {doc_url("link")} THEN 0 ELSE 1 END,
      CASE WHEN {doc_url("link")} THEN -pos ELSE pos END) AS rn FROM links WHERE {OWN})
SELECT url, string_agg(link, ' ' ORDER BY rn) AS links FROM ranked WHERE rn <= 10 GROUP BY url""",
)
def first_links_per_page(spark, folder):
    first = discovery.first_links_per_page(pages(spark, folder))
    return first.filter(F.size("links") > 0).select("url", F.array_join("links", " ").alias("links"))


RENDERED = """
SELECT doc_id, concat('<html><body>', mark, '<p>', body, '</p><script>var hidden = 1;</script></body></html>')
    AS html, concat(CASE WHEN doc_id % 4 = 2 THEN 'Made with Vue' ELSE '' END, body) AS visible
FROM (SELECT doc_id, translate(text, '<&', '..') AS body,
  CASE doc_id % 4 WHEN 0 THEN '<div id="root"></div>' WHEN 1 THEN '<div  ID=''app''></div>'
    WHEN 2 THEN '<p>Made with Vue</p>' ELSE '<div id="main"></div>' END AS mark
  FROM @documents) d"""


@query(
    "f4_needs_render",
    sql=f"""SELECT doc_id, {matches_any("lower(html)", [x.lower() for x in p.RENDER_INDICATORS])}
    AND length({strip("visible")}) < 500 AS needs_render FROM ({RENDERED}) r""",
)
def needs_render(spark, folder):
    frame = spark.sql(RENDERED.replace("@documents", f"parquet.`{folder}/documents.parquet`"))
    return content.with_needs_render(frame.drop("visible"), "html").select("doc_id", "needs_render")


@query(
    "f7_valid_sample",
    sql=f"""SELECT doc_id, CAST(len(kept) AS INTEGER) AS n, md5(array_to_string(kept, '|')) AS kept_hash
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: {strip("x")}), lambda x: length(x) > 10) AS kept FROM @documents) d""",
)
def valid_sample(spark, folder):
    kept = t.valid_samples(c("lines"))
    return text_lines(spark, folder).select(
        "doc_id", F.size(kept).alias("n"), F.md5(F.array_join(kept, "|")).alias("kept_hash")
    )


def short_lines_sql(column):
    return f"""array_to_string(list_filter(string_split({column}, chr(10)),
    lambda x: length({strip("x")}) NOT BETWEEN 1 AND 3), chr(10))"""


@query(
    "f8_drop_short_lines",
    sql=f"SELECT doc_id, md5({short_lines_sql('text')}) AS text_hash FROM @documents",
)
def drop_short_lines(spark, folder):
    kept = t.drop_short_lines(c("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(kept).alias("text_hash"))


# -- crawl -----------------------------------------------------------------------------------------


def crawl_sql(*places):
    """Pages reached from a start page that answered, and that are documentation."""
    listed = ", ".join(literal(x) for x in places)
    return f"""SELECT p.site, p.url FROM crawl_pages p JOIN crawl_pages b ON p.site = b.site
WHERE b.place = '' AND b.status = 200 AND p.status = 200 AND p.place IN ({listed})
AND {is_doc("p.url", "p.html")}"""


CRAWLED = crawl_sql("", "/graphql", "/docs/x", "/help")


CRAWL_LIMITS = {
    "rounds": p.CRAWL_ROUNDS,
    "batch": p.CRAWL_BATCH,
    "max_pages": p.CRAWL_PAGES,
    "links_per_page": p.CRAWL_LINKS,
}


def crawled(spark, folder, **limits):
    found = pages(spark, folder, "crawl_pages")
    return discovery.crawl(found, found.select("site").distinct(), **CRAWL_LIMITS | limits)


@query("g1_crawl", "crawl_pages", sql=CRAWLED)
def crawl(spark, folder):
    return crawled(spark, folder)


@query("g1_crawl_all", "crawl_pages", sql=CRAWLED)
def crawl_all(spark, folder):
    """Without any limit; the planted sites are small enough for the limits not to matter."""
    found = pages(spark, folder, "crawl_pages")
    return discovery.crawl(found, found.select("site").distinct())


@query("j7_crawl_frontier", "crawl_pages", sql=crawl_sql(""))
def crawl_frontier(spark, folder):
    return crawled(spark, folder, rounds=1)


@query("t5_frontier_batch", "crawl_pages", sql=crawl_sql("", "/graphql"))
def frontier_batch(spark, folder):
    return crawled(spark, folder, rounds=2, batch=2)


@query("t6_page_budget", "crawl_pages", sql=crawl_sql("", "/graphql", "/docs/x"))
def page_budget(spark, folder):
    return crawled(spark, folder, max_pages=4)


DISCOVERED = f"""common AS ({COMMON}), crawled AS ({CRAWLED}),
  enough AS (SELECT site FROM common GROUP BY site HAVING count(*) >= 3),
  discovered AS (SELECT * FROM common UNION
    SELECT * FROM crawled WHERE site NOT IN (SELECT site FROM enough))"""


@query(
    "u1_union_discovered",
    "crawl_pages",
    sql=f"WITH {DISCOVERED} SELECT site, url FROM discovered",
)
def union_discovered(spark, folder):
    return discovery.discover(
        pages(spark, folder, "crawl_pages"), crawl_below=p.CRAWL_IF_FEWER_THAN, **CRAWL_LIMITS
    )


@query(
    "u1_discover_for_agent",
    "crawl_pages",
    sql=f"""WITH open AS ({COMMON} AND (page_id % 3 <> 0 OR place <> '/docs')) SELECT site, url FROM open""",
)
def discover_for_agent(spark, folder):
    """Usual paths only, on sites of which some keep /docs from the agent by their robots.txt."""
    found = pages(spark, folder, "crawl_pages")
    closed = found.filter((c("place") == "/docs") & (c("page_id") % 3 == 0)).select("site").distinct()
    files = closed.select(
        "site", F.concat("site", F.lit("/robots.txt")).alias("url"), F.lit(200).alias("status"), F.lit("text/plain").alias("content_type"),
        F.lit("User-agent: *\nDisallow:\n\nUser-agent: checker\nAllow: /docs/x\nDisallow: /docs\n").alias("html"), F.lit(None).cast("timestamp").alias("fetched_at"),
    )
    both = found.select(files.columns).unionByName(files)
    return discovery.discover(both, crawl_below=0, agent="Checker/1.0")


# -- robots ----------------------------------------------------------------------------------------


@query(
    "j3_robots_allowed",
    "robots_urls",
    "robots_pages",
    sql="""SELECT o_orderkey, CASE WHEN r.site IS NULL OR r.status = 404 THEN true
  WHEN r.status = 403 THEN false
  ELSE NOT (contains(u.url, '/private') OR contains(u.url, '/admin')) END AS allowed,
  CASE WHEN r.site IS NULL OR r.status = 404 THEN true WHEN r.status = 403 THEN false
  ELSE NOT contains(u.url, '/slow') END AS slow_allowed
FROM robots_urls u LEFT JOIN robots_pages r ON u.site = r.site""",
)
def robots_allowed(spark, folder):
    rules = robots.robots_rules(pages(spark, folder, "robots_pages"))
    urls = view(spark, folder, "robots_urls")
    anybody = robots.robots_allowed(urls, rules)
    slow = robots.robots_allowed(
        anybody.withColumnRenamed("allowed", "any_allowed"), rules, "SlowBot/2.0"
    )
    return slow.select(
        "o_orderkey", c("any_allowed").alias("allowed"), c("allowed").alias("slow_allowed")
    )


@query(
    "j4_crawl_delay",
    "robots_pages",
    sql="""SELECT site, CASE WHEN status = 200
  THEN CAST(regexp_extract(html, 'Crawl-delay: ([0-9]+)', 1) AS DOUBLE) END AS crawl_delay
FROM robots_pages""",
)
def crawl_delay(spark, folder):
    return robots.crawl_delay(robots.robots_rules(pages(spark, folder, "robots_pages")), "SlowBot")


@query(
    "j5_robots_has_sitemap",
    "robots_pages",
    sql="""SELECT s.site, CASE WHEN r.site IS NULL THEN true ELSE r.status = 200
  AND contains(r.html, 'Sitemap:') END AS has_sitemap
FROM (SELECT concat('https://s', c_custkey, '.example.com') AS site FROM @customer) s
LEFT JOIN robots_pages r ON s.site = r.site""",
)
def has_sitemap(spark, folder):
    sites = table(spark, folder, "customer").select(
        F.concat(F.lit("https://s"), "c_custkey", F.lit(".example.com")).alias("site")
    )
    return robots.has_sitemap(sites, robots.robots_rules(pages(spark, folder, "robots_pages")))


# -- content ---------------------------------------------------------------------------------------

# An entity also counts without its semicolon, where its name ends (titles are cut off anywhere).
UNESCAPED = "{0}"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
    UNESCAPED = f"regexp_replace({UNESCAPED}, '&{_name}(;|\\b)', '{_char}', 'g')"


def squeeze_sql(column):
    lines = f"regexp_replace({column}, '\\n{p.SPACE}*\\n', chr(10) || chr(10), 'g')"
    return f"regexp_replace({lines}, ' +', ' ', 'g')"


def clean_sql(column):
    return strip(short_lines_sql(squeeze_sql(column)))


def raw_documents(spark, folder):
    raw = table(spark, folder, "pages").select(
        F.lit("s").alias("site"),
        "url",
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        "html",
    )
    return content.extract_content(raw)


# Texts of the nodes of the article, in order: markup and scripts out, entities decoded.
ARTICLE = f"""nodes AS (SELECT url, list_filter(list_transform(string_split_regex(
    regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|</body>|\\z)', 1),
      '(?s)<(nav|footer|header|aside|script|style|noscript)\\b.*?</(nav|footer|header|aside|script|style|noscript)>', '<x>', 'g'),
      '(?s)<!--.*?-->', '<x>', 'g'), '<[^>]+>'),
    lambda x: {strip(UNESCAPED.format("x"))}), lambda x: x <> '') AS texts FROM @pages)"""


@query(
    "e1_extract_content",
    sql=f"""WITH {ARTICLE} SELECT url,
  md5({clean_sql("array_to_string(texts, chr(10))")}) AS text_hash FROM nodes""",
)
def extract_content(spark, folder):
    return raw_documents(spark, folder).select("url", F.md5("text").alias("text_hash"))


@query(
    "e2_page_title",
    sql=f"""SELECT url, coalesce({strip(UNESCAPED.format("nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')"))},
  'Untitled') AS title FROM @pages""",
)
def page_title(spark, folder):
    parsed = with_parsed_html(table(spark, folder, "pages").select("url", "html"))
    title = t.page_title(c("parsed.title"), c("parsed.heading"))
    return parsed.select("url", title.alias("title"))


@query(
    "e3_code_samples",
    "site_pages",
    sql="""SELECT url, CASE WHEN is_json THEN 1 WHEN page_id % 5 = 1 THEN 2 ELSE 0 END AS n,
  CASE WHEN is_json THEN html WHEN page_id % 5 = 1 THEN 'GET /users HTTP/1.1|GET /users HTTP/1.1' ELSE '' END AS samples
FROM (SELECT *, coalesce(contains(lower(content_type), 'application/json'), false) AS is_json FROM site_pages)
WHERE status BETWEEN 200 AND 299""",
)
def code_samples(spark, folder):
    return content.extract_content(pages(spark, folder)).select(
        "url", F.size("code_samples").alias("n"), F.array_join("code_samples", "|").alias("samples")
    )


@query(
    "e4_clean_text", sql=f"SELECT doc_id, md5({clean_sql('text')}) AS text_hash FROM @documents"
)
def clean_text(spark, folder):
    cleaned = t.clean_text(c("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(cleaned).alias("text_hash"))


@query(
    "e5_token_estimate",
    sql="""SELECT doc_id, CAST((length(text) + list_sum(list_transform(string_split(text, chr(10)),
  lambda x: length(x)))) // 4 AS BIGINT) AS tokens FROM @documents""",
)
def token_estimate(spark, folder):
    tokens = t.token_estimate(c("text"), c("lines"))
    return text_lines(spark, folder).select("doc_id", tokens.alias("tokens"))


@query(
    "e6_content_hash",
    sql="SELECT doc_id, md5(substr(text, 1, 50000)) AS content_hash FROM @documents",
)
def content_hash(spark, folder):
    hashed = t.content_hash(c("text"))
    return table(spark, folder, "documents").select("doc_id", hashed.alias("content_hash"))


PROMPT = """concat('URL: https://x/', doc_id, chr(10), 'Title: T', lang, chr(10), chr(10), text,
  chr(10), chr(10), 'Code Samples:', chr(10), array_to_string(list_transform(
    string_split(text, chr(10))[1:10], lambda x, i: concat(chr(10), 'Sample ', i, ':', chr(10), '```', chr(10),
    x, chr(10), '```', chr(10))), ''))"""


@query("e19_build_prompt", sql=f"SELECT doc_id, md5({PROMPT}) AS prompt_hash FROM @documents")
def build_prompt(spark, folder):
    documents = table(spark, folder, "documents")
    prompt = t.document_prompt(
        F.concat(F.lit("https://x/"), "doc_id"),
        F.concat(F.lit("T"), "lang"),
        c("text"),
        F.split("text", "\n"),
    )
    return documents.select("doc_id", F.md5(prompt).alias("prompt_hash"))


@query(
    "t3_first_code_samples",
    sql="""SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:10], '|')) AS samples_hash
FROM @documents""",
)
def first_code_samples(spark, folder):
    first = F.array_join(F.slice("lines", 1, p.PROMPT_SAMPLES), "|")
    return text_lines(spark, folder).select("doc_id", F.md5(first).alias("samples_hash"))


@query(
    "t4_truncate",
    sql="""SELECT doc_id, md5(CASE WHEN length(text) > 500
  THEN concat(substr(text, 1, 500), chr(10), chr(10), '[... truncated ...]') ELSE text END) AS text_hash
FROM @documents""",
)
def truncate(spark, folder):
    cut = t.truncate(c("text"), 500)
    return table(spark, folder, "documents").select("doc_id", F.md5(cut).alias("text_hash"))


# -- authentication --------------------------------------------------------------------------------

FAMILY = {name: matches_any("lower(text)", q) for name, q in p.AUTH_PATTERNS.items()}
FLOWS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {matches_any('lower(text)', q)} THEN '{name}' END"
    for name, q in p.OAUTH_FLOW_PATTERNS.items()
) + "], lambda x: x IS NOT NULL), ', ')"
JWT = "(contains(lower(text), 'jwt') OR contains(lower(text), 'json web token'))"
HEADER_NAME = (
    "coalesce("
    + ", ".join(
        f"nullif(regexp_extract(text, {literal('(?i)' + q)}, 1), '')"
        for q in p.HEADER_NAME_PATTERNS
    )
    + ", 'X-API-Key')"
)
SCHEMES = f"""
SELECT doc_id, 1 AS pos, 'apiKey' AS type, {HEADER_NAME} AS name, 'header' AS location, NULL AS scheme,
  NULL AS bearer_format, 'API key authentication via header' AS description
FROM api_docs WHERE {FAMILY["api_key_header"]}
UNION ALL SELECT doc_id, 2, 'apiKey', 'api_key', 'query', NULL, NULL,
  'API key authentication via query parameter' FROM api_docs WHERE {FAMILY["api_key_query"]}
UNION ALL SELECT doc_id, 3, 'http', NULL, NULL, 'bearer', CASE WHEN {JWT} THEN 'JWT' END,
  concat('Bearer token authentication', CASE WHEN {JWT} THEN ' (JWT)' ELSE '' END)
FROM api_docs WHERE {FAMILY["bearer_token"]}
UNION ALL SELECT doc_id, 4, 'http', NULL, NULL, 'basic', NULL, 'HTTP Basic authentication'
FROM api_docs WHERE {FAMILY["basic_auth"]}
UNION ALL SELECT doc_id, 5, 'oauth2', NULL, NULL, NULL, NULL,
  CASE WHEN {FLOWS} = '' THEN 'OAuth 2.0' ELSE concat('OAuth 2.0 (', {FLOWS}, ')') END
FROM api_docs WHERE {FAMILY["oauth2"]}"""


@query(
    "e7_detect_auth_schemes",
    "api_docs",
    sql=f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos,
  type, name, location, scheme, bearer_format, description FROM ({SCHEMES}) s""",
)
def detect_auth_schemes(spark, folder):
    found = auth.detect_auth_schemes(c("text"))
    docs = view(spark, folder, "api_docs").select("doc_id", F.posexplode(found).alias("pos", "s"))
    return docs.select("doc_id", "pos", "s.*")


@query(
    "e8_auth_header_name",
    "api_docs",
    sql=f"SELECT doc_id, {HEADER_NAME} AS header_name FROM api_docs",
)
def auth_header_name(spark, folder):
    name = auth.auth_header_name(c("text"))
    return view(spark, folder, "api_docs").select("doc_id", name.alias("header_name"))


@query("e9_oauth2_flows", "api_docs", sql=f"SELECT doc_id, {FLOWS} AS flows FROM api_docs")
def oauth2_flows(spark, folder):
    flows = F.array_join(auth.oauth2_flows(c("text")), ", ")
    return view(spark, folder, "api_docs").select("doc_id", flows.alias("flows"))


@query("e10_jwt_flag", "api_docs", sql=f"SELECT doc_id, {JWT} AS is_jwt FROM api_docs")
def jwt_flag(spark, folder):
    return view(spark, folder, "api_docs").select("doc_id", auth.is_jwt(c("text")).alias("is_jwt"))


@query(
    "j2_merge_security_schemes",
    "api_docs",
    sql=f"""WITH given AS (SELECT doc_id, 'given' AS origin, 'http' AS type, NULL AS location, 'bearer' AS scheme
    FROM api_docs WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'given', 'apiKey', CASE WHEN doc_id % 3 = 0 THEN 'header' END, NULL
    FROM api_docs WHERE doc_id % 5 < 3),
  detected AS ({SCHEMES})
SELECT doc_id, origin, type, location, scheme FROM given UNION ALL
SELECT doc_id, 'detected', type, location, scheme FROM detected d WHERE NOT EXISTS (
  SELECT 1 FROM given g WHERE g.doc_id = d.doc_id AND g.type = d.type
    AND (d.type <> 'apiKey' OR g.location IS NOT DISTINCT FROM d.location)
    AND (d.type <> 'http' OR g.scheme IS NOT DISTINCT FROM d.scheme))""",
)
def merge_security_schemes(spark, folder):
    id_, null = c("doc_id"), F.lit(None).cast("string")

    def given(type_, location, scheme):
        return auth._scheme(type_, "given", location=location, scheme=scheme)

    listed = F.array_compact(
        F.array(
            F.when(id_ % 2 == 0, given("http", null, "bearer")),
            F.when(id_ % 5 < 3, given("apiKey", F.when(id_ % 3 == 0, "header"), null)),
        )
    )
    merged = auth.merge_security_schemes(listed, auth.detect_auth_schemes(c("text")))
    rows = view(spark, folder, "api_docs").select("doc_id", F.explode(merged).alias("s"))
    origin = F.when(c("s.description") == "given", "given").otherwise("detected")
    return rows.select("doc_id", origin.alias("origin"), "s.type", "s.location", "s.scheme")


# -- urls, JSON values, keywords ---------------------------------------------------------------------


@query(
    "e15_normalize_base_url",
    sql="""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url
  ELSE concat('https://', regexp_replace(url, '^https?://', '')) END AS base_url FROM @pages""",
)
def normalize_base_url(spark, folder):
    bare = F.when(c("page_id") % 2 == 0, c("url")).otherwise(
        F.regexp_replace("url", "^https?://", "")
    )
    rows = table(spark, folder, "pages")
    return rows.select("page_id", u.normalize_base_url(bare).alias("base_url"))


@query(
    "e16_netloc_resolve_url",
    sql="""SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS netloc,
  concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), '/a/a/', page_id, '?x#y') AS resolved
FROM @pages""",
)
def netloc_resolve_url(spark, folder):
    link = F.concat(F.lit("/b/./../a//../a/"), "page_id", F.lit("?x#y"))
    rows = table(spark, folder, "pages")
    return rows.select(
        "page_id", u.netloc(c("url")).alias("netloc"), u.resolve_url(c("url"), link).alias("resolved")
    )


@query(
    "e17_site_file_name",
    sql="""SELECT page_id, replace(regexp_extract(url, '^https?://([^/]*)', 1), '.', '_') AS file_name
FROM @pages""",
)
def site_file_name(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", u.site_file_name(c("url")).alias("file_name")
    )


VALUES = """CASE event_id % 12 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN 'false' WHEN 3 THEN '0'
  WHEN 4 THEN '0.0' WHEN 5 THEN '[]' WHEN 6 THEN '{}' WHEN 7 THEN 'true' WHEN 8 THEN '"0"'
  WHEN 9 THEN concat('', user_id) WHEN 10 THEN NULL ELSE props END"""


@query(
    "e18_is_truthy",
    sql=f"""SELECT event_id, CASE WHEN event_id % 12 = 9 THEN user_id <> 0
  ELSE event_id % 12 IN (7, 8, 11) END AS truthy FROM @events""",
)
def is_truthy(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", j.is_truthy(F.expr(VALUES)).alias("truthy")
    )


@query(
    "w7_json_last_key_wins",
    sql="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id % 5 END AS k, user_id AS u FROM @events",
)
def json_last_key_wins(spark, folder):
    repeated = F.when(
        c("event_id") % 2 == 0, F.concat(F.lit(',"k":'), c("event_id"))
    ).otherwise("")
    text = F.concat(
        F.lit('{"k":'), c("event_id") % 5, F.lit(',"u":'), c("user_id"), repeated, F.lit("}")
    )
    rows = table(spark, folder, "events").select("event_id", j.canonical(text).alias("v"))
    return rows.select("event_id", F.from_json("v", "k BIGINT, u BIGINT").alias("v")).select(
        "event_id", "v.k", "v.u"
    )


PAIRS = ", ".join(
    f"({literal(w)}, {literal(k)})"
    for name, group in p.KEYWORD_GROUPS.items()
    for w in sorted({name, *group})
    for k in group
)
KEYWORDS = f"""words AS (SELECT p_partkey, unnest(regexp_extract_all(lower(query), '{p.WORD}+')) AS word
    FROM search_queries),
  plain AS (SELECT DISTINCT p_partkey, word FROM words WHERE word NOT IN ({", ".join(literal(w) for w in p.STOP_WORDS)})),
  groups AS (SELECT * FROM (VALUES {PAIRS}) g(word, related)),
  found AS (SELECT p_partkey, word AS keyword FROM plain UNION
    SELECT p_partkey, related FROM plain JOIN groups ON plain.word = groups.word)"""


@query(
    "e11_extract_keywords",
    "search_queries",
    sql=f"""WITH {KEYWORDS} SELECT p_partkey, string_agg(keyword, ' ' ORDER BY keyword) AS keywords
FROM found GROUP BY p_partkey""",
)
def extract_keywords(spark, folder):
    found = F.array_join(keywords(c("query")), " ")
    rows = view(spark, folder, "search_queries").select("p_partkey", found.alias("keywords"))
    return rows.filter(c("keywords") != "")


@query(
    "j6_expand_keywords",
    "search_queries",
    sql=f"WITH {KEYWORDS} SELECT p_partkey, keyword FROM found",
)
def expand_keywords(spark, folder):
    found = F.explode(keywords(c("query")))
    return view(spark, folder, "search_queries").select("p_partkey", found.alias("keyword"))
