"""Discovery, robots rules and the whole pipeline."""

import json
import random
import re
from urllib.parse import quote
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from specloom.operators import discovery as d
from specloom.operators import robots as rb
from specloom.operators import specs
from specloom.plans.generate import generate_specs
from specloom.schemas import PAGES
from specloom.sources import tables

A, B = "https://a.example.com/v1", "https://b.example.com"
HTML = "text/html"


def pages(spark, *rows):
    rows = [(s, u, status, HTML, h, None) for s, u, status, h in rows]
    return spark.createDataFrame(rows, PAGES)


def pairs(frame):
    return sorted((r["site"], r["url"]) for r in frame.collect())


def test_common_paths(spark):
    frame = pages(
        spark,
        (A, "https://a.example.com/docs", 200, "api endpoint"),
        (A, "https://a.example.com/v1/docs", 200, "api endpoint"),
        (A, "https://a.example.com/help", 200, "nothing"),
        (A, "https://a.example.com/api/docs", 201, "api"),
        (A, "https://b.example.com/docs", 200, "api endpoint"),
        (A, "https://a.example.com/docs?x=1", 200, "api endpoint"),
    )
    assert pairs(d.common_path_candidates(frame)) == [
        (A, "https://a.example.com/docs"), (A, "https://a.example.com/v1/docs"),
    ]


def test_sitemaps(spark):
    xml = (
        "<urlset><url><loc> https://x.com/docs?a=1&amp;b=2 </loc></url><loc>https://x.com/blog</loc>"
        "<loc><![CDATA[https://x.com/api]]></loc><image:loc>https://x.com/api/img</image:loc>"
        "<location>https://x.com/guide</location><url><loc>https://x.com/docs/trunc"
    )
    frame = pages(
        spark,
        (A, "https://a.example.com/sitemap.xml", 200, xml),
        (A, "https://a.example.com/sitemap_index.xml", 200, "<loc>https://x.com/docs/never</loc>"),
        (B, B + "/sitemap.xml", 404, "<loc>https://x.com/docs/404</loc>"),
        (B, B + "/sitemap_index.xml", 200, "<loc>https://x.com/docs/b</loc>"),
    )
    assert pairs(d.sitemap_urls(frame)) == [
        (A, "https://x.com/api"), (A, "https://x.com/docs?a=1&b=2"), (B, "https://x.com/docs/b"),
    ]


def test_links(spark):
    html = (
        "<a href='/one'>1</a><A HREF=\"two?x=1&amp;y=2\">2</A><a name=z>no</a><a href=>e</a>"
        "<!-- <a href='/comment'> --><script>var s=\"<a href='/script'>\"</script>"
        "<a href='/docs/a'>d</a><a href='mailto:x@y'>m</a><a href='https://o.com/api'>o</a><a href='/api'>p</a>"
    )
    frame = pages(spark, (B, B + "/x/y", 200, html))
    got = [r["link"] for r in d.extract_links(frame).orderBy("pos").collect()]
    assert got == [
        B + "/one", B + "/x/two?x=1&y=2", B + "/x/y", B + "/docs/a", "mailto:x@y", "https://o.com/api", B + "/api",
    ]
    first = d.first_links_per_page(frame).first()["links"]
    assert first == [B + "/api", B + "/docs/a", B + "/one", B + "/x/two?x=1&y=2", B + "/x/y", "mailto:x@y"]
    assert d.first_links_per_page(frame, 3).first()["links"] == first[:3]


def reference_crawl(graph, base, rounds, batch, max_pages, width):
    """A plain queue over {url: (status, is_doc, links in followed order)}."""
    queue, visited, found = [base], [], set()
    for _ in range(rounds):
        if not queue:
            break
        now, queue = queue[:batch], queue[batch:]
        for url in now:
            if url in visited:
                continue
            visited.append(url)
            if len(visited) > max_pages or graph.get(url, (404,))[0] != 200:
                continue
            _, is_doc, links = graph[url]
            if is_doc:
                found.add(url)
            queue += links[:width]
    return found


def test_crawl_equals_a_queue(spark):
    # 12 pages per site: links to later, earlier, missing and repeated pages.
    rows, graphs = [], {}
    for s, site in enumerate((A, B, "https://c.example.com")):
        graph, site_pages = {}, []
        for i in range(12):
            url = site if i == 0 else f"{site}/n{i}" + ("/docs" if i % 3 == 0 else "")
            targets = [(i * (s + 2) + j) % 14 for j in range(1, 5 + s)]
            links = [f"{site}/n{t}" + ("/docs" if t % 3 == 0 else "") for t in targets]
            status = 500 if i == 7 else 200
            html = "".join(f"<a href='{u}'>x</a>" for u in links)
            html += "get post put delete json" if i % 4 == 1 else ""
            site_pages.append((site, url, status, html))
            likely = [u for u in links if "/docs" in u][::-1]
            text = html.lower()
            words = ("endpoint api request response authentication get post put delete parameter header body json")
            hits = sum(w in text for w in words.split())
            is_doc = hits >= (2 if "/docs" in url or "/api" in url else 5)
            graph[url] = (status, is_doc, likely + [u for u in links if "/docs" not in u])
        rows += site_pages
        graphs[site] = graph
    frame = pages(spark, *rows)
    sites = spark.createDataFrame([(s,) for s in graphs], "site STRING")
    for rounds, batch, max_pages, width in ((3, 5, 50, 10), (1, 5, 50, 10), (5, 2, 50, 3), (4, 5, 4, 10)):
        got = pairs(d.crawl(frame, sites, rounds, batch, max_pages, width))
        want = sorted((s, u) for s, g in graphs.items() for u in reference_crawl(g, s, rounds, batch, max_pages, width))
        assert got == want, (rounds, batch, max_pages, width)
    assert len(want) > 0


def test_discover_crawls_only_poor_sites(spark):
    doc = "api endpoint <a href='/extra/guide'>x</a>"
    rich = [(B, B + p, 200, doc) for p in ("", "/docs", "/help", "/reference", "/extra/guide")]
    root = A.removesuffix("/v1")
    poor = [(A, u, 200, doc) for u in (A, root + "/docs", root + "/extra/guide")]
    got = pairs(d.discover(pages(spark, *rich, *poor), crawl_below=3))
    assert got == [
        (A, root + "/docs"), (A, root + "/extra/guide"),
        (B, B + "/docs"), (B, B + "/help"), (B, B + "/reference"),
    ]


def test_explicit_urls(spark):
    frame = pages(spark, *[(B, B + p, 200, "") for p in ("/a", "/b", "/c")])
    assert pairs(d.select_pages_by_url(frame, f"{B}/a, {B}/c ")) == [(B, B + "/a"), (B, B + "/c")]
    assert pairs(d.select_pages_by_url(frame, [B + "/b"])) == [(B, B + "/b")]
    listed = spark.createDataFrame([(B, f" {B}/a,{B}/b"), (A, B + "/c")], "site STRING, urls STRING")
    urls = d.listed_urls(listed)
    assert pairs(d.select_pages_by_url(frame, urls)) == [(B, B + "/a"), (B, B + "/b")]


ROBOTS = """# comment
User-agent: GoodBot
User-agent: other
Disallow: /private/only
Crawl-delay: 4

User-agent: *
Disallow: /private
Allow: /private/docs
Disallow: /a%20b
Allow: /
Sitemap: https://b.example.com/sitemap.xml

User-agent: late
Disallow:
"""


def test_robots_equal_standard_library(spark):
    urls = [
        B + p
        for p in ("", "/", "/private", "/private/docs", "/private/only/x", "/x?y=/private", "/a%20b", "/a b", "/a+b", "/é")
    ]
    parser = RobotFileParser()
    parser.parse(ROBOTS.splitlines())
    robots = rb.robots_rules(pages(spark, (B, B + "/robots.txt", 200, ROBOTS)))
    frame = spark.createDataFrame([(B, u) for u in urls], "site STRING, url STRING")
    for agent in ("*", "GoodBot/1.0", "another", "late", "Mozilla"):
        got = {r["url"]: r["allowed"] for r in rb.robots_allowed(frame, robots, agent).collect()}
        assert got == {u: parser.can_fetch(agent, u) for u in urls}, agent
        delay = rb.crawl_delay(robots, agent).first()["crawl_delay"]
        assert delay == parser.crawl_delay(agent)


def test_any_robots_file_equals_standard_library(spark):
    rng = random.Random(12)
    lines = [
        "", "", " ", "# note", "User-agent: *", "user-agent : Bot", "USER-AGENT: other # x", "User-agent: a*", "User-agent:", "Disallow: /a", "Disallow:",
        "Allow: /a/b", "Disallow: *", "Disallow: /%61%zz%", "Allow: /q?", "Disallow: /x?y=1", "Crawl-delay: 7", "Crawl-delay: x", "Crawl-delay: 1.5",
        "Request-rate: 1/5", "Sitemap: https://s/m.xml", "sitemap:https://s/%41 # c", "Unknown: 1", "no colon", "Disallow : /é", "Disallow: /a+b",
    ]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += [t.replace("\n", end) for t, end in zip(texts[:12], ["\r\n", "\r", "\x0b", "\x85", "\u2028", "\x1c"] * 2, strict=True)]
    sites = [f"https://s{i}.example.com" for i in range(len(texts))]
    robots = rb.robots_rules(pages(spark, *[(s, s + "/robots.txt", 200, t) for s, t in zip(sites, texts, strict=True)])).cache()
    assert robots.count() == len(texts)
    paths = ["", "/", "/a", "/a/b", "/a+b", "/q", "/q?z", "/x?y=1", "/a%zz%", "/é", "/*"]
    frame = spark.createDataFrame([(s, s + x) for s in sites for x in paths], "site STRING, url STRING")
    parsers = {}
    for site, text in zip(sites, texts, strict=True):
        parsers[site] = RobotFileParser()
        parsers[site].parse(text.splitlines())
    found = {r["site"]: r["sitemaps"] for r in robots.collect()}
    assert found == {s: x.site_maps() for s, x in parsers.items()}
    for agent in ("*", "Bot/2", "other", "ab"):
        for r in rb.robots_allowed(frame, robots, agent).collect():
            assert r["allowed"] == parsers[r["site"]].can_fetch(agent, r["url"]), (agent, r["url"], texts[sites.index(r["site"])])
        for r in rb.crawl_delay(robots, agent).collect():
            assert r["crawl_delay"] == parsers[r["site"]].crawl_delay(agent), (agent, texts[sites.index(r["site"])])


def test_robots_status_and_sitemaps(spark):
    sites = [f"https://s{i}.example.com" for i in range(5)]
    files = [(s, s + "/robots.txt", c, "User-agent: *\nDisallow: /\n") for s, c in zip(sites, (200, 403, 404, 503))]
    robots = rb.robots_rules(pages(spark, *files))
    frame = spark.createDataFrame([(s, s + "/x") for s in sites], "site STRING, url STRING")
    allowed = {r["site"]: r["allowed"] for r in rb.robots_allowed(frame, robots).collect()}
    assert [allowed[s] for s in sites] == [False, False, True, False, True]
    listed = {r["site"]: r["has_sitemap"] for r in rb.has_sitemap(frame, robots).collect()}
    assert [listed[s] for s in sites] == [False, False, False, False, True]
    assert quote("/é") == "/%C3%A9"


def find(document):
    yield "record_api_metadata", {"title": "Shop"}
    for method, path in re.findall(r"\b(GET|POST|PUT|DELETE|PATCH) (/\S*)", document["text"]):
        yield "record_endpoint", {
            "path": path, "method": method.lower(), "summary": "found", "tags": ["users"],
            "responses": [{"status_code": "200", "description": "ok"}],
        }


def site_pages(spark):
    spec = json.dumps({"openapi": "3.0.3", "paths": {"/embedded": {"get": {"summary": "e"}}}})
    return pages(
        spark,
        (B, B, 200, "<p>welcome to the shop</p>"),
        (B, B + "/docs", 200, "<main><p>API endpoint: GET /users HTTP</p><p>Bearer token</p></main>"),
        (B, B + "/help", 200, "<main><p>API endpoint: GET /users HTTP</p><p>Bearer token</p></main>"),
        (B, B + "/api/docs", 200, f"<pre>{spec}</pre>"),
        (A, A, 200, "<p>no documentation</p>"),
    )


def test_generate_specs(spark, tmp_path):
    run = generate_specs(site_pages(spark), find)
    specs = {r["site"]: json.loads(r["spec_json"]) for r in run.specs.collect()}
    assert set(specs) == {B}
    spec = specs[B]
    assert spec["info"]["title"] == "Shop"
    assert set(spec["paths"]) == {"/users", "/embedded"}
    # Two pages describe the same scheme; both are numbered.
    assert list(spec["components"]["securitySchemes"]) == ["security_1", "security_2"]
    coverage = run.coverage.first()
    assert (coverage["total_endpoints"], coverage["confidence_high"]) == (3, 1)
    summary = {r["site"]: (r["success"], r["doc_urls"]) for r in run.summary.collect()}
    assert summary == {A: (False, 0), B: (True, 3)}
    assert {r["rule"] for r in run.violations.collect()} == set()
    assert len(run.recommendations.first()["recommendations"]) == 2
    written = tables.write_specs(run.specs, str(tmp_path / "out")).first()
    back = tables.read_specs(spark, str(tmp_path / "out")).first()
    assert written["size_bytes"] == len(back["spec_json"].rstrip("\n").encode())
    assert re.search(r"b_example_com-[0-9a-f]{12}\.openapi\.json", back["spec_id"])
    tables.write_cache(run.cache_updates, str(tmp_path / "cache"))
    cached = generate_specs(site_pages(spark), lambda _: 1 / 0, cache=tables.read_cache(spark, str(tmp_path / "cache")))
    assert {r["site"]: json.loads(r["spec_json"]) for r in cached.specs.collect()} == specs


def test_generate_filtered_and_explicit(spark):
    run = generate_specs(site_pages(spark), find, doc_urls=f"{B}/docs,{B}/api/docs", query="users", threshold=0.1)
    spec = json.loads(run.specs.first()["spec_json"])
    assert set(spec["paths"]) == {"/users"} and "components" not in spec
    assert spec["info"]["title"] == "b.example.com API"
    assert run.coverage.first()["total_endpoints"] == 1


def test_a_crawl_without_limits_reaches_everything(spark):
    doc = "api endpoint request response json "
    rows = [(B, B if i == 0 else f"{B}/docs/{i}", 200, f"{doc}<a href='/docs/{i + 1}'>x</a>") for i in range(9)]
    rows += [(B, f"{B}/docs/wide", 200, doc + "".join(f"<a href='/docs/w{i}'>x</a>" for i in range(30)))]
    rows += [(B, f"{B}/docs/w{i}", 200, doc) for i in range(30)] + [(B, f"{B}/docs/alone", 200, doc)]
    rows[8] = (*rows[8][:3], rows[8][3] + "<a href='/docs/wide'>x</a><a href='/docs/1'>x</a>")
    got = pairs(d.crawl(pages(spark, *rows), spark.createDataFrame([(B,)], "site STRING")))
    assert got == sorted({(s, u) for s, u, *_ in rows} - {(B, f"{B}/docs/alone")} - ({(B, B)} - set(got)))
    assert len(pairs(d.crawl(pages(spark, *rows), spark.createDataFrame([(B,)], "site STRING"), rounds=3))) < 5


def chain(spark, n):
    doc = "api endpoint request response json "
    return pages(spark, *[(B, f"{B}/docs/{i}" if i else B, 200, f"{doc}<a href='/docs/{i + 1}'>x</a><a href='/docs/0'>y</a>") for i in range(n)])


def test_a_round_costs_its_frontier_and_the_result_is_one_join(spark, monkeypatch):
    monkeypatch.setattr(d, "BUCKET_ROWS", 4)
    start = spark.createDataFrame([(B,)], "site STRING")
    plans = []
    for n in (3, 12):
        got = d.crawl(chain(spark, n), start)
        plans.append(got._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        assert pairs(got) == sorted([(B, B)] * 1 + [(B, f"{B}/docs/{i}") for i in range(1, n)])
    assert plans == [1, 1]  # whatever the number of rounds


def test_a_queue_goes_on_behind_a_round_of_visited_pages(spark):
    doc = "api endpoint request response json "
    links = "".join(f"<a href='/docs/{x}'>x</a>" for x in ("1", "1", "1", "2"))
    rows = [(B, B, 200, doc + links), *[(B, f"{B}/docs/{i}", 200, doc) for i in (1, 2)]]
    start = spark.createDataFrame([(B,)], "site STRING")
    assert pairs(d.crawl(pages(spark, *rows), start, batch=1)) == [(B, B), (B, f"{B}/docs/1"), (B, f"{B}/docs/2")]
    assert pairs(d.crawl(pages(spark, *rows), start, batch=1, max_pages=2)) == [(B, B), (B, f"{B}/docs/2")]
    assert pairs(d.crawl(pages(spark, *rows), start, max_pages=2, rounds=1)) == [(B, B)]
    assert pairs(d.crawl(pages(spark, *rows), start, batch=1, rounds=0)) == []


def test_pages_kept_from_an_agent_are_not_read(spark):
    doc = "api endpoint request response json "
    rows = [(B, B, 200, doc + "<a href='/docs/a'>x</a>"), (B, f"{B}/docs/a", 200, doc + "<a href='/help/b'>x</a>"), (B, f"{B}/help/b", 200, doc)]
    rows.append((B, f"{B}/robots.txt", 200, "User-agent: spider\nDisallow: /docs\n"))
    assert (B, f"{B}/help/b") in pairs(d.discover(pages(spark, *rows)))
    assert pairs(d.discover(pages(spark, *rows), agent="Spider/2")) == [(B, B)]


def test_a_page_counts_once_by_its_newest_row(spark):
    frame = site_pages(spark)
    older = frame.withColumn("fetched_at", F.lit("2020-01-01").cast("timestamp")).withColumn("html", F.lit("<main>GET /old</main>"))
    twice = frame.withColumn("fetched_at", F.lit("2021-01-01").cast("timestamp"))
    run = generate_specs(older.unionByName(twice).unionByName(twice), find)
    once = generate_specs(twice, find)
    assert run.coverage.collect() == once.coverage.collect()
    assert run.specs.collect() == once.specs.collect()


def test_large_documents_have_the_same_reports(spark):
    whole, parts = generate_specs(site_pages(spark), find), generate_specs(site_pages(spark), find, max_bytes=10)
    assert parts.specs.filter("part > 0").count() > 1
    for name in ("violations", "verdicts", "recommendations", "coverage"):
        rows = [sorted(map(str, getattr(run, name).collect())) for run in (whole, parts)]
        assert rows[0] == rows[1], name
    assert parts.recommendations.count() == 1


def test_reports_from_rows_are_those_of_the_documents(spark):
    """Rules, advice and verdicts without assembling anything, against the assembled texts."""
    def many(document):
        yield from find(document)
        site = document["url"]
        for i in range(6):
            record = {"path": f"/{'{id}' if i % 2 else 'x'}/{i}", "method": "get", "summary": "s", "operation_id": f"op{i % 3}"}
            record["parameters"] = [{"name": "id", "location": "path", "type": "string", "required": True}] if i % 3 == 1 else []
            if i == 4:
                record["responses"] = [{"status_code": "abc", "description": site, "schema_properties": {"a": {"$ref": "#/components/schemas/A"}}}]
            yield "record_endpoint", record
        for path in ("/a-b", "/a_b"):  # one operation id for both
            yield "record_endpoint", {"path": path, "method": "get", "summary": "s"}
        yield "record_security_scheme", {"type": "oauth2"}
        yield "record_security_scheme", {"type": "apiKey", "name": "k", "location": "header"}

    run = generate_specs(site_pages(spark), many)
    texts = run.specs.filter("part = 0").select("site", "spec_json")
    listed = lambda frame: sorted(map(str, frame.collect()))
    want = specs.spec_violations(texts, "site")
    assert listed(run.violations) == listed(want)
    rules = {r["rule"] for r in want.collect()}
    assert {"operation_id_unique", "path_parameters_declared", "status_code", "reference_resolved", "security_scheme_fields"} <= rules
    assert listed(run.recommendations) == listed(specs.spec_recommendations(texts, "site"))
    rows = specs.walk(texts, "site")
    assert listed(run.verdicts) == listed(specs.verdicts_of(rows, want, "site"))
    verdict, judged = run.verdicts.first(), specs.validate_specs(texts, "site").first()
    assert (verdict["is_valid"], verdict["n_errors"], verdict["paths_count"]) == (judged["is_valid"], len(judged["errors"]), judged["paths_count"])


def test_two_sites_of_one_host_are_two_files(spark, tmp_path):
    specs = spark.createDataFrame([(f"https://a.com/v{i}", 0, "{}") for i in (1, 2)], "site STRING, part LONG, spec_json STRING")
    written = tables.write_specs(specs, str(tmp_path / "out")).collect()
    assert len({r["path"] for r in written}) == 2
    assert tables.read_specs(spark, str(tmp_path / "out")).select("spec_id").distinct().count() == 2
