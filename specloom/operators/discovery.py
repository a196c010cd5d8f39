"""Finding the documentation pages of every site in a table of crawled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom import patterns as p
from specloom.functions import urls as u
from specloom.functions.html import with_parsed_html
from specloom.functions.text import strip
from specloom.operators.robots import robots_allowed, robots_rules
from specloom.operators.skew import with_positions
from specloom.workspace import broadcast_if_small, exists, materialize, new_folder


def _under_root(paths: Sequence[str]) -> Column:
    """The page is one of the paths directly under the host root of its site."""
    root = u.host_root(F.col("site"))
    rest = F.substring(F.col("url"), F.length(root) + 1, F.length("url"))
    return F.col("url").startswith(root) & rest.isin(*paths)


def common_path_candidates(pages: DataFrame) -> DataFrame:
    """(site, url) of pages at a usual documentation path that are documentation.

    The reverse of trying every path on every site: each page checks itself, nothing is joined.
    """
    return pages.filter(
        (F.col("status") == 200)
        & _under_root(p.COMMON_PATHS)
        & u.is_api_documentation(F.col("url"), F.col("html"))
    ).select("site", "url")


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """Likely documentation urls in the first sitemap of each site.

    ``sitemaps``: (site, priority, xml), lowest priority first. Sitemap indexes are not followed
    and other hosts are not excluded. Broken XML yields what can be read.
    """
    first = sitemaps.groupBy("site").agg(F.min_by("xml", "priority").alias("xml"))
    entries = F.regexp_extract_all("xml", F.lit(r"(?s)<loc(?:\s[^>]*)?>(.*?)</loc>"))
    url = F.regexp_replace(F.col("entry"), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        url = F.replace(url, F.lit(f"&{entity};"), F.lit(char))
    found = first.select("site", F.explode(entries).alias("entry")).select(
        "site", strip(url).alias("url")
    )
    return found.filter(u.is_likely_doc_url(F.col("url"))).distinct()


def sitemap_urls(pages: DataFrame) -> DataFrame:
    """``sitemap_locations`` of the sitemap pages among the crawled pages."""
    rest = F.regexp_extract("url", r"(/[^/]*)$", 1)
    priority = F.array_position(F.array(*[F.lit(s) for s in p.SITEMAP_PATHS]), rest)
    answered = pages.filter((F.col("status") == 200) & _under_root(p.SITEMAP_PATHS))
    return sitemap_locations(
        answered.select("site", priority.alias("priority"), F.col("html").alias("xml"))
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """(site, url, pos, link): every link of a page, resolved against its address."""
    parsed = with_parsed_html(pages.select("site", "url", "html"))
    links = parsed.select("site", "url", F.posexplode("parsed.links").alias("pos", "href"))
    return links.select(
        "site", "url", "pos", u.resolve_url(F.col("url"), F.col("href")).alias("link")
    )


def followed_links(links: Column, site: Column, limit: int | None = None) -> Column:
    """The links of one page a crawl goes on with, in order.

    Links on the site's own host; likely documentation first, in reverse page order, then the
    others in page order; the first ``limit``, or all.
    """
    own = F.filter(links, lambda link: u.is_same_domain(link, site))
    likely = F.reverse(F.filter(own, u.is_likely_doc_url))
    others = F.filter(own, lambda link: ~u.is_likely_doc_url(link))
    every = F.concat(likely, others)
    return every if limit is None else F.slice(every, 1, limit)


def first_links_per_page(pages: DataFrame, limit: int = p.CRAWL_LINKS) -> DataFrame:
    """(site, url, links) of ``followed_links`` for every page."""
    parsed = with_parsed_html(pages.select("site", "url", "html"))
    resolved = F.transform("parsed.links", lambda href: u.resolve_url(F.col("url"), href))
    return parsed.select("site", "url", resolved.alias("links")).select(
        "site", "url", followed_links(F.col("links"), F.col("site"), limit).alias("links")
    )


def page_facts(pages: DataFrame, links_per_page: int | None = None) -> DataFrame:
    """(site, url, is_doc, links) of the pages that answered: all a crawl needs, without markup."""
    answered = pages.filter(F.col("status") == 200).select("site", "url", "html")
    is_doc = u.is_api_documentation(F.col("url"), F.col("html"))
    parsed = with_parsed_html(answered.withColumn("is_doc", is_doc))
    resolved = F.transform("parsed.links", lambda href: u.resolve_url(F.col("url"), href))
    facts = parsed.select("site", "url", "is_doc", resolved.alias("links"))
    return facts.select("site", "url", "is_doc", followed_links(F.col("links"), F.col("site"), links_per_page).alias("links"))


#: Rows of a bucket of facts, and buckets at most.
BUCKET_ROWS, BUCKETS = 200_000, 2_000
KEY = ["site", "url"]


def crawl(
    pages: DataFrame,
    sites: DataFrame,
    rounds: int | None = None,
    batch: int | None = None,
    max_pages: int | None = None,
    links_per_page: int | None = None,
) -> DataFrame:
    """(site, url) of documentation pages found by following links from each site's address.

    Without limits every page that can be reached is looked at. Markup is read once, for the facts of
    all pages. Facts and visited urls lie in buckets by a hash of the url: a round reads the buckets of
    its frontier and of what that links to, appends its urls to the visited ones and rewrites nothing.
    What was found is one join at the end. ``rounds`` and ``links_per_page`` bound the depth and the
    width; ``batch`` and ``max_pages`` need the order of a queue (``crawl_in_batches``).
    """
    if batch is not None or max_pages is not None:
        return crawl_in_batches(pages, sites, rounds, batch, max_pages, links_per_page)
    spark = pages.sparkSession
    folder = new_folder(spark, "crawl")
    facts = page_facts(pages.join(sites.select("site").distinct(), "site", "left_semi"), links_per_page)
    facts = materialize(facts, "facts")
    buckets = min(-(-facts.count() // BUCKET_ROWS) or 1, BUCKETS)
    placed = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
    bucketed = facts.withColumn("bucket", placed).repartition(buckets, "bucket")
    bucketed.write.partitionBy("bucket").parquet(f"{folder}/facts")
    facts = spark.read.schema("site STRING, url STRING, is_doc BOOLEAN, links ARRAY<STRING>, bucket INT").parquet(f"{folder}/facts")

    def visited(*round_: int) -> DataFrame:
        base = spark.read.option("basePath", f"{folder}/visited").schema("site STRING, url STRING, round INT, bucket INT")
        return base.parquet(*([f"{folder}/visited/round={r}" for r in round_] or [f"{folder}/visited"]))

    def visit(frontier: DataFrame, round_: int) -> list[int]:
        """Append a round's urls; their buckets."""
        rows = frontier.select(*KEY, F.lit(round_).alias("round"), "bucket")
        rows.write.mode("append").partitionBy("round", "bucket").parquet(f"{folder}/visited")
        return used(visited(round_)) if exists(spark, f"{folder}/visited/round={round_}") else []

    def used(frame: DataFrame) -> list[int]:
        return [r["bucket"] for r in frame.select("bucket").distinct().collect()]  # BUCKETS at most

    start = sites.select("site", F.regexp_replace("site", r"/+\z", "").alias("url")).distinct()
    done, now = 0, visit(start.withColumn("bucket", placed), 0)
    while now and done != rounds:
        fetched = facts.filter(F.col("bucket").isin(now)).join(visited(done), [*KEY, "bucket"], "left_semi")
        reached = fetched.select("site", F.explode("links").alias("url")).distinct().withColumn("bucket", placed)
        reached = materialize(reached, "reached")
        known = visited().filter(F.col("bucket").isin(used(reached)))
        done += 1
        now = visit(reached.join(known, [*KEY, "bucket"], "left_anti"), done)
    last = [] if done != rounds else [done]  # reached, but not looked at
    seen = visited().filter(~F.col("round").isin(last)) if exists(spark, f"{folder}/visited") else start.limit(0)
    return facts.filter("is_doc").select(*KEY).join(seen.select(*KEY), KEY, "left_semi").distinct()


#: Stands for no limit where a number is needed.
NO_LIMIT = 2**31 - 1


def crawl_in_batches(
    pages: DataFrame,
    sites: DataFrame,
    rounds: int | None = p.CRAWL_ROUNDS,
    batch: int | None = p.CRAWL_BATCH,
    max_pages: int | None = p.CRAWL_PAGES,
    links_per_page: int | None = p.CRAWL_LINKS,
) -> DataFrame:
    """``crawl`` with a queue per site: ``batch`` places a round, at most ``max_pages`` pages.

    All sites move one round at a time. The queue is rows: a url gets its place when it is appended, by
    the number of links before it in its round, and with it the round that will take it; so a round reads
    its own rows, and those of another never change. Of a site only numbers are kept: places waiting,
    places given, pages visited. Only the pages of the round are read as markup. The queue keeps
    duplicates, and a visited url still takes up a place in its round.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "crawl")
    few = batch is not None and links_per_page is not None  # then a round has so many rows of a site at most
    batch, max_pages = (NO_LIMIT if x is None else x for x in (batch, max_pages))
    number = F.lit(0).cast("long")
    schemas = {
        "queue": "site STRING, url STRING, place LONG",
        "visited": "site STRING, url STRING, place LONG, seen LONG, rank LONG",
        "steps": "site STRING, url STRING, place LONG, is_doc BOOLEAN, links ARRAY<STRING>",
    }

    def append(name: str, frame: DataFrame, turn: Column) -> None:
        rows = frame.withColumn("turn", turn)
        rows.write.mode("append").partitionBy("turn").parquet(f"{folder}/{name}")

    def rows_of(name: str, turn: int | None = None) -> DataFrame:
        path = f"{folder}/{name}" if turn is None else f"{folder}/{name}/turn={turn}"
        found = spark.read.schema(schemas[name]).parquet(path) if exists(spark, path) else spark.createDataFrame([], schemas[name])
        return found.select([x.split()[0] for x in schemas[name].split(", ")])

    def numbered(frame: DataFrame, order: list[str], out: str) -> DataFrame:
        if few:
            return frame.withColumn(out, F.row_number().over(Window.partitionBy("site").orderBy(*order)).cast("long"))
        return with_positions(materialize(frame, out), ["site"], order, out)

    start = sites.select("site").distinct().withColumn("url", F.regexp_replace("site", r"/+\z", ""))
    append("queue", start.select(*KEY, number.alias("place")), F.lit(0))
    state = start.select("site", (number + 1).alias("waiting"), (number + 1).alias("given"), number.alias("seen"))
    turn = 0
    while turn != rounds and exists(spark, f"{folder}/queue/turn={turn}"):
        fresh = rows_of("queue", turn).groupBy(*KEY).agg(F.min("place").alias("place"))
        if turn:
            fresh = fresh.join(rows_of("visited").select(*KEY), KEY, "left_anti")
        ranked = numbered(fresh, ["place"], "rank").join(state.select("site", "seen"), "site")
        append("visited", ranked.select(*KEY, "place", "seen", "rank"), F.lit(turn))
        ranked = rows_of("visited", turn)
        wanted = ranked.filter(F.col("seen") + F.col("rank") <= max_pages).select(*KEY, "place")
        fetched = pages.filter(F.col("status") == 200).select("site", "url", "html")
        fetched = fetched.join(broadcast_if_small(wanted, "site", "url"), KEY)
        is_doc = u.is_api_documentation(F.col("url"), F.col("html"))
        parsed = with_parsed_html(fetched.withColumn("is_doc", is_doc))
        resolved = F.transform("parsed.links", lambda href: u.resolve_url(F.col("url"), href))
        steps = parsed.select(*KEY, "place", "is_doc", resolved.alias("links")).select(
            *KEY, "place", "is_doc", followed_links(F.col("links"), F.col("site"), links_per_page).alias("links")
        )
        append("steps", steps, F.lit(turn))
        steps = rows_of("steps", turn)
        links = numbered(steps.select("site", "place", F.posexplode("links").alias("i", "url")), ["place", "i"], "k")
        left = F.greatest(F.col("waiting") - batch, number)
        taken = F.floor((F.col("left") + F.col("k") - 1) / batch).cast("int") + (turn + 1)
        places = links.join(state.select("site", left.alias("left"), "given"), "site")
        append("queue", places.select(*KEY, (F.col("given") + F.col("k") - 1).alias("place"), "left", "k"), taken)
        added = steps.groupBy("site").agg(F.sum(F.size("links")).alias("added"))
        visited = ranked.groupBy("site").agg(F.count(F.lit(1)).alias("visited"))
        state = state.join(added, "site", "left").join(visited, "site", "left").fillna(0, ["added", "visited"])
        state = materialize(
            state.select("site", (left + F.col("added")).alias("waiting"), (F.col("given") + F.col("added")).alias("given"), (F.col("seen") + F.col("visited")).alias("seen")),
            "state",
        )
        turn += 1
    return rows_of("steps").filter("is_doc").select(*KEY).distinct()


def union_discovered(*found: DataFrame) -> DataFrame:
    """Set union of (site, url)."""
    first, *others = [f.select("site", "url") for f in found]
    for other in others:
        first = first.unionByName(other)
    return first.distinct()


def allowed_pages(pages: DataFrame, agent: str) -> DataFrame:
    """Pages that the robots.txt of their site, if it is among them, lets the agent read."""
    allowed = robots_allowed(pages, robots_rules(pages), agent)
    return allowed.filter("allowed").select(pages.columns)


def discover(
    pages: DataFrame, sites: DataFrame | None = None, crawl_below: int | None = None, agent: str | None = None, **limits
) -> DataFrame:
    """(site, url) of the documentation pages of every site.

    Usual paths and sitemaps, and what a crawl finds. ``crawl_below``: only sites with fewer urls
    than that from paths and sitemaps are crawled. ``agent``: pages that robots.txt keeps from it are
    as good as missing.
    """
    sites = (pages if sites is None else sites).select("site").distinct()
    if agent is not None:
        pages = allowed_pages(pages, agent)
    found = materialize(
        union_discovered(common_path_candidates(pages), sitemap_urls(pages)), "discovered"
    )
    if crawl_below is None:
        return union_discovered(found, crawl(pages, sites, **limits))
    counts = found.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.filter(F.col("n") >= crawl_below)
    poor = sites.join(enough, "site", "left_anti")
    return union_discovered(found, crawl(pages, poor, **limits))


def listed_urls(listed: DataFrame, column: str = "urls") -> DataFrame:
    """(site, url) out of comma-separated url lists, each url stripped."""
    split = listed.select("site", F.explode(F.split(column, ",")).alias("url"))
    return split.select("site", strip(F.col("url")).alias("url")).distinct()


def newest_pages(pages: DataFrame) -> DataFrame:
    """One row per (site, url): the one fetched last; of equal times the first by a digest of its content.

    The rank needs keys and digests only. Where no page was fetched twice nothing else is done; else
    markup passes the join with the chosen rows, and none is sorted.
    """
    content = F.sha2(F.concat_ws("\0", F.col("status").cast("string"), "content_type", "html"), 256)
    keyed = pages.withColumn("_digest", content)
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("fetched_at"), "_digest"))
    keys = keyed.select(*KEY, "fetched_at", "_digest")
    best = materialize(keys.withColumn("_rank", rank).filter("_rank = 1").drop("_rank"), "newest")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*KEY, "fetched_at", "_digest")]
    met = keyed.alias("p").join(best.alias("b"), same, "left_semi")
    # equal rows are one: they differ in nothing that a digest sees
    if best.count() == pages.count():
        return pages
    return met.dropDuplicates([*KEY, "_digest"]).drop("_digest")


def select_pages_by_url(pages: DataFrame, urls: DataFrame | Sequence[str] | str) -> DataFrame:
    """The pages named by hand: a table (site, url), a list, or one comma-separated string."""
    if isinstance(urls, DataFrame):
        return pages.join(urls.select("site", "url"), ["site", "url"], "left_semi")
    if isinstance(urls, str):
        urls = [url.strip() for url in urls.split(",")]
    return pages.filter(F.col("url").isin(*urls))
