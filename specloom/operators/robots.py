"""Robots rules as rows: what the standard parser of robots.txt does, as windows over the lines of a file.

A group of a file is a run of agent lines and the rules behind it. A blank line ends it, and so does an
agent line behind a rule; rules without agents and agents without rules count for nothing. Of the groups
for everybody the first one holds, behind all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import urls as u
from specloom.functions.text import strip
from specloom.operators.skew import salted_join

# What ends a line, and the fields of a file.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
RULES = ("disallow", "allow", "crawl-delay", "request-rate")
FILE = ["site", "file"]


def _decoded(text: Column) -> Column:
    """Percent signs decoded; one that starts no code stays."""
    plain = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(text, F.lit("%")), F.try_url_decode(plain)).otherwise(text)


def _prefix(value: Column) -> Column:
    """A path as it is compared: without tabs and an empty query."""
    return F.regexp_replace(F.translate(value, "\t\r\n", ""), r"\?\z", "")


def robots_files(pages: DataFrame) -> DataFrame:
    """(site, file, access, lines) of the robots.txt pages; ``file`` tells different ones of a site apart.

    access: ``none`` where the site refuses to show its file or fails, ``all`` where there is none, else
    ``rules``. Equal rows are one.
    """
    address = F.concat(u.host_root(F.col("site")), F.lit("/robots.txt"))
    status = F.col("status")
    access = F.when(status.isin(401, 403) | (status >= 500), "none").when((status >= 400) | status.isNull(), "all").otherwise("rules")
    files = pages.filter(F.col("url") == address).select("site", access.alias("access"), F.coalesce("html", F.lit("")).alias("html")).distinct()
    lines = F.when(F.col("access") == "rules", F.split("html", LINE_ENDS))
    return files.select("site", F.md5(F.concat("access", "html")).alias("file"), "access", lines.alias("lines"))


def _field(line: Column, part: int) -> Column:
    """Name (1) or value (2) of a line without its comment; null where there is no colon."""
    found = F.regexp_extract(F.regexp_replace(line, "#.*", ""), "^([^:]*):(.*)$", part)
    return F.lower(strip(found)) if part == 1 else strip(found)


def robots_lines(files: DataFrame) -> DataFrame:
    """(site, file, n, name, value) of the lines that matter; name is null for a blank line."""
    each = files.select(*FILE, F.posexplode("lines").alias("n", "line"))
    blank = F.col("line") == ""
    named = each.select(*FILE, "n", F.when(~blank, _field(F.col("line"), 1)).alias("name"), F.when(~blank, _decoded(_field(F.col("line"), 2))).alias("value"))
    return named.filter(F.col("name").isNull() | F.col("name").isin("user-agent", *RULES))


def robots_groups(lines: DataFrame) -> DataFrame:
    """(site, file, everybody, number, agents, delay, rules): a row per group that holds, in order."""
    is_agent = F.coalesce(F.col("name") == "user-agent", F.lit(False))
    parts = F.sum(F.col("name").isNull().cast("int")).over(Window.partitionBy(*FILE).orderBy("n"))
    of_part = Window.partitionBy(*FILE, "part").orderBy("n")
    starts = is_agent & ~F.coalesce(F.lag(is_agent).over(of_part), F.lit(False))
    marked = lines.withColumn("part", parts).withColumn("starts", starts)
    marked = marked.withColumn("number", F.sum(F.col("starts").cast("int")).over(of_part)).filter((F.col("number") > 0) & F.col("name").isNotNull())

    def listed(flag: Column, *fields: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(flag, F.struct("n", *fields))))

    value, name = F.col("value"), F.col("name")
    rule = name.isin("allow", "disallow")
    allow = (name == "allow") | (value == "")
    delay = F.try_to_number(F.when((name == "crawl-delay") & F.rlike(value, F.lit("^[0-9]{1,9}$")), value), F.lit("999999999")).cast("int")
    groups = marked.groupBy(*FILE, "part", "number").agg(
        listed(is_agent, F.lower(value).alias("agent")).alias("agents"),
        F.bool_or(is_agent & (value == "*")).alias("everybody"),
        listed(rule, allow.alias("allow"), _prefix(value).alias("prefix")).alias("rules"),
        F.max_by(delay, F.when(delay.isNotNull(), F.col("n"))).alias("delay"),
        F.count_if(~is_agent).alias("n_rules"),
    )
    first = F.row_number().over(Window.partitionBy(*FILE, "everybody").orderBy("part", "number"))
    kept = groups.filter("n_rules > 0").withColumn("place", first).filter(~F.col("everybody") | (F.col("place") == 1))
    return kept.select(
        *FILE, "everybody", F.col("place").alias("number"), F.col("agents.agent").alias("agents"), "delay",
        F.transform("rules", lambda r: F.struct(r["allow"].alias("allow"), r["prefix"].alias("prefix"))).alias("rules"),
    )


def robots_rules(pages: DataFrame) -> DataFrame:
    """(site, access, groups, sitemaps) from the robots.txt pages; the group for everybody comes last.

    One row per file: its groups are as bounded as the file is.
    """
    files = robots_files(pages)
    groups = robots_groups(robots_lines(files))
    group = F.struct("everybody", "number", "agents", "delay", "rules")
    held = groups.groupBy(*FILE).agg(F.array_sort(F.collect_list(group)).alias("groups"))
    named = F.filter("lines", lambda line: _field(line, 1) == "sitemap")
    sitemaps = F.transform(named, lambda line: _decoded(_field(line, 2)))
    joined = files.select(*FILE, "access", F.when(F.size(sitemaps) > 0, sitemaps).alias("sitemaps")).join(held, FILE, "left")
    plain = F.transform("groups", lambda g: F.struct(g["agents"].alias("agents"), g["delay"].alias("delay"), g["rules"].alias("rules")))
    none = F.array().cast("array<struct<agents: array<string>, delay: int, rules: array<struct<allow: boolean, prefix: string>>>>")
    return joined.select("site", "access", F.coalesce(plain, none).alias("groups"), "sitemaps")


def _group_for(agent: str) -> Column:
    """The first group that names the agent, or everybody."""
    name = F.lit(agent.split("/")[0].lower())
    applies = F.filter(
        "groups",
        lambda g: F.exists(g["agents"], lambda a: (a == "*") | F.contains(name, a)),
    )
    return F.get(applies, F.lit(0))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Add ``allowed`` to a table (site, url): the first rule that fits decides.

    A site without robots row allows everything. One site may own a large share of the urls, hence
    the salted join; the rules of a site are one row.
    """
    of_agent = robots.select("site", "access", _group_for(agent)["rules"].alias("_rules"))
    joined = salted_join(urls, of_agent, ["site"], ["url"])
    tail = F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?(.*)$", 1)
    plain = F.coalesce(_decoded(tail), tail)
    path = F.when(plain == "", "/").otherwise(plain)
    fitting = F.filter("_rules", lambda r: path.startswith(r["prefix"]))
    by_rule = F.coalesce(F.get(fitting, F.lit(0))["allow"], F.lit(True))
    allowed = F.when(F.col("access") == "none", False).otherwise(
        F.when(F.col("access") == "rules", by_rule).otherwise(True)
    )
    return joined.withColumn("allowed", allowed).drop("access", "_rules")


def crawl_delay(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(site, crawl_delay) for an agent; null when none is set."""
    return robots.select("site", _group_for(agent)["delay"].cast("double").alias("crawl_delay"))


def has_sitemap(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, has_sitemap): robots.txt lists one, or could not be read."""
    listed = robots.select(
        "site", F.coalesce(F.size("sitemaps") > 0, F.lit(False)).alias("has_sitemap")
    )
    return sites.select("site").distinct().join(listed, "site", "left").fillna(True)
