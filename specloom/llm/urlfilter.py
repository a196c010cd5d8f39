"""URL filters: rules by host and path, and a logistic regression for the rest.

The regression's features are hashed character n-grams of host and path. It is trained from a small
labelled table of URLs by gradient descent with SQL functions: the weights stay in the span of the
training rows, so one coefficient per row is enough, and the steps need only the products of rows with
each other. The result is one weight per bucket, a row of fixed size. A URL's score is the sum of the
weights of its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import boxed, let
from specloom.workspace import materialize

BUCKETS = 4096
GRAM = 4
STEPS, RATE, DECAY = 200, 0.05, 0.001
#: Most rows of the labelled table; more fail, as one task trains on it.
TRAINING_ROWS = 1000

# The rules of the contract, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# The small labelled table. Each blocked host stands beside an allowed one with the same
# path, and the other way round, so that a path says something only where it has a word of its own.
PATHS = (
    "/en/1.html", "/en/22/", "/de/333", "/fr/4444.html", "/es/5/", "/", "", "/index.html",
    "/2020/05/page.html", "/de/61/", "/fr/7", "/es/888.html",
)
BLOCK_HOSTS = (
    "www.casino-royal.test", "m.casino-win.test", "online-casino.test", "poker-casino.test", "free-bets.test",
    "www.sports-bets.test", "bets-today.test", "m.best-bets.test", "cheap-pills.test", "www.cheap-pills.test",
    "pills-online.test", "blog.diet-pills.test", "ads-track.test", "m.ads-track.test", "track-ads.test",
    "www.ads-server.test", "free-money.test", "win-prizes.test", "cheap-loans.test", "payday-loans.test",
    "adult-cams.test", "xxx-videos.test", "crack-downloads.test", "spam-mailer.test",
)
ALLOW_HOSTS = (
    "www.museum.test", "m.weather.test", "library.test", "news.city.test", "docs.software.test",
    "www.university.test", "kitchen.test", "m.travel.test", "garden.test", "www.school.test",
    "hospital.test", "blog.reader.test", "history.test", "m.stories.test", "music.test",
    "www.science.test", "government.test", "forum.test", "photos.test", "books.test",
    "math.test", "gallery.test", "coffee.test", "maps.test",
)
BLOCK_PATHS = ("/casino/slots", "/bets/odds", "/pills/buy", "/ads/click", "/free-money/win", "/xxx/live")
ALLOW_PATHS = ("/articles/33", "/guide/install", "/about", "/research/12", "/recipes/soup", "/topic/81")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for judged, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name = F.when(fits, F.lit(at + start)).otherwise(name)
        verdict = F.when(fits, F.lit(judged)).otherwise(verdict)
    return name, verdict


def buckets(host: Column, path: Column) -> Column:
    """Different buckets of the n-grams of host and path, each with its ends marked; digits are alike."""

    def grams(text: Column, mark: str) -> Column:
        whole = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole) - GRAM + 1, F.lit(1)))
        hashed = lambda w, i: F.conv(F.substring(F.md5(F.concat(F.lit(mark), F.substring(w, i, GRAM)).cast("binary")), 1, 6), 16, 10)
        return let(whole, lambda w: F.transform(starts, lambda i: F.pmod(hashed(w, i).cast("int"), F.lit(BUCKETS)).cast("int")))

    return F.array_distinct(F.concat(grams(host, "h"), grams(path, "p")))


def labelled_rows() -> list[tuple[str, int]]:
    """The labelled table: url, blocked (1 or 0)."""
    hosts = [(h, p, y) for y, group in ((1, BLOCK_HOSTS), (0, ALLOW_HOSTS)) for h, p in zip(group, PATHS * 2, strict=True)]
    paths = [(h, p, y) for y, group in ((1, BLOCK_PATHS), (0, ALLOW_PATHS)) for h, p in zip(("site.test", "www.web.test") * 3, group, strict=True)]
    return [(f"https://{h}{p}", y) for h, p, y in hosts + paths]


def train(table: DataFrame) -> DataFrame:
    """One row: bias and the weight of each bucket, from rows (url, blocked). Rows with nulls don't count.

    Gradient descent on the mean logistic loss with weight decay; equal rows count as often as they are
    there. An empty table gives weights of 0.
    """
    rows = table.filter("url IS NOT NULL AND blocked IS NOT NULL").select("url", "blocked")
    url = F.col("url")
    features = rows.select(F.struct(buckets(host_of(url), path_of(url)).alias("b"), F.col("blocked").cast("double").alias("y"), url).alias("x"))
    one = features.agg(F.sort_array(F.collect_list("x")).alias("all"))
    n = F.size("all")
    one = one.select(F.when(n <= TRAINING_ROWS, F.col("all")).otherwise(F.raise_error(F.lit("too many labelled rows")).cast("array<struct<b:array<int>,y:double,url:string>>")).alias("all"))
    # products of rows with each other; the 1 is the bias
    one = one.withColumn("k", F.transform("all", lambda a: F.transform("all", lambda b: F.size(F.array_intersect(a["b"], b["b"])) + F.lit(1.0))))
    one = materialize(one, "labelled")

    def step(alpha: Column, _: Column) -> Column:
        def new(a: Column, j: Column) -> Column:
            margin = F.aggregate(F.zip_with(F.get("k", j), alpha, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
            error = F.get("all", j)["y"] - 1 / (1 + F.exp(-margin))
            return a * (1 - RATE * DECAY) + RATE * error

        return F.transform(alpha, new)

    zero = F.transform("all", lambda _: F.lit(0.0))
    trained = one.select("all", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step).alias("alpha"))
    bias = F.aggregate("alpha", F.lit(0.0), lambda s, a: s + a)
    pairs = F.zip_with("all", "alpha", lambda x, a: F.struct(x["b"].alias("b"), a.alias("a")))
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda i: F.aggregate("pairs", F.lit(0.0), lambda s, p: s + F.when(F.array_contains(p["b"], i), p["a"]).otherwise(0.0)),
    )
    return trained.select(bias.alias("bias"), pairs.alias("pairs")).select("bias", weights.alias("weights"))


def judge(pages: DataFrame, training: DataFrame | None = None, url: str = "url", rules=RULES) -> DataFrame:
    """All columns of ``pages``, and host, path, rule, score and verdict (allow or block).

    A rule decides where one fits, else the regression: block if the score is above 0. A null URL, or
    one without ://, has an empty host and path and is judged by the regression. Rows are judged one by
    one, so repeated rows give repeated rows; columns of these names are replaced (but not the url).
    """
    spark, row = pages.sparkSession, F.col("row")
    model = materialize(train(training or spark.createDataFrame(labelled_rows(), "url string, blocked int")), "urls")
    found = boxed(pages, *(c for c in ("host", "path", "rule", "score", "verdict") if c != url))
    found = found.withColumn("_host", host_of(row[url])).withColumn("_path", path_of(row[url]))
    found = found.withColumn("_model", model.select(F.struct("bias", "weights")).scalar())
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    score = let(
        F.col("_model"),
        lambda m: m["bias"] + F.aggregate(buckets(F.col("_host"), F.col("_path")), F.lit(0.0), lambda s, b: s + F.get(m["weights"], b)),
    )
    judged = found.select("row", "_host", "_path", rule.alias("_rule"), score.alias("_score"), verdict.alias("_verdict"))
    learned = F.when(F.col("_score") > 0, "block").otherwise("allow")
    return judged.select(
        "row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_score").alias("score"), F.coalesce("_verdict", learned).alias("verdict")
    )


def oracle_sql() -> str:
    """The registered query in DuckDB SQL, training included."""
    rows = ", ".join(f"('{u}', {y}.0)" for u, y in labelled_rows())
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )

    def split(source: str, *more: str) -> str:
        kept = "".join(f", {c}" for c in more)
        return f"""(
            SELECT url{kept}, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM {source})"""

    def grams(text: str, mark: str) -> str:
        return f"""list_transform(generate_series(1, greatest(length({text}) + 2 - {GRAM} + 1, 1)), lambda i:
            CAST(('0x' || substr(md5('{mark}' || substr('^' || translate({text}, '123456789', '000000000') || '$', i, {GRAM})), 1, 6)) AS INTEGER) % {BUCKETS})"""

    found = f"list_distinct(list_concat({grams('host', 'h')}, {grams('path', 'p')}))"
    return f"""
    WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY y, b, url) AS j, url, y, b FROM (
        SELECT url, y, {found} AS b FROM {split(f"(VALUES {rows}) v(url, y)", "y")})),
    k AS MATERIALIZED (
        SELECT a.j, a.y, list(len(list_intersect(a.b, c.b)) + 1.0::DOUBLE ORDER BY c.j) AS row FROM t a, t c GROUP BY ALL),
    gd AS (
        SELECT 0 AS step, list_transform(range(1, (SELECT count(*) FROM t) + 1), lambda x: 0.0::DOUBLE) AS alpha
        UNION ALL
        SELECT step + 1, (
            SELECT list(gd.alpha[k.j] * {1 - RATE * DECAY} + {RATE} * (k.y - 1 / (1 + exp(-list_dot_product(k.row, gd.alpha)))) ORDER BY k.j) FROM k)
        FROM gd WHERE step < {STEPS}),
    a AS MATERIALIZED (SELECT t.b, gd.alpha[t.j] AS a FROM gd, t WHERE step = {STEPS}),
    w AS MATERIALIZED (SELECT bucket, sum(a) AS weight FROM (SELECT unnest(b) AS bucket, a FROM a) GROUP BY bucket),
    p AS (SELECT row_number() OVER () AS row, page_id, url, host, path FROM {split("pages", "page_id")}),
    s AS (
        SELECT row, sum(weight) AS score FROM (SELECT row, unnest({found}) AS bucket FROM p) JOIN w USING (bucket) GROUP BY row),
    r AS (SELECT *, CASE {fits} END AS fit FROM p)
    SELECT page_id, host, path, fit.rule AS rule,
           coalesce(fit.verdict, CASE WHEN coalesce(score, 0) + (SELECT sum(a) FROM a) > 0 THEN 'block' ELSE 'allow' END) AS verdict
    FROM r LEFT JOIN s USING (row)
    """
