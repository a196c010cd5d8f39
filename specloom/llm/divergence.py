"""How far the sources of a language differ in their words: joint tables of count levels, priced.

Words are counted per group (language, source). A language keeps its words that stand in enough of its
documents; every kept word has a price p in a group, which follows from its count there (its level).
The divergence of two groups is the sum over kept words of f(p, q), so it needs of each pair of groups
only the joint table: how many words have one level here and the other there.

1. Words are counted inside the tasks, in dictionaries that are handed on when they hold ENTRIES words,
   and added up by Spark: a frequent word is a few rows of each task.
2. Words of about one frequency (its number of binary digits) are dealt to blocks by hash, groups to
   blocks of a few groups. A tile is a block of words with a pair of blocks of groups. In it every
   (group, level) is an indicator column over the words, level 0 (the word doesn't occur) too, and the
   matrix of these columns times its transpose is every joint table of the tile. Words of one frequency
   have few levels, so the matrices are narrow. Products are of 0 and 1, added up in 32 bits below 2^24:
   exact.
3. Each tile prices its tables and returns one sum for a pair of groups; words of the block that occur
   in neither block of groups are added by their number afterwards.

No tile is larger than a block of words times two blocks of groups; of one word, a task that adds up gets
a row per group from each of the tasks before. All numbers are integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.llm.bpe import small_batches
from specloom.llm.common import ship
from specloom.operators.skew import salted_join
from specloom.workspace import broadcast_if_small, materialize

#: Documents of its language that a word is kept from, and ranks of the words listed for a group.
LEAST_DOCUMENTS, RANKS = 10, 10
#: Words and groups of a block, on average; columns of a matrix product.
WORDS, GROUPS, COLUMNS = 1024, 16, 1024
#: Words in the dictionaries of a task, and bytes of a text that are split at once.
ENTRIES, PIECE = 400_000, 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes of UTF-8: A-Z lower-cased, what stands in ASCII between letters a blank.
TABLE = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))
GROUP = ["lang", "source"]


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size; a word stays whole."""
    plain = text.translate(TABLE)
    at = 0
    while len(plain) - at > PIECE:
        end = plain.find(b" ", at + PIECE)
        if end < 0:
            break
        yield plain[at:end].split()
        at = end
    yield plain[at:].split()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a word in a group, and rows of it that hold the word.

    A word is a run of letters and of characters beyond ASCII, A-Z lower-cased.
    """

    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> pa.RecordBatch:
            names = [k for k, (n, _) in found.items() for _ in n]
            terms = [t for n, _ in found.values() for t in n]
            columns = [
                pa.array([k[0] for k in names], pa.string()),
                pa.array([k[1] for k in names], pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([c for n, _ in found.values() for c in n.values()], pa.int64()),
                pa.array([d[t] for n, d in found.values() for t in n], pa.int64()),
            ]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, [*GROUP, "term", "n", "docs"])

        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for key, text in zip(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True), texts, strict=True):
                n, d = found.setdefault(key, (Counter(), Counter()))
                distinct = set()
                for words in pieces_of(text.as_py()):
                    n.update(words)
                    distinct.update(words)
                d.update(distinct)
            if sum(len(n) for n, _ in found.values()) > ENTRIES:
                yield rows()
        yield rows()

    def ordered(batches):
        for batch in batches:
            yield from small_batches([batch], "text")

    schema = "lang string, source string, term string, n bigint, docs bigint"
    each = docs.select(*GROUP, "text").mapInArrow(lambda b: run(ordered(b)), schema)
    # a task's rows differ, so adding up before the shuffle would shorten nothing; all groups of a word meet
    return each.repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)), in integers."""
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = (total + 2 * kept).cast("decimal(20,0)")
    return (F.call_function("div", above, below) + 1).cast("bigint")


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); prices are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint_tables(levels: np.ndarray, other: np.ndarray, upper: bool = False):
    """Joint tables of all pairs of columns of two matrices (words, groups) of prices.

    Yields (groups, prices, groups, prices, table): the columns (group, price) of either side in slices
    and the number of words that have both. ``upper``: slices without a group of the left side before
    one of the right side are left out.
    """

    def one_hot(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, price, columns = [], [], []
        for g in range(matrix.shape[1]):
            found, which = np.unique(matrix[:, g], return_inverse=True)
            at.append(np.full(len(found), g))
            price.append(found)
            columns.append(np.arange(len(found))[:, None] == which[None, :])
        return np.concatenate(at), np.concatenate(price), np.concatenate(columns).astype(np.float32)

    a, b = one_hot(levels), one_hot(other)
    for i in range(0, len(a[0]), COLUMNS):
        for j in range(0, len(b[0]), COLUMNS):
            left, right = (x[i : i + COLUMNS] for x in a), (x[j : j + COLUMNS] for x in b)
            (ga, pa_, xa), (gb, pb, xb) = left, right
            if upper and ga[0] >= gb[-1]:
                continue
            yield ga, pa_, gb, pb, (xa @ xb.T).astype(np.int64)


def tile_sums(levels: np.ndarray, other: np.ndarray, upper: bool = False) -> np.ndarray:
    """The sum of f over the words for every pair of columns of the two matrices; ``upper``: of those
    where the left one comes first."""
    out = np.zeros((levels.shape[1], other.shape[1]), np.int64)
    for ga, pa_, gb, pb, table in joint_tables(levels, other, upper):
        priced = table * _squares(pa_[:, None], pb[None, :])
        rows, columns = np.flatnonzero(np.diff(ga, prepend=-1)), np.flatnonzero(np.diff(gb, prepend=-1))
        out[np.ix_(ga[rows], gb[columns])] += np.add.reduceat(np.add.reduceat(priced, rows, axis=0), columns, axis=1)
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Rows of a tile (side, source, p0, term, p) to a row per pair of groups; a null term lists a group."""
    table = table.combine_chunks().sort_by([("side", "ascending"), ("source", "ascending")])
    term = table["term"].combine_chunks().dictionary_encode()
    words = len(term.dictionary)
    at = term.indices.to_numpy(zero_copy_only=False)  # nan for a null term
    listed = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
    side, p0, p = (table[c].to_numpy() for c in ("side", "p0", "p"))
    source = table["source"].combine_chunks().dictionary_encode()
    number, names = source.indices.to_numpy(), source.dictionary

    def matrix(which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = side == which
        groups, first = np.unique(number[mine], return_index=True)
        base = p0[mine][first]
        prices = np.tile(base, (words, 1))
        some = mine & ~listed
        prices[at[some].astype(np.int64), np.searchsorted(groups, number[some])] = p[some]
        return groups, base, prices

    same = table["i"][0].as_py() == table["j"][0].as_py()
    a = matrix(0)
    b = a if same else matrix(1)
    some = words and len(a[0]) and len(b[0])  # a block of groups may be empty
    sums = tile_sums(a[2], b[2], same) if some else np.zeros((len(a[0]), len(b[0])), np.int64)
    x, y = np.meshgrid(np.arange(len(a[0])), np.arange(len(b[0])), indexing="ij")
    keep = (a[0][x] < b[0][y]) if same else np.ones_like(x, bool)
    x, y = x[keep], y[keep]
    return pa.table(
        {
            "lang": pa.array([table["lang"][0].as_py()] * len(x), pa.string()),
            "one": names.take(pa.array(a[0][x], pa.int64())).cast(pa.string()),
            "other": names.take(pa.array(b[0][y], pa.int64())).cast(pa.string()),
            "part_value": pa.array(sums[x, y], pa.int64()),
            "seen": pa.array(np.full(len(x), words), pa.int64()),
        }
    )


def _tiles(groups: DataFrame, sizes: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, one, other, part_value, seen) of every tile.

    groups: lang, source, p0, blocks; sizes: lang, digits, word_blocks; kept: lang, source, p0, blocks,
    digits, words (its block), term, p.
    """
    columns = [*GROUP, "digits", "words", "term", "p", "p0", "blocks"]
    listed = groups.join(sizes, "lang").withColumns({"term": F.lit(None).cast("string"), "p": F.col("p0")})
    listed = listed.withColumn("words", F.explode(F.sequence(F.lit(0), F.col("word_blocks") - 1)))
    rows = kept.select(columns).unionByName(listed.select(columns))
    mine = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("g", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "lang", "digits", "words", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"),
        F.when(F.col("g") <= F.col("o"), 0).otherwise(1).alias("side"), "source", "p0", "term", "p",
    )
    schema = "lang string, one string, other string, part_value bigint, seen bigint"
    return dealt.groupBy("lang", "digits", "words", "i", "j").applyInArrow(_tile, schema)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each group apart.

    Part ``pair``: every other source of the language, by divergence. Part ``term``: words that are dearer
    in the group than in its language, the first ``ranks`` by f. Rank from 1, highest value first, ties by
    the item's bytes. Null text, lang and source are empty strings; a group without words has prices all
    the same. A language without kept words has divergences of 0, one with a single source no pairs.
    Repeated rows count each; ids and other columns aren't read. No rows: no rows.
    """
    ship(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    blocks = lambda n, per: F.greatest(F.ceil(F.col(n) / per), F.lit(1)).cast("int")
    word = Window.partitionBy("lang", "term")
    of_lang = {"lang_n": F.sum("n").over(word), "docs": F.sum("docs").over(word), "first": F.min("source").over(word)}
    found = counts(docs).withColumns(of_lang).filter(F.col("docs") >= least).drop("docs")
    found = found.withColumns({"first": F.col("first") == F.col("source"), "digits": F.length(F.bin("lang_n"))})
    found = materialize(found, "kept")
    terms = found.filter("first")  # one row of each
    alike = terms.groupBy("lang", "digits").agg(F.count(F.lit(1)).alias("n"))
    alike = materialize(alike.select("lang", "digits", blocks("n", WORDS).alias("word_blocks")), "alike")

    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = docs.select(*GROUP).distinct().join(totals, GROUP, "left").join(sizes, "lang", "left")
    groups = materialize(groups.fillna(0, ["total", "kept", "lang_total"]), "groups")
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    p0 = F.when(F.col("kept") > 0, _price(F.lit(0).cast("bigint"), F.col("total"), F.col("kept")))
    groups = groups.join(sources, "lang").withColumns({"blocks": blocks("sources", GROUPS), "p0": p0})
    groups = materialize(groups, "groups")

    priced = salted_join(found, groups, GROUP, ["term"], how="inner")
    priced = priced.join(broadcast_if_small(alike, "lang"), ["lang", "digits"])
    priced = materialize(
        priced.withColumn("words", F.pmod(F.xxhash64("term"), F.col("word_blocks")).cast("int"))
        .withColumn("p", _price(F.col("n"), F.col("total"), F.col("kept")))
        .withColumn("lang_p", _price(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
        .select(*GROUP, "term", "p", "lang_p", "p0", "sources", "blocks", "digits", "words"),
        "priced",
    )

    with_words = groups.filter((F.col("kept") > 0) & (F.col("sources") > 1))
    tiles = _tiles(with_words, alike, priced.filter(F.col("sources") > 1))
    sums = materialize(tiles.groupBy("lang", "one", "other").agg(F.sum("part_value").alias("s"), F.sum("seen").alias("seen")), "pairs")
    both = sums.select("lang", F.col("one").alias("source"), F.col("other").alias("item"), "s", "seen").unionByName(
        sums.select("lang", F.col("other").alias("source"), F.col("one").alias("item"), "s", "seen")
    )
    here = groups.select(*GROUP, F.col("p0").alias("mine"), "kept")
    there = groups.select("lang", F.col("source").alias("item"), "p0")
    met = here.join(there, "lang").filter(F.col("source") != F.col("item")).join(both, ["lang", "source", "item"], "left")
    unseen = (F.col("kept") - F.col("seen")) * _distance(F.col("mine"), F.col("p0"))
    pairs = met.select(*GROUP, F.lit("pair").alias("part"), "item", F.coalesce(F.col("s") + unseen, F.lit(0)).cast("bigint").alias("value"))

    apart = priced.filter(F.col("p") > F.col("lang_p"))
    apart = apart.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("lang_p")).alias("value"))
    place = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    listed = apart.withColumn("rank", place).filter(F.col("rank") <= ranks)
    return pairs.withColumn("rank", place).unionByName(listed)


def oracle_sql(least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> str:
    """The registered query in DuckDB SQL: every kept word in every group, every pair of groups."""
    price = "CAST(1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * v) AS BIGINT)"
    f = "CAST(((p - q)::HUGEINT * (p - q)) // (p + q) AS BIGINT)"
    return rf"""
    WITH d AS (
        SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS MATERIALIZED (SELECT row, lang, source, unnest(w) AS term FROM d),
    k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {least}),
    l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
    p AS MATERIALIZED (
        SELECT lang, source, term, coalesce(c.n, 0) AS n, {price.format("coalesce(c.n, 0)", "coalesce(s.n, 0)")} AS p, {price.format("k.n", "l.n")} AS q
        FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
    pairs AS (
        SELECT lang, a.source, b.source AS item, sum({f}) AS value
        FROM (SELECT lang, source, term, p FROM p) a JOIN (SELECT lang, source, term, p AS q FROM p) b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    r AS (
        SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN pairs z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
        UNION ALL
        SELECT lang, source, 'term', term, {f} FROM p WHERE n > 0 AND p > q),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
    SELECT * FROM o WHERE part = 'pair' OR rank <= {ranks}
    """
