"""Quality of documents: fixed counts, and a log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words fall into hashed buckets. Two multinomials over the buckets are
counted: the raw corpus (every document) and the trusted target (documents labelled good; a bounded
sample of them, as a classifier may have). A document's verdict is the mean, over its n-grams, of
log p_target - log p_raw, against one threshold; it depends on the document and the model alone.

All of it is SQL functions. The corpus is read once for the model and once for the verdicts; texts
pass no shuffle. Only the model, of fixed size, goes to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import SPACES, boxed, let
from specloom.workspace import materialize

#: Buckets of the hashed n-grams. With few of them rare n-grams of bad texts drown among common ones, with
#: many the n-grams of good texts outside of the target count as foreign; chosen with the threshold on
#: labelled documents held out of the target (README).
BUCKETS = 32_768
#: Trusted documents that the target is counted over, the ones with the smallest hash of their id.
TRUSTED = 20_000
#: Weight of the priors, in n-grams per bucket: the raw corpus leans on the uniform distribution, the
#: target on the raw corpus, so that little evidence for either gives ratios near 0.
SMOOTHING = 1.0
#: Least mean log-likelihood ratio of a document that is kept.
THRESHOLD = -0.065
SYMBOLS = "#*$%&|<>"
#: Columns that ``judge`` adds.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _following(hashes: Column, *steps: int) -> Column:
    """For each position, one hash of the values at it and at these steps behind; only whole ones."""
    n = F.size(hashes) - max(steps)

    def combined(i: Column) -> Column:
        return F.xxhash64(F.get(hashes, i), *(F.get(hashes, i + s) for s in steps))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), combined)).otherwise(F.array().cast("array<bigint>"))


def _repeated(pairs: Column) -> Column:
    """Words in windows of eight that occur twice or more, from the hashes of neighbouring words."""

    def covered(keys: Column) -> Column:
        def marked(s: Column) -> Column:  # windows in order of their key, then place
            same = lambda i, j: F.get(s, i)["k"] == F.get(s, j)["k"]
            at = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["i"]),
                ),
                lambda x: x.isNotNull(),
            )
            zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last"))
            step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("bigint").alias("n"), p.alias("last"))
            return F.aggregate(F.sort_array(at), zero, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(keys, lambda key, i: F.struct(key.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("bigint")).otherwise(let(ordered, marked))

    return let(_following(pairs, 2, 4, 6), covered)


def base(text: Column, words: Column, pairs: Column) -> dict[str, Column]:
    """The fixed counts. words: of the text; pairs: hashes of its neighbouring words."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(_without(body, SPACES)).cast("bigint"),
        "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": _repeated(pairs),
    }


def _bucket(value: Column) -> Column:
    return F.pmod(value, F.lit(BUCKETS)).cast("int")


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """``_words``, ``_hashes`` of the words, and ``_pairs``: hashes of neighbouring words."""
    hashed = docs.withColumn("_words", words_of(F.col(text)))
    hashed = hashed.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("_pairs", let(F.col("_hashes"), lambda h: _following(h, 1)))


def model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", trusted: int = TRUSTED) -> DataFrame:
    """One row: the log-likelihood ratio of each bucket, as an array.

    ``labels`` has the key and ``quality`` (1: good). Without any trusted document the target is the
    raw corpus, and all ratios are 0.
    """
    good = labels.filter("quality = 1").select(F.col(key).alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(trusted)
    flagged = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(good), F.col("_key") == F.col("_good"), "left")
    hashed = _hashed(flagged.select((F.col("_good").isNotNull()).cast("int").alias("_target"), "_text"), "_text")
    grams = hashed.select("_target", F.explode(F.concat("_hashes", "_pairs")).alias("_h")).select("_target", _bucket(F.col("_h")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_target").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    n = lambda field: F.coalesce(field, F.lit(0))
    one = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("_c"), n(F.sum("raw")).alias("_r"), n(F.sum("target")).alias("_t"))

    def ratio_of(c: Column) -> Column:
        raw = (n(c["raw"]) + SMOOTHING) / (F.col("_r") + SMOOTHING * BUCKETS)
        target = (n(c["target"]) + SMOOTHING * BUCKETS * raw) / (F.col("_t") + SMOOTHING * BUCKETS)
        return F.ln(target) - F.ln(raw)

    ratio = F.transform("_c", ratio_of)
    return one.select(ratio.alias("weights"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, trusted: int = TRUSTED) -> DataFrame:
    """All columns of ``docs``, the fixed counts, ``base_failed``, ``llr`` and ``kept``.

    ``llr``: the mean ratio over words and pairs; 0 without words. A null or empty text has counts of 0
    and fails. ``kept``: the base didn't fail and llr reaches the threshold. Rows are judged one by one,
    so repeated rows, null ids and ties change nothing; columns of these names are replaced.
    """
    held = materialize(model(docs, labels, key, text, trusted), "quality")
    rows = boxed(docs, *MADE).withColumn("_text", F.col("row")[text])
    hashed = _hashed(rows, "_text").withColumn("_weights", held.select("weights").scalar())
    grams = F.concat("_hashes", "_pairs")

    def mean(w: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda a, h: a + F.get(w, _bucket(h)))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(0.0)

    counts = base(F.col("_text"), F.col("_words"), F.col("_pairs"))
    # behind a generator, so that a filter on the verdict isn't pushed below and the counts computed anew
    found = F.struct(*(c.alias(n) for n, c in counts.items()), let(F.col("_weights"), mean).alias("llr"))
    scored = hashed.select("row", F.explode_outer(F.array(found)).alias("_found")).select("row.*", "_found.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
