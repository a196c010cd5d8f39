"""From raw documents to packed training sequences.

Each stage gets what its predecessor kept, does its work on all of it and returns documents; the last
one returns their pieces with places in sequences. ``run`` writes the result of each stage to the shared
folder and reads it again, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm import langid, neardup, packing, quality, secretscan
from specloom.llm.common import table, vocabulary
from specloom.workspace import drop, materialize, tidy

#: Least mean posterior of the language that a text is kept with.
LEAST_SCORE = 0.4
#: Languages that are kept; None: all that are learned.
WANTED: Collection[str] | None = None

ORACLE_SQL = None  # models, hashes and byte pairs; tests hold it against a brute-force version


def aside(docs: DataFrame, *made: str) -> tuple[DataFrame, list]:
    """The table with other names for columns that an operator would replace, and how to get it back."""
    names = {}
    for c in docs.columns:
        name = c
        while name in made or name != c and name in docs.columns:
            name += "_given"
        names[c] = name
    return docs.withColumnsRenamed(names), [F.col(name).alias(c) for c, name in names.items()]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose counts and likelihood ratio pass; texts that are null or too short go."""
    docs, given = aside(docs, *quality.MADE)
    return quality.judge(docs, table(spark, sf_dir, "labels")).filter("kept").select(given)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: Collection[str] | None = WANTED) -> DataFrame:
    """Documents in one of the wanted languages, or in any that the labelled ones are in; texts without a letter go.

    Where no document has a language there is nothing to judge by, and all with a letter stay.
    """
    if docs.filter("lang IS NOT NULL AND text IS NOT NULL").isEmpty():
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    learned = docs.select("doc_id", "text", "lang")
    docs, given = aside(docs, "lang_pred", "score")
    found = langid.identify(docs, learned)
    good = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    if wanted is not None:
        good &= F.col("lang_pred").isin(*wanted)
    return found.filter(good).select(given)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Of rows that share an id one stays, the first in order of its columns (as JSON text). Rows without an
    id stay.
    """
    docs, given = aside(docs, "_row")
    kept = materialize(neardup.near_duplicates(docs).filter("kept").select("doc_id").filter("doc_id IS NOT NULL").distinct(), "kept")
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(F.lit(0).alias("_"), *others)))
    first = docs.join(kept, "doc_id", "left_semi").withColumn("_row", F.row_number().over(order)).filter("_row = 1")
    return first.select(given).unionByName(docs.filter("doc_id IS NULL").select(given))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the kind in brackets; a column n_chars follows."""
    docs, given = aside(docs, "secret_spans")
    found = secretscan.scan(docs)
    some = F.size("secret_spans") > 0
    clean = found.withColumn("text", secretscan.redacted(F.col("text"), F.col("secret_spans")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(given)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    pieces = packing.token_pieces(docs, vocabulary(packing.WORD_VOCABULARY))
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, order=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("secret scans", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. What a stage wrote is deleted when the next one is done with it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with tidy(spark) as kept:
            made = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept.append(made)
        if i:
            drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
