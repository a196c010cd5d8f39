"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import bpe, centroids, divergence, docquality, langid, mainpart, neardup, packing, quality, secretscan, tokencount, topk, urlfilter
from specloom.llm.common import table, vocabulary
from specloom.workspace import materialize

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, vocabulary(packing.WORD_VOCABULARY))
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces, order=("doc_id", "piece", "ids_crc32"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat token files written from all documents."""
    path, end = vocabulary(bpe.BYTE_VOCABULARY), 50_256
    files = tokencount.token_folder(spark)
    tokencount.write_token_files(table(spark, folder, "documents").select("doc_id", "text"), files, path, end)
    counts = tokencount.token_counts(spark, files, end, tokencount.HEADER_IDS)
    # the number of a file stays from run to run, its name doesn't
    file = F.coalesce(F.nullif(F.regexp_extract("file", r"^part-0*([0-9]+)", 1), F.lit("")), F.col("file"))
    return counts.select(
        tokencount.number(F.col("header")).alias("doc_id"), "n_tokens", file.alias("file"), "doc_index", "start", "closed"
    )


@query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    path = vocabulary(bpe.BYTE_VOCABULARY)
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all rules in every whole text."""
    found = secretscan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["rank"] < len(secretscan.BASE))

    def count(rank: int):
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secretscan.written(base).cast("binary"), 256).alias("base_sha256"),
        secretscan.written(spans).alias("spans"),
    )


ORACLES["op10_secrets"] = secretscan.oracle_sql()


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs, labels = (table(spark, folder, n) for n in ("documents", "labels"))
    return quality.judge(docs.select("doc_id", "text"), labels).drop("text")


@query
def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on the url of every page."""
    judged = urlfilter.judge(table(spark, folder, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op8_urls"] = urlfilter.oracle_sql()


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Group of near-duplicates of every document, on shingles of four words."""
    return neardup.near_duplicates(table(spark, folder, "documents"), settings=neardup.Settings(words=4))


ORACLES["op2_near_duplicates"] = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS MATERIALIZED (
        SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
        JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON other = a),
    c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query
def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products of each query with all other vectors."""
    vectors = table(spark, folder, "embeddings").filter(topk.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    vectors = materialize(vectors.select("vec_id", whole.alias("vector")), "vectors")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


ORACLES["op5_top_k"] = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
        FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = mainpart.extract(table(spark, folder, "pages").select("page_id", "url", "html")).drop("html")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; a third of them is held out from learning."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    found = langid.identify(docs.select("doc_id", "text"), docs.filter(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of all usable vectors of 64 components, after three rounds from 16 of them."""
    vectors = table(spark, folder, "embeddings").filter(topk.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(64 * x.cast("double")))
    found = centroids.cluster(vectors.select("vec_id", whole.alias("vector")))
    digest = F.sha2(F.array_join("centroid", ",").cast("binary"), 256)
    return found.withColumn("centroid", digest).withColumnRenamed("centroid", "centroid_sha256")


ORACLES["op12_centroids"] = centroids.oracle_sql()


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of the sources of every language, and the words that set each apart."""
    return divergence.audit(table(spark, folder, "documents").select("text", "lang", "source"))


ORACLES["op13_source_divergence"] = divergence.oracle_sql()


@query
def op11_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; a fifth of them is held out from learning."""
    docs, labels = (table(spark, folder, n) for n in ("documents", "labels"))

    def held_out(of: DataFrame):
        return F.coalesce(F.crc32(of["doc_id"].cast("string").cast("binary")) % 5 == 0, F.lit(False))

    docs = docs.select("doc_id", "text")
    forest = docquality.train(docs, labels.filter(~held_out(labels)))
    found = docquality.score(docs, forest)
    return found.select("doc_id", held_out(found).alias("held_out"), "score", "predicted")
