"""From crawled pages to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom import patterns as p
from specloom.functions import text as t
from specloom.functions.html import visible_length, with_parsed_html

JSON_TITLE = "JSON API Spec"


def fetched(pages: DataFrame) -> DataFrame:
    """Pages that were answered with success."""
    return pages.filter(F.col("status").between(200, 299))


def extract_content(pages: DataFrame) -> DataFrame:
    """Documents (site, url, title, text, code_samples, token_estimate, content_hash).

    JSON responses are kept raw and never parsed as markup. Everything is narrow: pages stay in the
    partition they were read in.
    """
    body, url = F.col("html"), F.col("url")
    is_json = F.coalesce(F.contains(F.lower("content_type"), F.lit("application/json")), F.lit(False))
    answered = fetched(pages).select(
        "site",
        url,
        F.when(is_json, body).alias("raw"),
        F.when(~is_json, body).alias("html"),
    )
    parsed = with_parsed_html(answered)
    raw = F.col("raw")
    documents = parsed.filter(raw.isNotNull() | F.col("parsed").isNotNull()).select(
        "site",
        "url",
        F.when(raw.isNotNull(), JSON_TITLE)
        .otherwise(t.page_title(F.col("parsed.title"), F.col("parsed.heading")))
        .alias("title"),
        F.coalesce(raw, t.clean_text(F.col("parsed.body"))).alias("text"),
        F.when(raw.isNotNull(), F.array(raw))
        .otherwise(t.valid_samples(F.col("parsed.samples")))
        .alias("code_samples"),
    )
    return documents.select(
        "*",
        t.token_estimate(F.col("text"), F.col("code_samples")).alias("token_estimate"),
        t.document_hash(F.col("title"), F.col("text"), F.col("code_samples")).alias("content_hash"),
    )


def with_needs_render(frame: DataFrame, column: str = "text", out: str = "needs_render") -> DataFrame:
    """Flag pages that carry marks of a script-drawn application and hardly any text.

    ``column`` is the extracted text (as a pipeline run checks it) or the html. Only rows with a
    mark are sent to the markup helper.
    """
    marked = F.rlike(F.col(column), F.lit("(?iu)" + p.any_of(p.RENDER_INDICATORS)))
    length = visible_length(F.when(marked, F.col(column)))
    return frame.withColumn(out, F.coalesce(length < p.RENDER_TEXT_LIMIT, F.lit(False)))
