"""Text and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom import patterns as p


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` removes blanks only)."""
    return F.regexp_replace(text, rf"\A{p.SPACE}+|{p.SPACE}+\z", "")


def clean_text(text: Column) -> Column:
    """Squeeze blank lines and blanks, drop lines of one to three characters, strip."""
    squeezed = F.regexp_replace(text, rf"\n{p.SPACE}*\n", "\n\n")
    squeezed = F.regexp_replace(squeezed, " +", " ")
    return strip(drop_short_lines(squeezed))


def drop_short_lines(text: Column) -> Column:
    """Drop lines whose stripped length is 1 to 3; blank lines stay."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~F.length(strip(line)).between(1, 3))
    return F.array_join(kept, "\n")


def valid_samples(samples: Column) -> Column:
    """Strip code samples and keep those longer than ten characters."""
    return F.filter(F.transform(samples, strip), lambda s: F.length(s) > 10)


def page_title(title: Column, heading: Column) -> Column:
    """A non-empty ``<title>``, else the first heading, else ``Untitled``; stripped."""
    return F.coalesce(strip(F.when(title != "", title)), strip(heading), F.lit("Untitled"))


def token_estimate(text: Column, samples: Column) -> Column:
    """A quarter of all characters of text and code samples, rounded down."""
    code = F.aggregate(samples, F.lit(0), lambda n, s: n + F.length(s))
    return F.floor((F.length(text) + code) / 4)


def content_hash(text: Column) -> Column:
    """MD5 of the leading characters of a text: the key of the extraction cache."""
    return F.md5(F.substring(text, 1, p.HASHED_CHARS))


def document_hash(title: Column, text: Column, samples: Column) -> Column:
    """MD5 of all of a document: pages that share it are the same to an extraction function."""
    return F.md5(F.to_json(F.struct(title.alias("title"), text.alias("text"), samples.alias("samples"))))


def truncate(text: Column, limit: int = p.PROMPT_CHARS) -> Column:
    """Cut a prompt to a limit and say so."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(p.TRUNCATION_MARK))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def document_prompt(url: Column, title: Column, text: Column, samples: Column) -> Column:
    """What a model is shown of a document: address, title, text and the first code samples."""
    return truncate(whole_document(url, title, text, F.slice(samples, 1, p.PROMPT_SAMPLES)))


def whole_document(url: Column, title: Column, text: Column, samples: Column) -> Column:
    """Address, title, text and code samples as one text."""
    head = F.concat(F.lit("URL: "), url, F.lit("\nTitle: "), title, F.lit("\n\n"), text)
    fenced = F.transform(
        samples,
        lambda s, i: F.concat(
            F.lit("\nSample "), (i + 1).cast("string"), F.lit(":\n```\n"), s, F.lit("\n```\n")
        ),
    )
    code = F.concat(F.lit("\n\nCode Samples:\n"), F.array_join(fenced, ""))
    return F.concat(head, F.when(F.size(samples) > 0, code).otherwise(""))


