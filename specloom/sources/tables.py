"""Reading and writing the tables of a run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import schemas
from specloom.operators.build import with_file_facts
from specloom.workspace import delete_folder, materialize, replace_file


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages from Parquet; columns a query does not use are never read."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Descriptions, one file each: (spec_id, spec_json)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(
        F.col("_metadata.file_path").alias("spec_id"), F.col("value").alias("spec_json")
    )


def write_specs(specs: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write one directory per document and return (site, part, path, size_bytes, format).

    For as many sites as a folder can have entries; ``write_archive`` is for any number.

    A directory's name begins with that of the host; a hash of the site tells sites of one host apart.
    Documents too large for one row keep one directory per part.
    """
    unique = F.concat(F.regexp_replace("file_name", r"\.openapi\.json\z", "-"), F.substring(F.md5("site"), 1, 12), F.lit(".openapi.json"))
    facts = with_file_facts(specs).withColumn("file_name", unique)
    target = path.rstrip("/")
    facts.select(
        "file_name", F.col("part"), F.col("spec_json").alias("value")
    ).write.mode(mode).partitionBy("file_name", "part").text(target)
    where = F.concat(
        F.lit(f"{target}/file_name="), F.col("file_name"), F.lit("/part="), F.col("part")
    )
    return facts.select("site", "part", where.alias("path"), "size_bytes", "format")


# -- archive ----------------------------------------------------------------------------------------

#: Documents of a file of an archive.
DOCUMENTS_PER_FILE = 10_000
ARCHIVE = "site STRING, part LONG, file_name STRING, size_bytes LONG, format STRING, spec_json STRING"


def write_archive(specs: DataFrame, path: str, documents_per_file: int = DOCUMENTS_PER_FILE) -> str:
    """Write documents (site, part, spec_json) as a few files, sorted by site; the version that was written.

    Files hold many documents each, so their number follows the data and not the sites, and their
    statistics are the index that a look-up by site reads. A version lies in a folder of its own and is
    named by the manifest once it is whole; the manifest is replaced in one step, so a reader sees the old
    version or the new one. Earlier versions stay until ``delete_folder`` takes them.
    """
    spark, target = specs.sparkSession, path.rstrip("/")
    version = uuid.uuid4().hex
    facts = with_file_facts(specs).select([F.col(f.split()[0]) for f in ARCHIVE.split(", ")])
    files = -(-specs.count() // documents_per_file) or 1
    ranged = facts.repartitionByRange(files, "site", "part") if files > 1 else facts.coalesce(1)
    ranged.sortWithinPartitions("site", "part").write.parquet(f"{target}/versions/{version}")
    replace_file(spark, f"{target}/MANIFEST", version)
    return version


def read_archive(spark: SparkSession, path: str, sites: Sequence[str] | None = None) -> DataFrame:
    """The documents of the version that the manifest names, or those of some sites."""
    target = path.rstrip("/")
    version = spark.read.text(f"{target}/MANIFEST").first()["value"]
    held = spark.read.schema(ARCHIVE).parquet(f"{target}/versions/{version}")
    return held if sites is None else held.filter(F.col("site").isin(*sites))


# -- cache ------------------------------------------------------------------------------------------

#: Buckets of the cache, by a hash of the content hash. Fixed for a cache: part of its layout.
CACHE_BUCKETS = 64


def cache_bucket(content_hash: Column) -> Column:
    return F.pmod(F.xxhash64(content_hash), F.lit(CACHE_BUCKETS)).cast("int")


def read_cache(spark: SparkSession, path: str, documents: DataFrame | None = None) -> DataFrame:
    """All cache entries; ``operators.cache`` picks the newest fresh one per key.

    ``documents`` (content_hash): only the buckets that their hashes can be in are read.
    """
    held = spark.read.schema(f"{schemas.CACHE}, bucket INT").parquet(path)
    if documents is not None:
        wanted = documents.select(cache_bucket(F.col("content_hash")).alias("bucket")).distinct()
        held = held.filter(F.col("bucket").isin([r["bucket"] for r in wanted.collect()]))
    return held.drop("bucket")


def write_cache(entries: DataFrame, path: str) -> None:
    """Append entries to the buckets of the cache: the newest of a key counts, nothing is rewritten."""
    rows = entries.select("content_hash", "kind", "created_at", "payload", cache_bucket(F.col("content_hash")).alias("bucket"))
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def compact_cache(spark: SparkSession, path: str) -> None:
    """Leave only the newest entry of each key, in one file or few per bucket.

    The new files are written first, then those that were read are deleted. A reader in between, or a run
    that ends there, finds some entries twice, which changes no look-up; entries that are appended
    meanwhile stay.
    """
    held = spark.read.schema(f"{schemas.CACHE}, bucket INT").parquet(path)
    files = held.inputFiles()
    entry = F.struct("created_at", "payload")
    newest = held.groupBy("bucket", "kind", "content_hash").agg(F.max_by(entry, entry).alias("e"))
    # written to a folder of its own first: the same files can't be read and appended to
    done = materialize(newest.select("content_hash", "kind", "e.created_at", "e.payload", "bucket"), "cache")
    done.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    for file in files:
        delete_folder(spark, file)
