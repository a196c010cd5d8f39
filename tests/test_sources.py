"""Archive of descriptions and cache: written, replaced, compacted, read back."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from specloom.operators import cache
from specloom.sources import tables

SPECS = "site STRING, part LONG, spec_json STRING"


def specs(spark, n, text):
    return spark.createDataFrame([(f"https://s{i:03}.example.com", 0, f'{{"{text}":{i}}}') for i in range(n)], SPECS)


def test_archive_is_a_few_files_and_reads_back(spark, tmp_path):
    path = str(tmp_path / "archive")
    first = tables.write_archive(specs(spark, 250, "old"), path, documents_per_file=100)
    back = tables.read_archive(spark, path)
    want = sorted((f"https://s{i:03}.example.com", f'{{"old":{i}}}') for i in range(250))
    assert sorted((r["site"], r["spec_json"]) for r in back.collect()) == want
    assert all(r["size_bytes"] == len(r["spec_json"]) and r["file_name"].endswith(".openapi.json") for r in back.collect())
    files = [f for f in os.listdir(f"{path}/versions/{first}") if f.endswith(".parquet")]
    assert 2 <= len(files) <= 3
    one = tables.read_archive(spark, path, ["https://s007.example.com"])
    assert [r["spec_json"] for r in one.collect()] == ['{"old":7}']
    assert "PushedFilters: [IsNotNull(site)" in one._jdf.queryExecution().toString()


def test_a_reader_keeps_its_version_and_the_next_gets_the_new_one(spark, tmp_path):
    path = str(tmp_path / "archive")
    tables.write_archive(specs(spark, 5, "old"), path)
    before = tables.read_archive(spark, path)
    tables.write_archive(specs(spark, 3, "new"), path)
    assert before.count() == 5 and before.filter(F.contains("spec_json", F.lit("old"))).count() == 5
    assert sorted(r["spec_json"] for r in tables.read_archive(spark, path).collect()) == [f'{{"new":{i}}}' for i in range(3)]
    assert sorted(f for f in os.listdir(path) if not f.startswith(".")) == ["MANIFEST", "versions"]
    empty = tables.write_archive(specs(spark, 1, "x").filter("false"), path)
    assert empty and tables.read_archive(spark, path).count() == 0


def entries(spark, day, keys, kind="llm"):
    at = datetime(2024, 1, 1) + timedelta(days=day)
    return spark.createDataFrame([(f"h{k}", kind, at, f"{kind}-{day}-{k}") for k in keys], "content_hash STRING, kind STRING, created_at TIMESTAMP, payload STRING")


def newest(spark, path, kind="llm"):
    return {r["content_hash"]: r["payload"] for r in cache.newest_entries(tables.read_cache(spark, path), kind).collect()}


def test_cache_keeps_the_newest_through_compaction(spark, tmp_path):
    path = str(tmp_path / "cache")
    tables.write_cache(entries(spark, 1, range(40)), path)
    tables.write_cache(entries(spark, 3, range(0, 40, 2)), path)
    tables.write_cache(entries(spark, 2, range(0, 40, 4)), path)
    tables.write_cache(entries(spark, 5, range(3), "http"), path)
    want = {f"h{k}": f"llm-{3 if k % 2 == 0 else 1}-{k}" for k in range(40)}
    assert newest(spark, path) == want
    tables.compact_cache(spark, path)
    assert newest(spark, path) == want and tables.read_cache(spark, path).count() == 43
    assert newest(spark, path, "http") == {f"h{k}": f"http-5-{k}" for k in range(3)}
    tables.write_cache(entries(spark, 9, [7]), path)
    assert newest(spark, path) == want | {"h7": "llm-9-7"}


def test_only_buckets_of_the_documents_are_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    tables.write_cache(entries(spark, 1, range(300)), path)
    documents = spark.createDataFrame([("h5", "s", "u"), ("h5", "s", "v"), ("none", "s", "w")], "content_hash STRING, site STRING, url STRING")
    held = tables.read_cache(spark, path, documents)
    assert 0 < held.count() < 60
    now = F.lit("2024-01-02").cast("timestamp")
    got = {r["url"]: r["payload"] for r in cache.cache_lookup(documents, held, now, 10**6).collect()}
    assert got == {"u": "llm-1-5", "v": "llm-1-5", "w": None}
