"""Token counts of documents in flat files of token ids that have no index.

A file is ids of fixed width, one after the other; ``separator`` ends a document. A file may be of any
size: it is read in blocks, each by any executor.

1. Each block looks for separators in its ids with one vectorised comparison. It knows the documents
   that begin and end inside it, where a document that began before it ends, and where the one that
   runs on begins.
2. A prefix scan over the blocks of a file (a few numbers per block) hands on the start of the open
   document and the number of separators so far. With that the document across blocks is whole, and
   every document has its number in the file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.bpe import encode_texts, small_batches
from specloom.llm.common import ship
from specloom.workspace import materialize, shared_folder

#: Ids in a block.
BLOCK_IDS = 4 * 1024 * 1024
#: Ids of 16 bits: a vocabulary of less than 65,536 tokens.
WIDTH = 2
#: Ids before a document's tokens that carry its number, 13 bits each, above those of the vocabulary.
HEADER_IDS, HEADER_BITS, HEADER_BASE = 5, 13, 50_304

DOCUMENT = "struct<start: bigint, end: bigint, header: array<int>>"


def header(number: int | None) -> bytes:
    """A 64-bit number as ids above the vocabulary; none: as many ids, all of the value beyond."""
    if number is None:
        return np.full(HEADER_IDS, HEADER_BASE + (1 << HEADER_BITS), "<u2").tobytes()
    number &= (1 << 64) - 1
    parts = [HEADER_BASE + (number >> HEADER_BITS * i & (1 << HEADER_BITS) - 1) for i in range(HEADER_IDS)]
    return np.array(parts, "<u2").tobytes()


def number(ids):
    """The column that ``header`` wrote: the number, or null."""
    low = F.lit(0).cast("long")
    for i in range(HEADER_IDS):
        low = low.bitwiseOR(F.shiftleft((ids[i] - HEADER_BASE).cast("long"), HEADER_BITS * i))
    return F.when(ids[0] < HEADER_BASE + (1 << HEADER_BITS), low)


def write_token_files(docs: DataFrame, folder: str, path: str, separator: int, key: str = "doc_id", text: str = "text") -> None:
    """Write each document as its header, the ids of its text and the separator, 16 bits an id.

    The files are flat: Spark's text writer puts the separator, as bytes, where a line would end. A null
    text has no ids; strings of special tokens are ordinary text, so a separator is never a token.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], "text"):
                ids = encode_texts(batch["text"].cast(pa.binary()).to_pylist(), path, True, "<u2")
                rows = [header(k) + x for k, x in zip(batch["key"].to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["ids"])

    end = np.array([separator], "<u2").tobytes().decode("latin-1")
    encoded = docs.mapInArrow(run, "ids binary")
    encoded.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", end).option("encoding", "ISO-8859-1").text(folder)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _scan(ids: np.ndarray, block: np.ndarray, first: int, separator: int, header_ids: int) -> dict:
    """Documents of one block. ids: the block, then as many of the next as a header may take."""
    ends = np.flatnonzero(block == separator)
    starts = [0] if first == 0 else []
    starts = np.concatenate([np.array(starts, np.int64), ends + 1])
    heads = [ids[s : s + header_ids].tolist() for s in starts.tolist()]
    documents = [{"start": first + s, "end": None, "header": h} for s, h in zip(starts.tolist(), heads, strict=True)]
    closing = (ends if first == 0 else ends[1:]).tolist()
    for document, end in zip(documents, closing, strict=False):
        document["end"] = first + end
    open_ = documents[len(closing) :]
    return {
        "n_ends": len(ends),
        "first_end": first + int(ends[0]) if first and len(ends) else None,
        "documents": documents[: len(closing)],
        "open": open_[0] if open_ else None,
    }


def token_counts(spark: SparkSession, folder: str, separator: int, header_ids: int = 0, width: int = WIDTH, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document: file (its name), doc_index (from 0), start (in ids), n_tokens, header, closed.

    ``header_ids`` ids at the start of a document aren't counted but returned. ``closed`` is false for
    tokens behind the last separator of a file. An empty document counts 0; a file without ids has
    none. A document shorter than its header counts 0. A file whose size isn't a multiple of the width
    fails. No file is held whole, and no document: a block is.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(folder).select("path", "length")
    size = F.floor(F.col("length") / width).cast("long")
    whole = F.when(F.col("length") % width == 0, size).otherwise(F.raise_error(F.lit("not a whole number of ids")).cast("long"))
    blocks = (
        files.withColumn("size", whole)
        .filter("size > 0")
        .select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_ids).cast("long"))).alias("first"))
        .repartition(F.col("path"), F.col("first"))
    )
    schema = f"path string, size bigint, first bigint, n_ends bigint, first_end bigint, documents array<{DOCUMENT}>, open {DOCUMENT}"
    kind = np.dtype(f"<u{width}")

    document = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("header", pa.list_(pa.int32()))])
    arrow = pa.schema(
        [("path", pa.string()), ("size", pa.int64()), ("first", pa.int64()), ("n_ends", pa.int64()), ("first_end", pa.int64()), ("documents", pa.list_(document)), ("open", document)]
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    file.seek(row["first"] * width)
                    ids = np.frombuffer(file.read((block_ids + header_ids) * width), kind)
                found = _scan(ids, ids[:block_ids], row["first"], separator, header_ids)
                yield pa.RecordBatch.from_pylist([row | found], arrow)

    scanned = materialize(blocks.mapInArrow(run, schema), "blocks")
    # the prefix scan reads a few numbers of each block; its documents stay where they are
    order = Window.partitionBy("path").orderBy("first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    prefix = scanned.select("path", "first", "n_ends", "open").select(
        "path",
        "first",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("done"),
        F.last("open", ignorenulls=True).over(before).alias("carried"),
        F.last("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("left"),
    )
    stitched = scanned.join(prefix, ["path", "first"]).withColumn("is_last", F.col("first") + block_ids >= F.col("size"))
    none = F.array().cast(f"array<{DOCUMENT}>")
    across = F.when(
        F.col("first_end").isNotNull(),
        F.array(F.struct(F.col("carried.start").alias("start"), F.col("first_end").alias("end"), F.col("carried.header").alias("header"))),
    ).otherwise(none)
    rest = F.when(
        F.col("is_last") & (F.col("left.start") < F.col("size")),
        F.array(F.struct(F.col("left.start").alias("start"), F.lit(None).cast("long").alias("end"), F.col("left.header").alias("header"))),
    ).otherwise(none)
    rows = stitched.select("path", "size", "done", F.posexplode(F.concat(across, "documents", rest)).alias("at", "d"))
    end = F.coalesce("d.end", "size")
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        (F.col("done") + F.col("at")).alias("doc_index"),
        F.col("d.start").alias("start"),
        F.greatest(end - F.col("d.start") - header_ids, F.lit(0)).cast("long").alias("n_tokens"),
        F.col("d.header").alias("header"),
        F.col("d.end").isNotNull().alias("closed"),
    )


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files, in the shared one."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/specloom/tokens-{uuid.uuid4().hex}"
