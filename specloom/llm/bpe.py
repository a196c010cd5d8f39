"""Byte-pair encoding by forced boundaries, and decoding.

Two neighbouring bytes that stand beside each other in no token of the vocabulary can't be merged, so
every encoding has a boundary between them. ``ForcedBoundaries`` derives the table of such pairs from
the vocabulary and cuts a text there. A fragment's ids don't depend on its surroundings: most
fragments are words, occur again and again and are looked up in a bounded memo; the others go to the
tokenizers library. The ids of a text are those of its fragments, one after the other.

The library splits a text by a pattern before it merges. A cut keeps that split if
- it stands after a character that isn't white space (the pattern looks ahead in white space only, and
  lets a word take one space that stands before it), and
- it doesn't make an apostrophe the first character of a fragment where it stood after another
  symbol (it would then begin a contraction).
Other places aren't cut, also where their bytes never meet in a token.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from specloom.llm.common import ship

BYTE_VOCABULARY = "byte_bpe_50k.json"

#: Fragments that a worker learns before it forgets those not met since it last forgot, and bytes of the
#: longest that it keeps. It bounds memory, not the work: at most twice as many short fragments are held.
MEMO_ENTRIES, MEMO_BYTES = 200_000, 64


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Memo(dict):
    """Ids of fragments (str, or bytes in UTF-8) as bytes, encoded by the library when first seen.

    It has two generations: a fragment of the older one comes back when it is met, the rest is forgotten.
    """

    def __init__(self, path: str, special_as_text: bool = False, dtype: str = "<u4", entries: int = MEMO_ENTRIES):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype, self.entries, self.older = np.dtype(dtype), entries, {}

    def written(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def look_up(self, fragment) -> bytes:
        text = fragment.decode() if isinstance(fragment, bytes) else fragment
        return self.written(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, fragment):
        found = self.older.get(fragment)
        if found is None:
            found = self.look_up(fragment)
        if len(fragment) <= MEMO_BYTES:
            self[fragment] = found
        return found

    def encode(self, fragments: list) -> bytes:
        """The ids of a text given as its fragments."""
        if len(self) > self.entries:
            self.older = self.copy()
            self.clear()
        return b"".join(map(self.__getitem__, fragments))


class ForcedBoundaries:
    """Cuts texts where no token of a byte-level vocabulary can reach across."""

    def __init__(self, path: str, special_as_text: bool = False):
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        alphabet = byte_alphabet()
        special = [t["content"].encode() for t in description["added_tokens"]]
        vocabulary = description["model"]["vocab"]
        self.tokens: dict[int, bytes] = {
            i: bytes(alphabet[c] for c in t) for t, i in vocabulary.items() if t.encode() not in special
        }
        meet = np.zeros((256, 256), bool)
        for token in [*self.tokens.values(), *([] if special_as_text else special)]:
            b = np.frombuffer(token, np.uint8)
            meet[b[:-1], b[1:]] = True
        self.tokens |= {t["id"]: t["content"].encode() for t in description["added_tokens"]}
        byte = np.arange(256)
        start = (byte & 0xC0) != 0x80  # a character begins
        symbol = np.array([not chr(b).isalnum() for b in range(128)] + [True] * 128)
        space = np.isin(byte, [*range(9, 14), *range(28, 33)])
        forced = ~meet & start[None, :] & ~space[:, None]
        forced[symbol, ord("'")] = False
        self.ascii = forced.copy()
        self.ascii[128:] = False
        self.other = forced.copy()
        self.other[:128] = False
        #: First bytes of characters among which is white space outside ASCII.
        self.unsure = np.isin(byte, [0xC2, 0xE1, 0xE2, 0xE3])

    def fragments(self, text: bytes) -> list[bytes]:
        if len(text) < 2:
            return [text] if text else []
        b = np.frombuffer(text, np.uint8)
        cut = self.ascii[b[:-1], b[1:]]
        other = np.flatnonzero(self.other[b[:-1], b[1:]])
        if len(other):  # the character before must be known not to be white space
            lead = b[other - 1]
            for back in (2, 3):
                inside = (lead & 0xC0) == 0x80
                lead = np.where(inside, b[np.maximum(other - back, 0)], lead)
            cut[other[~self.unsure[lead]]] = True
        at = (np.flatnonzero(cut) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False); ids as little-endian 32 bits."""
        tokens = self.tokens
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_workers: dict = {}


def _tools(path: str, special_as_text: bool, dtype: str) -> tuple[Memo, ForcedBoundaries]:
    """One memo per worker, vocabulary and way of writing ids; later tasks find it filled."""
    key = (path, special_as_text, dtype)
    if key not in _workers:
        _workers[key] = Memo(path, special_as_text, dtype), ForcedBoundaries(path, special_as_text)
    return _workers[key]


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that many bytes of text, or of one row."""
    for batch in batches:
        sizes = np.array(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        first = 0
        if sizes.sum() <= limit:
            yield batch
            continue
        total = np.cumsum(sizes)
        while first < len(sizes):
            done = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def encode_texts(texts: list[bytes | None], path: str, special_as_text: bool = False, dtype: str = "<u4") -> list[bytes]:
    """Ids of texts in UTF-8 as bytes; a missing text has none."""
    memo, boundaries = _tools(path, special_as_text, dtype)
    return [memo.encode(boundaries.fragments(t or b"")) for t in texts]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", special_as_text: bool = False, dtype: str = "<u4") -> DataFrame:
    """All columns of ``docs``, and ``ids`` (binary): the ids of the whole text under a byte-level vocabulary.

    A null or empty text has no ids. A column that is already called ``ids`` is replaced. Rows are
    handled one by one: repeated rows give repeated rows, an empty table an empty one.
    ``special_as_text``: strings of special tokens in a text are ordinary text.
    """
    ship(docs.sparkSession)
    docs = docs.drop(ids)

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], text):
                raw = batch[text].cast(pa.binary()).to_pylist()
                done = pa.array(encode_texts(raw, path, special_as_text, dtype), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, done], [*batch.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())]))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``docs``, and the text that the ids stand for; null ids give an empty text.

    Bytes that aren't UTF-8 become replacement characters. An id that the vocabulary hasn't fails.
    """
    ship(docs.sparkSession)
    docs = docs.drop(text)

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], ids):
                _, boundaries = _tools(path, False, "<u4")
                done = [boundaries.decode(x or b"") for x in batch[ids].to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], [*batch.schema.names, text])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())]))
