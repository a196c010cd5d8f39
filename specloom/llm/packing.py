"""Best-fit packing of token sequences after a dominance reduction.

The number of pieces grows with the corpus, the number of different lengths doesn't: it is at most
the capacity. So the instance is a histogram (one row per length), whatever the number of pieces:

1. Martello-Toth reduction over lengths with multiplicities. Take a piece j. If one feasible set that
   holds j dominates all others that hold j (each of them can be split into groups that fit the places
   of the dominating set), an optimal packing with that set exists, and it is fixed for good:
   {j} if nothing fits beside j; {j, k} if k fills the rest exactly, if no two others fit beside j, or
   if at most two fit and no pair is more than k; {j, a, b} if at most two fit, a is the largest that
   fits, b the largest beside it, and no pair of pieces above b fits.
   A rule fixes as many equal sets as there are pieces for, so a length is used up with each step.
2. The rest is packed best-fit decreasing, again in groups: bins of equal contents are one row.

Both write rules "of length L, the pieces ranked lo to hi go to sequences base, base + 1, ...". Spark
ranks the pieces of each length (counts of sub-buckets, then row numbers inside one) and looks up the
rule. Only the histogram and the rules meet the driver: their size is bounded by the capacity.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.llm.bpe import Memo, byte_alphabet, small_batches
from specloom.llm.common import boxed, partitions, ship
from specloom.workspace import materialize

WORD_VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0

#: Rows of one sub-bucket, about; a length that a third of all pieces have is split into many.
RANK_ROWS = 20_000

_memos: dict[str, WordMemo] = {}


#: A word of lower-case letters up to U+00FF (none of them changes under NFC), then ASCII symbols that
#: begin no contraction.
PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")


class WordMemo(Memo):
    """Memo of words that may end in symbols.

    The vocabulary keeps letters and other symbols apart, so the letters of a plain word and the symbols
    behind them are encoded alone. Letters need no normalization and no split: the library's model gets
    them as they are, its bytes written in the alphabet of byte-level vocabularies.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.tokenizer.model
        self.alphabet = {b: ord(c) for c, b in byte_alphabet().items()}

    def look_up(self, word: bytes) -> bytes:
        found = PLAIN.fullmatch(word.decode())
        if not found:
            return super().look_up(word)
        letters, symbols = (x.encode() for x in found.groups())
        if symbols:
            return self[letters] + self[symbols]
        return self.written([t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.alphabet))])


def word_ids(texts: list[bytes | None], path: str) -> list[bytes]:
    """Ids of texts in UTF-8 under a vocabulary that lower-cases and drops white space.

    Chunks between blanks are encoded alone. Lower-casing ASCII first makes more of them equal; a text
    that may hold the string of a special token stays as it is.
    """
    if path not in _memos:
        _memos[path] = WordMemo(path)
    encode = _memos[path].encode
    return [encode((t if b"<|" in t else t.lower()).split()) if t else b"" for t in texts]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int | None = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents: key, piece (from 0), start (ids before it), length, ids (32-bit little-endian).

    A document is the ids of its text, then ``end_id``. Only documents above ``capacity`` are cut, into
    full pieces and a rest. A null text is empty; a document without any id (no ``end_id``) has no
    piece. Null and repeated keys are kept as they are; other columns are dropped.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType().add("key", kind).add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids", T.BinaryType())
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], "text"):
                rows, piece, start, ids = [], [], [], []
                for i, found in enumerate(word_ids(batch["text"].cast(pa.binary()).to_pylist(), path)):
                    found += end
                    for k, at in enumerate(range(0, len(found), 4 * capacity)):
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        ids.append(found[at : at + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["key"].take(pa.array(rows, pa.int32())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["key", "piece", "start", "length", "ids"],
                )

    return docs.mapInArrow(run, schema).withColumnRenamed("key", key)


class _Plan:
    """Rules for pieces and groups of equal bins, from a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.taken, self.bins = capacity, dict(counts), dict.fromkeys(counts, 0), 0
        self.alive = sorted(n for n, c in counts.items() if c)
        self.rules: list[tuple[int, int, int, int, int, int]] = []  # length, lo, hi, base, offset, pieces in a row

    def take(self, length: int, bins: int, base: int, offset: int, row: int = 1) -> None:
        n, lo = bins * row, self.taken[length]
        self.rules.append((length, lo, lo + n, base, offset, row))
        self.taken[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.alive.pop(bisect_left(self.alive, length))

    def fix(self, *lengths: int) -> None:
        """Close as many bins with these lengths as there are pieces."""
        n = min(self.left[x] // lengths.count(x) for x in lengths)
        base, offset = self.bins, 0
        for x in sorted(set(lengths), reverse=True):
            self.take(x, n, base, offset, lengths.count(x))
            offset += x * lengths.count(x)
        self.bins += n

    def beside(self, length: int, room: int, *others: int) -> int | None:
        """The largest length up to ``room`` that a piece is left of, apart from these."""
        for i in range(bisect_right(self.alive, room) - 1, -1, -1):
            x = self.alive[i]
            if self.left[x] > (x == length) + others.count(x):
                return x
        return None

    def smallest(self, length: int, n: int, above: int = 0) -> list[int]:
        """The n smallest pieces over a length, apart from one of ``length``."""
        out: list[int] = []
        for x in self.alive[bisect_right(self.alive, above) :]:
            out += [x] * min(n - len(out), self.left[x] - (x == length))
            if len(out) == n:
                break
        return out

    def best_pair(self, length: int, room: int) -> int:
        best = 0
        for a in reversed(self.alive[: bisect_right(self.alive, room)]):
            if 2 * a <= best:
                break
            if self.left[a] > (a == length) and (b := self.beside(length, min(a, room - a), a)):
                best = max(best, a + b)
        return best

    def dominating(self, j: int) -> tuple[int, ...] | None:
        """The set with j that dominates all others with j, if one of up to three pieces is known."""
        room = self.capacity - j
        k = self.beside(j, room)
        if k is None:
            return (j,)
        low = self.smallest(j, 3)
        if k == room or len(low) < 2 or low[0] + low[1] > room:
            return (j, k)
        if len(low) == 3 and sum(low) <= room:
            return None
        if k >= self.best_pair(j, room):
            return (j, k)
        b = self.beside(j, room - k, k)
        if b is None:
            return None
        over = self.smallest(j, 2, b)
        return (j, k, b) if len(over) < 2 or sum(over) > room else None

    def reduce(self) -> None:
        """Fix dominating sets, from the longest piece down, until none is found."""
        changed = True
        while changed:
            changed = False
            for j in sorted(self.alive, reverse=True):
                while self.left[j] and (found := self.dominating(j)):
                    self.fix(*found)
                    changed = True

    def best_fit(self) -> None:
        """Pack what is left, longest first, each piece into the fullest bin that has room."""
        open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
        rooms: list[int] = []

        def put(room: int, first: int, n: int) -> None:
            if not room or not n:
                return
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((first, n))

        for x in sorted(self.alive, reverse=True):
            while self.left[x]:
                i = bisect_left(rooms, x)
                room = rooms[i] if i < len(rooms) else self.capacity
                row = min(room // x, self.left[x])
                bins = self.left[x] // row
                if room == self.capacity and i == len(rooms):
                    first = self.bins
                    self.bins += bins
                else:
                    first, n = open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room]
                        rooms.pop(i)
                    bins = min(bins, n)
                    put(room, first + bins, n - bins)
                self.take(x, bins, first, self.capacity - room, row)
                put(room - row * x, first, bins)


def plan(counts: dict[int, int], capacity: int) -> _Plan:
    """Rules and number of bins for pieces counted by length (1 to capacity)."""
    made = _Plan(counts, capacity)
    made.reduce()
    made.best_fit()
    return made


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``pieces``, and ``sequence_id`` and ``offset``: the place of each piece.

    ``order``: columns that tell pieces of one length apart (all of the table's by default); rows equal
    in them are interchangeable. Every piece gets a place, equal rows get different ones; the pieces of
    a sequence lie side by side from 0. Lengths that are null, below 1 or above the capacity fail. An
    empty table gives an empty one; columns called sequence_id and offset are replaced.
    """
    spark = pieces.sparkSession
    row = F.col("row")
    rows = boxed(pieces, "sequence_id", "offset")
    keys = [row[c] for c in order or rows.schema["row"].dataType.names]
    wrong = F.raise_error(F.lit(f"a piece's length must be from 1 to {capacity}")).cast("long")
    size = row[length].cast("long")
    held = materialize(rows.withColumn("size", F.when(size.between(1, capacity), size).otherwise(wrong)), "pieces")
    counts = {r[0]: r[1] for r in held.groupBy("size").count().collect()}
    made = plan(counts, capacity)
    total = sum(counts.values())

    rules = (
        spark.createDataFrame(made.rules, "size long, lo long, hi long, base long, offset long, line long")
        .groupBy("size")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "offset", "line"))).alias("rules"))
    )
    bucket = F.pmod(F.xxhash64(*keys), F.lit(-(-total // RANK_ROWS) or 1)).cast("int")
    dealt = held.withColumn("bucket", bucket)
    sizes = dealt.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = (
        dealt.repartition(partitions(held, total, RANK_ROWS), "size", "bucket")
        .withColumn("at", F.row_number().over(Window.partitionBy("size", "bucket").orderBy(*keys)) - 1)
        .join(starts, ["size", "bucket"])
        .select("row", "size", (F.col("at") + F.col("before")).alias("rank"))
    )
    rank = F.col("rank")
    placed = ranked.join(F.broadcast(rules), "size").withColumn(
        "rule", F.filter("rules", lambda r: (r["lo"] <= rank) & (rank < r["hi"]))[0]
    )
    inside = rank - F.col("rule.lo")
    return placed.select(
        "row.*",
        (F.col("rule.base") + F.floor(inside / F.col("rule.line")).cast("long")).alias("sequence_id"),
        (F.col("rule.offset") + F.pmod(inside, F.col("rule.line")) * F.col("size")).alias("offset"),
    )


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids; a sequence is at most the capacity."""
    at = F.sort_array(F.collect_list(F.struct("offset", ids)))
    joined = F.aggregate(at, F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x[ids]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias(ids))
