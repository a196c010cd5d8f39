"""Near-duplicate groups by MinHash with one permutation, star-shaped candidates and exact checks.

1. Every text becomes the set of its word shingles, as 64-bit hashes. Texts with equal sets form a
   class before anything else; a class of any size goes on as one row, its smallest id.
2. One-permutation hashing: one hash function deals a set into bins, the smallest hash of a bin is its
   value. Empty bins are filled by optimal densification: each tries bins in an order of its own until
   one isn't empty, so that it agrees between two sets with probability of their similarity.
   Groups of ``rows`` bins are the bands; sets with an equal band meet in a bucket.
3. Each bucket has a centre, the member that shares most buckets with others, and its other members are
   candidates with the centre only: a star. Candidates are confirmed on the full sets. What is confirmed
   forms components.
4. No link may be lost where a member links to another one but not to the centre. Buckets whose members
   are now in one component have nothing to add. The others get a star round a centre from another
   component, and so on for some rounds; what is left then (few rows: texts of low similarity that share
   a bucket) is checked completely, in blocks of fixed size: the members outside of the largest component
   of a group against all of it, many pairs with one matrix product, and only links leave the task.

Only hashes and ids pass the shuffles of the search. Sets are computed again for members of buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.llm.bpe import small_batches
from specloom.llm.common import ship
from specloom.workspace import materialize


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, links at 100 * intersection >= percent * union, bands of rows bins each.

    A pair at the limit of 0.8 misses all 40 buckets with a chance of 2e-9.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 4
    rounds: int = 3  # stars; what they leave is checked in blocks
    block: int = 256  # members of a block
    spread: int = 2_000  # candidates of one centre that meet in a task


#: Words of which a worker keeps the hash.
WORD_ENTRIES = 1_000_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        self[word] = found = xxh3_64_intdigest(word)
        return found


_words = _Words()


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted different hashes of each text's shingles; a text of fewer words is one shingle."""
    if len(_words) > WORD_ENTRIES:
        _words.clear()
    split = [t.lower().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split])
    flat = np.fromiter((h for w in split for h in map(_words.__getitem__, w)), np.uint64, sizes.sum())
    n = max(len(flat) - words + 1, 0)
    joined = np.zeros(n, np.uint64)
    for i in range(words):
        joined = mix(joined + flat[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    out, at = [], 0
    for size in sizes.tolist():
        if size >= words:
            out.append(np.unique(joined[at : at + size - words + 1]))
        elif size:
            h = np.zeros(1, np.uint64)
            for w in flat[at : at + size]:
                h = mix(h + w + np.uint64(0x9E3779B97F4A7C15))
            out.append(mix(h + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row per set (none may be empty), a value per bin, by one permutation and optimal densification."""
    values = np.zeros((len(sets), bins), np.uint64)
    filled = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        h = mix(s)
        h.sort()
        bin_ = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bin_, prepend=-1))
        values[i, bin_[first]] = h[first]
        filled[i, bin_[first]] = True
    row, col = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        tried = mix(col.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(bins)
        tried = tried.astype(np.int64)
        good = filled[row, tried]
        values[row[good], col[good]] = values[row[good], tried[good]]
        row, col = row[~good], col[~good]
    return values


def band_hashes(values: np.ndarray, bands: int) -> np.ndarray:
    parts = values.reshape(len(values), bands, -1)
    out = np.zeros(parts.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for i in range(parts.shape[2]):
        out = mix(out + parts[:, :, i])
    return out.view(np.int64)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def sketch(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """id, n_shingles, digest of the set, and the hash of each band; null digest and bands for no word."""
    import hashlib

    ship(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], "text", 2_000_000):
                sets = shingle_sets(batch["text"].cast(pa.binary()).to_pylist(), settings.words)
                some = [i for i, s in enumerate(sets) if len(s)]
                digests, bands = [None] * len(sets), [None] * len(sets)
                if some:
                    hashed = band_hashes(signatures([sets[i] for i in some], settings.bands * settings.rows), settings.bands)
                    for i, h in zip(some, hashed, strict=True):
                        digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        bands[i] = h
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "n_shingles", "digest", "bands"],
                )

    return _keyed(docs, key, text).mapInArrow(run, "id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def full_sets(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """id and the set of each text as 64-bit numbers in order."""
    ship(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], "text", 2_000_000):
                sets = [s.view(np.int64) for s in shingle_sets(batch["text"].cast(pa.binary()).to_pylist(), settings.words)]
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return _keyed(docs, key, text).mapInArrow(run, "id bigint, shingles array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """id and root, the smallest id it is linked with, for the ids of links (a, b).

    Each round every id points to the smallest among itself and its neighbours, pointers are followed
    to their ends (chains halve with each step), and links are kept between the ends only. What a round
    needs is written, so a lost executor costs one step.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    edges, found = materialize(both, "edges"), None
    while found is None or not edges.isEmpty():
        to = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "id"), "pointers")
        while True:
            then = to.select(F.col("id").alias("to"), F.col("to").alias("then"))
            followed = materialize(to.join(then, "to").select("id", F.col("then").alias("to"), (F.col("then") != F.col("to")).alias("new")), "pointers")
            to = followed.select("id", "to")
            if followed.filter("new").isEmpty():
                break
        if found is None:
            found = to.withColumnRenamed("to", "root")
        else:
            old = found.withColumnRenamed("root", "was")
            found = old.join(to.select(F.col("id").alias("was"), "to"), "was", "left").select("id", F.coalesce("to", "was").alias("root"))
            found = materialize(found, "roots")
        a = to.select(F.col("id").alias("a"), F.col("to").alias("ra"))
        b = to.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        left = edges.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = materialize(left.filter("a <> b").distinct(), "edges")
    return found


def _hot(counts: DataFrame, key: str, total: int, least: int) -> DataFrame:
    """Keys with over a thousandth of all rows, at most a thousand of them, with their number of parts."""
    limit = max(least, total // 1000)
    return F.broadcast(counts.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts")))


def on_bucket(rows: DataFrame, facts: DataFrame, hot: DataFrame) -> DataFrame:
    """Inner join of members with what is known of their buckets, one row each.

    The few buckets that hold a large share of all members are looked up by broadcast: their members
    stay where they are instead of meeting in one task.
    """
    few = F.broadcast(facts.join(hot, "bucket", "left_semi"))
    return rows.join(few, "bucket").unionByName(rows.join(hot, "bucket", "left_anti").join(facts, "bucket"))


def confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Of candidates (id, centre) those whose full sets are similar enough, as links (a, b).

    A centre with very many candidates meets them in several tasks.
    """
    counts = materialize(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = _hot(counts, "centre", total, settings.spread)
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")
    dealt = pairs.join(hot, "centre", "left").select("id", "centre", part.alias("part"))
    centres = sets.select(F.col("id").alias("centre"), F.col("shingles").alias("b")).join(counts.select("centre"), "centre", "left_semi")
    centres = centres.join(hot, "centre", "left").select("centre", "b", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = dealt.join(sets.withColumnRenamed("shingles", "a"), "id").join(centres, ["centre", "part"])
    common = F.size(F.array_intersect("a", "b"))
    similar = met.withColumn("common", common).filter(100 * F.col("common") >= settings.percent * (F.size("a") + F.size("b") - F.col("common")))
    return similar.select(F.col("id").alias("a"), F.col("centre").alias("b"))


def block_links(ids: list[int], roots: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1  # others are in no intersection
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(shared.sum()), 8192):
        lo, hi = np.searchsorted(column, [first, first + 8192])
        part = np.zeros((len(sets), 8192), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        common += (part @ part.T).astype(np.int64)  # 8192 at most in a product: exact
    union = sizes[:, None] + sizes[None, :] - common
    root = np.array(roots)
    i, j = np.nonzero(np.triu(100 * common >= percent * union, 1) & (root[:, None] != root[None, :]))
    return [(ids[a], ids[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def rest_links(rest: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """All links across components within groups; rest: (grp, id, root), links (a, b).

    The largest component of a group isn't compared with itself, all else is, in pairs of blocks.
    """
    by_root = rest.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n"))
    of_group = by_root.groupBy("grp").agg(
        F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")
    )
    blocks = lambda n: F.ceil(n / settings.block).cast("int")
    sized = of_group.select("grp", "main", blocks(F.col("n_main")).alias("mains"), blocks(F.col("n_all") - F.col("n_main")).alias("others"))
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    met = rest.join(sized, "grp").join(sets, "id")
    ordered = lambda x, y: F.struct(F.lit(0).alias("kind"), F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))
    beside = lambda x, y: F.struct(F.lit(1).alias("kind"), x.alias("i"), y.alias("j"))
    other = block(F.col("others"))
    tasks_other = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: ordered(other, j)),
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda j: beside(other, j)),
    )
    tasks_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: beside(i, block(F.col("mains"))))
    tasks = F.when(F.col("root") == F.col("main"), tasks_main).otherwise(tasks_other)
    dealt = met.filter("others > 0").select("grp", "id", "root", "shingles", F.explode(tasks).alias("task"))
    dealt = dealt.select("grp", "task.kind", "task.i", "task.j", "id", "root", "shingles")
    percent = settings.percent

    def run(table: pa.Table) -> pa.Table:
        columns = table.combine_chunks()
        sets = [s.values.to_numpy() for s in columns["shingles"]]
        found = block_links(columns["id"].to_pylist(), columns["root"].to_pylist(), sets, percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return dealt.groupBy("grp", "kind", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: the key, n_shingles, component_id (smallest key reachable), kept.

    Texts are compared as sets of word shingles after lower-casing A-Z. A null text, or one without
    words, has an empty set and is linked with nothing; equal sets are linked. Rows that share a key are
    one document: it is linked with what any of its texts is linked with. A null key is in no component
    (component_id null) and kept. ``kept``: the key is the smallest of its component, so one document of
    each group stays. Keys are 64-bit integers.
    """
    kind = docs.schema[key].dataType
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"the key must be an integer, not {kind.simpleString()}")
    sketched = materialize(sketch(docs, key, text, settings), "sketches")
    worded = sketched.filter("digest IS NOT NULL AND id IS NOT NULL")
    classes = worded.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")

    # buckets of classes, by the hash of a band
    first = worded.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"])
    banded = first.select("id", F.col("n_shingles").cast("int").alias("size"), F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    full = materialize(full, "sizes")
    of_buckets = full.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most a thousand, by the share of members that each holds
    hot = F.broadcast(full.filter(F.col("n") > max(settings.spread, of_buckets // 1000)).select("bucket"))
    members = materialize(on_bucket(banded, full, hot), "buckets")
    common = members.groupBy("id").agg(F.sum("n").alias("met"))
    members = materialize(members.drop("n").join(common, "id"), "members")
    met = docs.select(key, text).join(members.select(F.col("id").alias(key)).distinct(), key, "left_semi")
    sets = materialize(full_sets(met, key, text, settings).dropDuplicates(["id", "shingles"]), "sets")

    links, mixed = None, members.withColumn("root", F.col("id"))
    main = None
    for _ in range(settings.rounds - 1):
        outside = mixed if main is None else on_bucket(mixed, main, hot).filter(F.col("root") != F.col("main"))
        centres = outside.groupBy("bucket").agg(F.max_by(F.struct("id", "size", "root"), F.struct("met", -F.col("id"))).alias("c"))
        centres = materialize(centres, "centres")
        pairs = on_bucket(mixed, centres, hot).filter(
            (F.col("root") != F.col("c.root")) & (100 * F.least("size", "c.size") >= settings.percent * F.greatest("size", "c.size"))
        )
        pairs = materialize(pairs.select("id", F.col("c.id").alias("centre")).distinct(), "pairs")
        new = materialize(confirmed(pairs, sets, settings), "links")
        links = new if links is None else links.union(new)
        roots = components(links)
        joined = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        several = joined.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
        main = centres.join(roots.withColumnRenamed("id", "of"), F.col("c.id") == F.col("of"), "left").select("bucket", F.coalesce("root", "c.id").alias("main"))
        main = materialize(main, "main")
        mixed = materialize(on_bucket(joined, several, hot), "mixed")

    # what the stars leave: groups of members that share buckets with other components
    centre = mixed.groupBy("bucket").agg(F.min("id").alias("b"))
    groups = components(on_bucket(mixed, centre, hot).select(F.col("id").alias("a"), "b").distinct())
    rest = groups.select("id", F.col("root").alias("grp")).join(mixed.select("id", "root").distinct(), "id")
    links = links.union(materialize(rest_links(materialize(rest, "rest"), sets, settings), "links"))
    roots = components(links)

    # classes to their components, rows to their classes; a digest of very many rows is looked up by broadcast
    found = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "n", F.coalesce("root", "rep").alias("component_id"))
    found = materialize(found, "found")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(settings.spread, total // 1000)
    large = F.broadcast(found.filter(F.col("n") > limit).select("digest", "component_id"))
    rows = sketched.select("id", "n_shingles", "digest")
    near = rows.join(large, "digest")
    far = rows.filter("digest IS NOT NULL").join(large, "digest", "left_anti").join(found.select("digest", "component_id"), "digest", "left")
    none = rows.filter("digest IS NULL").withColumn("component_id", F.col("id"))
    every = near.unionByName(far).unionByName(none)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return every.select(
        F.col("id").cast(kind).alias(key), "n_shingles", component.cast(kind).alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
