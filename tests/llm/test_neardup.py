"""Near-duplicate groups against all pairs, on families where a star alone loses links."""

import random
from collections import Counter

import numpy as np
import pytest

from specloom.llm import neardup
from specloom.llm.neardup import Settings, near_duplicates

SCHEMA = "doc_id bigint, text string, id string, kept string, bands string"


def brute(rows, settings):
    """Component of each id, by comparing all pairs."""
    sets = []
    for i, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        n = settings.words
        shingles = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}
        sets.append((i, shingles))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= settings.percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), root(i), i == root(i)) for i, s in sets)


def check(spark, rows, settings):
    frame = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = Counter(tuple(r) for r in near_duplicates(frame, settings=settings).collect())
    assert got == brute(rows, settings)
    return got


def family(rng, size, length, edits):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(length)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"e{rng.randint(0, 10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("words", [4, 5])
def test_families(spark, words):
    rng = random.Random(words)
    texts = [t for size, length, edits in ((60, 90, 6), (30, 40, 3), (8, 12, 1), (5, 300, 20)) for t in family(rng, size, length, edits)]
    texts += ["Same Words here and there now", "same words HERE and there now", "same  words\there\nand there now"]
    texts += [None, "", "  \n ", "one", "One", "two words", "one two words", "É x y z a b", "é x y z a b"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    # small blocks and parts, so that every path is taken
    check(spark, rows, Settings(words=words, block=7, spread=5))


def test_chains_are_followed(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(60)]  # each like its neighbours only
    got = check(spark, rows, Settings(words=4))
    assert {r[2] for r in got} == {0}


def test_a_text_of_copies_and_odd_ids(spark):
    rows = [(i, "a text that is there very often indeed") for i in range(300, 0, -1)] + [(-5, "another text that stands alone here")]
    assert sum(r[3] for r in check(spark, rows, Settings(spread=10))) == 2
    repeated = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (None, None)]
    frame = spark.createDataFrame(repeated, "doc_id bigint, text string")
    got = Counter(tuple(r) for r in near_duplicates(frame).collect())
    assert got == Counter({(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 2, None, True): 1, (None, 0, None, True): 1})


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert near_duplicates(spark.createDataFrame([(1, None, "", "", "")], SCHEMA)).collect() == [(1, 0, 1, True)]


def test_a_key_must_be_a_whole_number(spark):
    with pytest.raises(TypeError):
        near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_bins_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    for size, similarity in ((400, 0.8), (20, 0.8), (5, 0.6)):
        same = []
        for _ in range(200):
            common = rng.integers(0, 2**63, round(size * similarity), dtype=np.uint64)
            rest = rng.integers(0, 2**63, (2, (size - len(common)) // 2), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, r])) for r in rest)
            x = neardup.signatures([a, b], 160)
            same.append((x[0] == x[1]).mean())
        assert abs(np.mean(same) - len(common) / (len(common) + 2 * len(rest[0]))) < 0.03


def test_components(spark):
    links = [(5, 6), (6, 7), (7, 1), (20, 21), (30, 30), (41, 40), (42, 41), (40, 42)]
    got = {r["id"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 5: 1, 6: 1, 7: 1, 20: 20, 21: 20, 40: 40, 41: 40, 42: 40}
    path = [(i, i + 1) for i in range(150)]
    got = {r["root"] for r in neardup.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {0}


def test_blocks_compare_large_sets_exactly():
    """Intersections beyond what 32 bits of floating point hold: a set short of the limit by one isn't linked."""
    n = 4_000_000
    one = np.arange(n, dtype=np.int64)
    for common, linked in ((n * 8 // 9 + 1, True), (-(-n * 8 // 9) - 1, False)):  # equal sizes: 0.8 is common = 8/9 n
        other = np.arange(n - common, 2 * n - common, dtype=np.int64)
        assert (100 * common >= 80 * (2 * n - common)) == linked
        assert neardup.block_links([1, 2], [1, 2], [one, other], 80) == ([(1, 2)] if linked else [])
