"""Divergence of sources against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from specloom.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(divergence.UPPER, divergence.LOWER)


def plain(rows, least, ranks):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = WORD.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def prices(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = prices(whole), {s: prices(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(terms)[:ranks])]
    return sorted(out)


def corpus(seed, sources=9, n=150):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcéß漢ABZ") + rng.choice("xyñ") * rng.randint(1, 3) for _ in range(60)] + ["The", "the", "THE", "l'été", "\U0001d49c", "naïve"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "fr", None, "lone"])
        source = "only" if lang == "lone" else rng.choice([None, "hot", "hot", "hot", *(f"s{i}" for i in range(sources))])
        mine = vocabulary if source == "hot" else vocabulary[rng.randint(0, 20) :]
        words = [rng.choice(mine) for _ in range(rng.choice([0, 1, 5, 40]))]
        rows.append((rng.choice([" ", "\n", "1", "_", "\x00"]).join(words), lang, source))
    return rows + [(None, "en", "void"), ("", None, "void"), ("rare words here", "xx", "a"), ("more", "xx", "b"), ("12 34", "num", "a"), (None, "num", "b")]


@pytest.mark.parametrize(("words", "groups", "columns"), [(1024, 16, 1024), (7, 3, 5)])
def test_every_price(spark, monkeypatch, words, groups, columns):
    monkeypatch.setattr(divergence, "WORDS", words)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    rows = corpus(words)
    rows += rows[:40]  # repeated rows count each
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, rank int, term string").repartition(5)
    got = divergence.audit(frame)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, got.collect()))
    assert got == plain(rows, 10, 10)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[4] > 0 for r in got)


def test_groups_of_a_word_meet_in_one_shuffle(spark, capsys):
    frame = spark.createDataFrame(corpus(3), "text string, lang string, source string")
    divergence.counts(frame).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(lang" in plan
    assert plan.index("HashAggregate(") < plan.rindex("HashAggregate(") < plan.index("Exchange hashpartitioning(")


def test_words_in_pieces(monkeypatch):
    text = " ".join(f"Wör{i % 7}d{'x' * (i % 5)}" for i in range(500)).encode()
    want = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", text)]
    for size in (1, 10, 1000, 10**6):
        monkeypatch.setattr(divergence, "PIECE", size)
        assert [w for p in divergence.pieces_of(text) for w in p] == want


def test_odd_tables(spark):
    schema = "text string, lang string, source string"
    empty = spark.createDataFrame([], schema)
    assert divergence.audit(empty).collect() == []
    long = [("one two " * 200_000, "en", "a"), ("two three", "en", "b"), (None, None, None)]
    got = divergence.audit(spark.createDataFrame(long, schema), least=1)
    assert sorted(map(tuple, got.collect())) == plain(long, 1, 10)


def test_counts_beyond_64_bits(spark):
    frame = spark.createDataFrame([(10**15, 10**16, 10**6), (0, 0, 1)], "n bigint, total bigint, kept bigint")
    got = frame.select(divergence._price(frame["n"], frame["total"], frame["kept"]).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (10**15 + 2) // (10**16 + 2 * 10**6), 10**9 + 1]


def test_joint_tables_are_those_of_pairs():
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 9, (200, 4)), rng.integers(1, 6, (200, 3))
    seen = Counter()
    for ga, pa, gb, pb, table in divergence.joint_tables(a, b):
        for x, y in zip(*np.nonzero(table), strict=True):
            seen[ga[x], pa[x], gb[y], pb[y]] += table[x, y]
    want = Counter((i, a[t, i], j, b[t, j]) for t in range(200) for i in range(4) for j in range(3))
    assert seen == want
    direct = ((a[:, :, None] - b[:, None, :]) ** 2 // (a[:, :, None] + b[:, None, :])).sum(0)
    assert (divergence.tile_sums(a, b) == direct).all()
