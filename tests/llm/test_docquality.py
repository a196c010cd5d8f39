"""Statistics, trees and quality scores against plain Python and held-out documents."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import boosting, docquality, queries, textstats
from specloom.workspace import materialize

SYMBOLS = "#*$%&|<>@^~_=+\\/{}[]"


def plain(text):
    """The statistics of a text of one piece."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, w, ln = len(text), max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    count = lambda p, t=text: len(re.findall(p, t))
    capital, small, foreign = count("[A-Z]"), count("[a-z]"), count(r"[^\x00-\x7F]")
    symbols = sum(text.count(c) for c in SYMBOLS)
    known = capital + small + foreign + symbols + count(r"[0-9.?!,;: \t\n\x0b\x0c\r]")
    lengths = [len(x) for x in words]
    mean = sum(lengths) / w
    spread = math.sqrt(max(sum(x * x for x in lengths) / w - mean**2, 0))
    letters = lambda x: count("[A-Za-z]|[^\x00-\x7f]", x)
    pairs = list(zip(words, words[1:], strict=False))
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)),
        capital / max(capital + small, 1),
        count("[0-9]") / chars, count("[.?]") / chars, text.count("!") / chars, count("[,;:]") / chars,
        symbols / chars, (n - known) / chars, foreign / chars, count(r"[\x20\x09-\x0D]") / chars,
        mean, spread, spread / max(mean, 1),
        sum(x <= 2 for x in lengths) / w, sum(x >= 15 for x in lengths) / w,
        sum(count("[A-Z]", x) > 1 and not count("[a-z]", x) for x in words) / w,
        sum(count("[A-Z]", x) == 1 and x[0].isascii() and x[0].isupper() for x in words) / w,
        sum(any(c in SYMBOLS for c in x) for x in words) / w,
        sum(letters(x) == len(x) for x in words) / w,
        sum(x[-1] in ".?" for x in words) / w, sum(x[-1] == "!" for x in words) / w, sum(x[-1] in ",;:" for x in words) / w,
        len(set(words)) / w, max(Counter(words).values(), default=0) / w,
        sum(a == b for a, b in pairs) / w, len(set(pairs)) / max(len(words) - 1, 1),
        len(words) / ln, sum(len(x.split()) <= 3 for x in lines) / ln,
        sum(re.sub(r"[\x20\x09-\x0D]+$", "", x)[-1] in ".?" for x in lines) / ln, len(set(lines)) / ln,
    ]


def texts():
    rng = random.Random(8)
    some = ["the", "THE", "The", "é", "Été", "漢字", "ß!", "a.", "b?", "c,", "#x", "||", "12", "'q'", "ÀB", "x" * 15, "\n", "\n\n", " \n", "\t", "\x00", "\x7f", "\U0001f600"]
    made = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    return [*made, "", " ", "\n\n", "x", "one two one two\none two one two\n", "a " * 3000, "line.\n" * 500]


def test_statistics_are_those_of_plain_python():
    given = texts()
    got = textstats.statistics(t.encode() for t in given)
    assert got.shape == (len(given), len(textstats.NAMES))
    for t, row in zip(given, got, strict=True):
        assert row == pytest.approx(plain(t), abs=1e-9), t
    assert not textstats.statistics([b""]).any() and textstats.statistics([]).shape == (0, len(textstats.NAMES))


def test_pieces_of_a_text_change_nothing_at_line_ends(monkeypatch):
    lines = [f"Word{i % 9} two, three{i % 4}. été" for i in range(300)]
    text = "\n".join(lines)
    want = textstats.statistics([text.encode()])
    monkeypatch.setattr(textstats, "PIECE", 200)
    assert len(list(textstats.pieces_of(text.encode()))) > 20
    assert textstats.statistics([text.encode()]) == pytest.approx(want)
    # without a line end or blank: cut between characters, nothing is lost
    run = "é" * 1000
    assert b"".join(textstats.pieces_of(run.encode())) == run.encode()
    assert all(p.decode() for p in textstats.pieces_of(run.encode()))
    assert textstats.statistics([run.encode()])[0][0] == pytest.approx(math.log1p(1000))


def walk(forest, row):
    """The score of one row, tree by tree and node by node."""
    inner, total = 2**forest.depth - 1, forest.prior
    for t in range(forest.trees):
        node = 0
        while node < inner:
            at = t * inner + node
            node = 2 * node + 1 + (row[forest.feature[at]] > forest.threshold[at])
        total += forest.value[t * (inner + 1) + node - inner]
    return 1 / (1 + math.exp(-total))


def test_forest_learns_and_is_walked_alike():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 5))
    y = (x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 1)
    settings = boosting.Settings(trees=60, depth=4)
    forest = boosting.fit(x[:2000], y[:2000], np.ones(2000), settings)
    assert forest.scores(x[:50]) == pytest.approx([walk(forest, r) for r in x[:50]])
    assert ((forest.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    again = boosting.fit(x[:2000], y[:2000], np.ones(2000), settings)
    assert (again.value == forest.value).all() and (again.threshold == forest.threshold).all()


def test_best_split_is_that_of_all_splits():
    rng = np.random.default_rng(10)
    x, y, w = rng.integers(0, 6, (80, 3)).astype(float), rng.random(80) < 0.4, rng.random(80) + 0.5
    s = boosting.Settings(trees=1, depth=1, bins=32, least_weight=0.0)
    forest = boosting.fit(x, y, w, s)
    p = 1 / (1 + math.exp(-forest.prior))
    g, h = w * (p - y), w * p * (1 - p)

    def gain(f, cut):
        right = x[:, f] > cut
        return sum(g[m].sum() ** 2 / (h[m].sum() + s.penalty) for m in (right, ~right))

    best = max(gain(f, c) for f in range(3) for c in range(5))
    assert gain(forest.feature[0], forest.threshold[0]) == pytest.approx(best)


def test_no_label_one_class_and_odd_rows(spark):
    rows = [(1, "good text here", 0.5), (1, "good text here", 0.5), (None, None, 1.0), (2, "", 2.0), (3, "x" * 3_000_000, 3.0), (4, "$$ || !!", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    schema = "doc_id bigint, quality int"
    for labels, low, high in (([], 0.5, 0.5), ([(1, 1), (1, 1), (None, 0), (2, None), (9, 1), (3, 7)], 0.5, 1.0), ([(1, 1), (1, 0), (4, 0)], 0.0, 1.0)):
        forest = docquality.train(docs, spark.createDataFrame(labels, schema))
        got = docquality.score(docs, forest)
        assert got.columns == ["doc_id", "text", "score", "predicted"]
        found = got.collect()
        assert len(found) == 6 and all(low <= r["score"] <= high and r["predicted"] == (r["score"] >= 0.3) for r in found)
    empty = docs.filter("false")
    assert docquality.score(empty, docquality.train(empty, spark.createDataFrame([], schema))).collect() == []


def test_sample_is_bounded_and_weighed(spark):
    rows = [(i, "word " * (i % 50 + 1)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(400)], "doc_id bigint, quality int")
    forest = docquality.train(docs, labels, sample=30)
    assert forest.prior == pytest.approx(math.log((60 * 0.9 + 1) / (60 * 0.1 + 1)))


@pytest.mark.parametrize(("folder", "lost", "kept"), [("sf0.01", 0.02, 0.3), ("sf0.1", 0.01, 0.02)])
def test_held_out_documents(spark, folder, lost, kept):
    """Shares of held-out documents that are wrong, good ones and bad ones; 320 and 3,155 are learned from."""
    folder = f"/root/testdata/{folder}"
    got = materialize(queries.op11_quality_score(spark, folder), "scores")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.filter(F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).isEmpty()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows) and len(rows) > 50
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(1 - r["predicted"] for r in good) <= lost * len(good) and sum(r["predicted"] for r in bad) <= kept * len(bad)
    higher = sum((g["score"] > b["score"]) + 0.5 * (g["score"] == b["score"]) for g in good for b in bad)
    assert higher / (len(good) * len(bad)) > 0.98
