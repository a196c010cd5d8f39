"""Encoding, decoding, packing and token counts against the tokenizers library and plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specloom.llm import bpe, packing, tokencount
from specloom.llm.common import vocabulary

WORD, BYTE = vocabulary(packing.WORD_VOCABULARY), vocabulary(bpe.BYTE_VOCABULARY)
PIECES = [*" \n\t'’…!?.,;:|<>$%&*()-_=+/\\\"azAZsStmdrevl09éßñç 　日🎉́\x85\x1c", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'ll", " the", "İ", "Σ"]
ODD = [
    None, "", " ", "\n\n", "x's don't  we'll !'s …'s 'S ''s \n\n y\t\tz  é q  ", "a<|endoftext|>b  <|endoftext|> c '<|endoftext|>'s",
    "日本語 テスト　です。 '’s", "a b c", "1'2's 3.4%%% A|B|  |", "word, word. Word., same same", "long " * 20_000,
]


def plain(path, texts, special_as_text=False):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))) for _ in range(3000)]


def table(spark, rows, schema="doc_id bigint, text string, ids string, piece string, decoded string"):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], schema)


def test_encoding_and_decoding_are_the_librarys(spark):
    rows = list(enumerate(texts()))
    encoded = bpe.encode(table(spark, rows), BYTE)
    got = {r["doc_id"]: r for r in bpe.decode(encoded, BYTE).collect()}
    tokenizer = Tokenizer.from_file(BYTE)
    for (i, text), ids in zip(rows, plain(BYTE, [t for _, t in rows]), strict=True):
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids, repr(text)
        assert got[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i]["piece"] == "b"


def test_special_strings_as_text():
    text = "a<|endoftext|>b <|endoftext|>"
    got = np.frombuffer(bpe.encode_texts([text.encode()], BYTE, True)[0], "<u4").tolist()
    assert got == plain(BYTE, [text], True)[0]
    assert 50_256 not in got


def test_incomplete_bytes_decode_as_the_library_does():
    boundaries = bpe.ForcedBoundaries(BYTE)
    ids = plain(BYTE, ["日本🎉"])[0][:-1]
    assert boundaries.decode(np.array(ids, "<u4").tobytes()) == Tokenizer.from_file(BYTE).decode(ids, skip_special_tokens=False)


def test_a_full_memo_starts_anew():
    memo = bpe.Memo(BYTE, entries=2)
    first = memo.encode(["a", " b", " c", " d"])
    assert len(memo) == 4 and memo.encode(["a", " b", " c", " d"]) == first


def test_a_memo_keeps_what_is_met_again_and_no_long_fragments():
    memo = bpe.Memo(BYTE, entries=4)
    long = "long" * bpe.MEMO_BYTES
    wanted = memo.encode([" often", long])
    for i in range(50):
        memo.encode([" often", f" {i}", f" x{i}"])
        assert " often" in memo and len(memo) + len(memo.older) <= 2 * (4 + 3)
    assert memo.encode([" often", long]) == wanted and long not in memo


def test_plain_words_are_the_librarys():
    words = "größe größe, naïve.%%% ñandú### çà^` a's don't!! x'' ªb µm xé́ œuvre a<b>c 9a a9, --a ÿß$$$ ÉTÉ. a·b ÷a Straße:".split()
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.word_ids([w.encode() for w in words], WORD)]
    assert got == plain(WORD, words)
    memo = packing.WordMemo(WORD)
    memo.tokenizer = None  # letters go to the model alone
    assert memo.encode(["größe".encode()]) == np.array(got[0], "<u4").tobytes()


def test_pieces(spark):
    rows = list(enumerate(texts())) + [(5, "twice"), (5, "twice"), (None, "no id")]
    got = packing.token_pieces(table(spark, rows), WORD).collect()
    want = Counter()
    for (i, _), ids in zip(rows, plain(WORD, [t for _, t in rows]), strict=True):
        ids = [*ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, at, len(ids[at : at + 2048]), np.array(ids[at : at + 2048], "<u4").tobytes()] += 1
    assert Counter(tuple(r) for r in got) == want


def check_packing(rows, capacity):
    places = {}
    for sequence, offset, length in rows:
        places.setdefault(sequence, []).append((offset, length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def decreasing(lengths, capacity):
    """Bins of plain best-fit decreasing."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def fewest(lengths, capacity):
    """Fewest bins, by trying all ways."""
    best = len(lengths)

    def put(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= rest[0] and room not in rooms[:i]:
                put(rest[1:], [*rooms[:i], room - rest[0], *rooms[i + 1 :]])
        put(rest[1:], [*rooms, capacity - rest[0]])

    put(sorted(lengths, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
    made = packing._Plan(dict(Counter(lengths)), capacity)
    made.reduce()
    rest = [n for n, c in made.left.items() for _ in range(c)]
    assert made.bins + fewest(rest, capacity) == fewest(lengths, capacity)


@pytest.mark.parametrize("seed", range(6))
def test_no_more_sequences_than_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [min(100, max(1, int(rng.lognormvariate(3.4, 0.8)))) for _ in range(800)]
    made = packing.plan(dict(Counter(lengths)), 100)
    assert -(-sum(lengths) // 100) <= made.bins <= decreasing(lengths, 100)
    assert sum(hi - lo for _, lo, hi, *_ in made.rules) == len(lengths)


def test_packing_places_every_row(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    rng = random.Random(1)
    lengths = [7] * 400 + [rng.randint(1, 40) for _ in range(500)]
    rows = [(i // 2, n, "x", "y") for i, n in enumerate(lengths)]  # ids and whole rows repeat
    frame = spark.createDataFrame(rows, "doc_id bigint, length bigint, offset string, _rules string")
    got = packing.pack(frame, 40).collect()
    assert Counter((r["doc_id"], r["length"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert check_packing([(r["sequence_id"], r["offset"], r["length"]) for r in got], 40) <= decreasing(lengths, 40)


def test_packing_of_nothing_and_of_wrong_lengths(spark):
    empty = spark.createDataFrame([], "doc_id bigint, length bigint")
    assert packing.pack(empty, 10).collect() == []
    for wrong in (0, 11, None):
        with pytest.raises(Exception, match="must be from 1 to 10"):
            packing.pack(spark.createDataFrame([(1, wrong)], "doc_id bigint, length bigint"), 10).collect()


def test_sequences_hold_the_ids(spark):
    docs = table(spark, [(1, "some words"), (2, None), (3, "other words here")])
    packed = packing.pack(packing.token_pieces(docs, WORD))
    rows = packing.sequences(packed).collect()
    assert sum(r["length"] for r in rows) == sum(len(r["ids"]) // 4 for r in rows) == sum(map(len, plain(WORD, ["some words", "other words here"]))) + 3


@pytest.mark.parametrize("block", [500, 4096, 1 << 20])
def test_token_counts(spark, block):
    rows = list(enumerate(texts()[:300])) + [(5, "twice"), (5, "twice"), (None, "no id"), (-3, "minus"), (1 << 62, "large")]
    folder = tokencount.token_folder(spark)
    tokencount.write_token_files(table(spark, rows).repartition(3), folder, BYTE, 50_256)
    counts = tokencount.token_counts(spark, folder, 50_256, tokencount.HEADER_IDS, block_ids=block)
    got = counts.select(tokencount.number(F.col("header")).alias("doc_id"), "n_tokens", "closed").collect()
    want = Counter((i, len(ids)) for (i, _), ids in zip(rows, plain(BYTE, [t for _, t in rows], True), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert all(r["closed"] for r in got)


def test_the_prefix_scan_carries_no_documents(spark, tmp_path):
    """One file of many blocks: the window over its blocks reads numbers, and counts all the same."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50, 40_000)  # 0 ends a document
    (tmp_path / "one").write_bytes(ids.astype("<u2").tobytes())
    got = tokencount.token_counts(spark, str(tmp_path), 0, block_ids=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "Window" in line)
    scan = next(line for line in plan[at:] if "Relation" in line or "Project" in line)
    assert "documents" not in scan
    ends = [-1, *np.flatnonzero(ids == 0).tolist()]
    want = [(b - a - 1) for a, b in zip(ends, ends[1:], strict=False)] + ([len(ids) - 1 - ends[-1]] if ends[-1] < len(ids) - 1 else [])
    assert [r["n_tokens"] for r in got.orderBy("doc_index").collect()] == want


def test_token_counts_of_odd_files(spark, tmp_path):
    files = {"a": [9, 9, 1, 2, 9], "b": [1, 2, 3, 4, 5, 6, 7], "c": [], "d": [9], "e": [1, 9, 2]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    want = [("a", 0, 0, 0, True), ("a", 1, 1, 0, True), ("a", 2, 2, 2, True), ("b", 0, 0, 7, False), ("d", 0, 0, 0, True), ("e", 0, 0, 1, True), ("e", 1, 2, 1, False)]
    for block in (1, 2, 3, 100):
        got = tokencount.token_counts(spark, str(tmp_path), 9, block_ids=block).drop("header")
        assert sorted(tuple(r) for r in got.collect()) == want, block
    (tmp_path / "f").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        tokencount.token_counts(spark, str(tmp_path), 9).collect()
