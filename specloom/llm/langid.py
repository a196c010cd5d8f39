"""Language of texts by a linear-chain conditional random field over their words.

Each word has a hidden label, its language. Features of a word: its prefixes and suffixes up to four
letters, its letter pairs and triples, the word itself (all hashed), and whether it stands in the
lexicon of a language (frequent words of the training texts of that language). The weights of features
and of transitions between labels are learned together by the gradient of the conditional likelihood
from forward-backward; training sequences are put together from texts of several languages, so that
the transitions are those of code-switched text. A text's language is the label with the largest mean
posterior over its words, and that mean is its score.

Training takes a bounded sample of labelled texts to the driver; prediction runs over every whole text,
inside the tasks. There forward-backward is a scan: the words of a text are cut into chunks, each
chunk's transition matrices are multiplied for all chunks of a batch at once, messages pass from chunk
to chunk, and the words' posteriors follow for all chunks at once. So one text of millions of words
takes as many vectorised steps as many short ones, and the result is that of the plain recursion.

A model knows so many languages at most (LANGUAGES); with more of them models stand in a row. Each learns
the most frequent languages that no earlier one has, and all further ones as a single label; texts that
get this label go on to the next model. So every language is learned, and what the driver, a broadcast
or the matrices hold is bounded whatever their number.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.llm.bpe import small_batches
from specloom.llm.common import ship
from specloom.operators.skew import with_positions
from specloom.workspace import materialize

#: Bounds of the training sample of a model: texts of each language, characters of each text (from a place
#: that its hash says), texts of all languages together (one of each language at least).
TEXTS, CHARACTERS, TOTAL = 150, 2_000, 7_500
#: Languages of one model, and texts that stand for the languages of later models.
LANGUAGES, FURTHER_TEXTS = 150, 600
#: Buckets of the hashed features, words of a lexicon, words of a training sequence and of its runs.
FEATURES, LEXICON, SEQUENCE, RUN = 1 << 15, 1_000, 64, 16
PASSES, BATCH, RATE, DECAY = 4, 64, 0.3, 1e-6
#: Words of a chunk, and words of which a worker keeps the scores.
CHUNK, WORDS_KEPT = 32, 800_000
#: Characters of a batch (fewer from 50 languages on), and numbers in the matrices of its chunks; for a
#: text that needs more, chunks are longer.
CHARACTERS_AT_ONCE, NUMBERS = 1_000_000, 40_000_000
UNKNOWN = "und"
#: Label of the languages that a later model knows; no language can have it as its name.
FURTHER = "\x00further"

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; signs like a raised 2 stand in a run, but don't make one."""
    found = LETTERS.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str) -> list[int]:
    """Hashed affixes and n-grams of a word, of all its letters."""
    from xxhash import xxh32_intdigest

    marked = f"^{word}$"
    names = {f"w{word}"}
    for n in (1, 2, 3, 4):
        names.update((f"p{word[:n]}", f"s{word[-n:]}"))
    for n in (2, 3):
        names.update(f"g{marked[i:i + n]}" for i in range(len(marked) - n + 1))
    return [xxh32_intdigest(x) % FEATURES for x in names]


@dataclass
class Model:
    """Learned weights. emit: (features, labels); lexicon: word -> labels that list it; listed: labels
    of lexicons by labels of words; move: from label, to label; start: label."""

    labels: list[str]
    emit: np.ndarray
    lexicon: dict[str, list[int]]
    listed: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """A row per word, the score of each label."""
        hashed = [features(w) for w in words]
        sizes = np.array([len(h) for h in hashed])
        flat = np.fromiter((i for h in hashed for i in h), np.int64, sizes.sum())
        out = np.add.reduceat(self.emit[flat], np.cumsum(sizes) - sizes, axis=0) if words else np.zeros((0, len(self.labels)))
        for i, w in enumerate(words):
            for label in self.lexicon.get(w, ()):
                out[i] += self.listed[label]
        return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def posteriors(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of labels (sequences, words, labels) and of neighbouring labels, summed over all.

    All sequences have one length; start, move and emit are factors above 0.
    """
    n, length, k = emit.shape
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    alpha[:, 0] = _normal(start * emit[:, 0])
    for t in range(1, length):
        alpha[:, t] = _normal(alpha[:, t - 1] @ move * emit[:, t])
    pairs = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        after = emit[:, t + 1] * beta[:, t + 1]
        beta[:, t] = _normal(after @ move.T)
        joint = alpha[:, t, :, None] * move * after[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return _normal(alpha * beta), pairs


def train(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language) pairs; without any word, one that knows no language."""
    texts = sorted((t, y) for t, y in texts if t and y is not None)
    labels = sorted({y for t, y in texts if words_of(t)})
    k = len(labels)
    number = {y: i for i, y in enumerate(labels)}
    counts: list[dict[str, int]] = [{} for _ in labels]
    tagged: list[list[tuple[str, int]]] = [[] for _ in labels]
    for t, y in texts:
        for w in words_of(t):
            i = number[y]
            counts[i][w] = counts[i].get(w, 0) + 1
            tagged[i].append((w, i))
    lexicon: dict[str, list[int]] = {}
    for i, c in enumerate(counts):
        for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON]:
            lexicon.setdefault(w, []).append(i)
    model = Model(labels, np.zeros((FEATURES, k)), lexicon, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    if not k:
        return model

    # runs of each language, shuffled and put together to sequences of one length
    rng = np.random.default_rng(seed)
    runs = []
    for words in tagged:
        at = 0
        while at < len(words):
            size = int(rng.integers(RUN // 4, 4 * RUN))
            runs.append(words[at : at + size])
            at += size
    flat = [x for i in rng.permutation(len(runs)) for x in runs[i]]
    flat += flat[: -len(flat) % SEQUENCE] if len(flat) >= SEQUENCE else flat * (SEQUENCE // len(flat) + 1)
    flat = flat[: len(flat) // SEQUENCE * SEQUENCE]
    vocabulary = {w: i for i, w in enumerate(sorted({w for w, _ in flat}))}
    of_word = [features(w) for w in vocabulary]
    words = np.array([vocabulary[w] for w, _ in flat]).reshape(-1, SEQUENCE)
    truth = np.array([y for _, y in flat]).reshape(-1, SEQUENCE)
    listed = np.zeros((len(vocabulary), k))
    for w, i in vocabulary.items():
        listed[i, lexicon.get(w, [])] = 1
    squares = {n: np.full_like(getattr(model, n), 1e-8) for n in ("emit", "listed", "move", "start")}

    def update(name: str, gradient: np.ndarray, at=slice(None)) -> None:
        weights = getattr(model, name)
        gradient = gradient - DECAY * weights[at]
        squares[name][at] += gradient**2
        weights[at] += RATE * gradient / np.sqrt(squares[name][at])

    for _ in range(PASSES):
        order = rng.permutation(len(words))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            w, y = words[rows], truth[rows]
            used, back = np.unique(w, return_inverse=True)
            ids = np.concatenate([of_word[u] for u in used])
            owner = np.repeat(np.arange(len(used)), [len(of_word[u]) for u in used])
            score = np.zeros((len(used), k))
            np.add.at(score, owner, model.emit[ids])
            score += listed[used] @ model.listed
            emit = score[back.reshape(w.shape)]
            emit = np.exp(emit - emit.max(-1, keepdims=True))
            seen, pairs = posteriors(np.exp(model.start), np.exp(model.move), emit)
            error = np.eye(k)[y] - seen
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, back.ravel(), error.reshape(-1, k))
            touched, place = np.unique(ids, return_inverse=True)
            gradient = np.zeros((len(touched), k))
            np.add.at(gradient, place, by_word[owner])
            update("emit", gradient / len(rows), touched)
            update("listed", listed[used].T @ by_word / len(rows))
            true_pairs = np.zeros((k, k))
            np.add.at(true_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            update("move", (true_pairs - pairs) / len(rows))
            update("start", error[:, 0].sum(0) / len(rows))
    return model


class Labeller:
    """Mean posteriors of texts under a model, many texts at once."""

    def __init__(self, model: Model):
        k = len(model.labels)
        self.model, self.k = model, k
        self.start = np.exp(model.start - model.start.max(initial=0))
        self.move = np.exp(model.move - model.move.max(initial=0))
        self.known: dict[str, int] = {}
        self.factors = np.ones((1024, k))

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """Places of the words' factors, all texts one after the other."""
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        new = list(set().union(*texts).difference(known))
        if new:
            score = self.model.scores(new)
            found = np.maximum(np.exp(score - score.max(1, keepdims=True)), 1e-30)
            if len(known) + len(new) > len(self.factors):
                more = np.ones((max(len(self.factors), len(new)), self.k))
                self.factors = np.concatenate([self.factors, more])
            self.factors[len(known) : len(known) + len(new)] = found
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        get = known.__getitem__
        return np.fromiter((i for t in texts for i in map(get, t)), np.int64)

    def means(self, texts: list[list[str]]) -> np.ndarray:
        """Mean posterior of each label over each text's words; a text has a word at least."""
        k, sizes = self.k, np.array([len(t) for t in texts])
        chunk = CHUNK * max(1, -(-int((-(-sizes // CHUNK)).sum()) * k * k // NUMBERS))
        chunks = -(-sizes // chunk)
        first = np.concatenate([[0], np.cumsum(chunks)])
        ids = self.numbers(texts)
        within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.repeat(first[:-1] * chunk, sizes) + within
        real = np.zeros(first[-1] * chunk, bool)
        real[place] = True
        emit = np.ones((len(real), k))
        emit[place] = self.factors[ids]
        emit, real = emit.reshape(-1, chunk, k), real.reshape(-1, chunk)
        n = len(emit)

        # products of a chunk's matrices; places behind a text's end change nothing
        whole = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        is_first = np.zeros(n, bool)
        is_first[first[:-1]] = True
        for t in range(chunk):
            use = np.flatnonzero(real[:, t])
            step = whole[use] @ self.move
            if t == 0:
                begin = is_first[use]
                step[begin] = np.broadcast_to(np.eye(k), (int(begin.sum()), k, k))
            step *= emit[use, t][:, None, :]
            whole[use] = step / step.sum((1, 2), keepdims=True)

        # messages from chunk to chunk, all texts side by side
        before, after = np.tile(_normal(self.start), (n, 1)), np.full((n, k), 1 / k)
        order = np.argsort(-chunks, kind="stable")
        for c in range(1, int(chunks.max(initial=0))):
            at = first[:-1][order[: np.searchsorted(-chunks[order], -c)]] + c
            before[at] = _normal(np.einsum("ni,nij->nj", before[at - 1], whole[at - 1]))
        for c in range(int(chunks.max(initial=0)) - 2, -1, -1):
            at = first[:-1][order[: np.searchsorted(-chunks[order], -(c + 1))]] + c
            after[at] = _normal(np.einsum("nij,nj->ni", whole[at + 1], after[at + 1]))

        # words of all chunks
        alpha = np.empty_like(emit)
        state = before
        for t in range(chunk):
            step = state if t == 0 and is_first.all() else state @ self.move
            if t == 0:
                step = np.where(is_first[:, None], state, step)
            state = np.where(real[:, t, None], _normal(step * emit[:, t]), state)
            alpha[:, t] = state
        total = np.zeros((n, k))
        beta = after
        for t in range(chunk - 1, -1, -1):
            total += np.where(real[:, t, None], _normal(alpha[:, t] * beta), 0)
            back = (emit[:, t] * beta) @ self.move.T
            beta = np.where(real[:, t, None], _normal(back), beta)
        return np.add.reduceat(total, first[:-1], axis=0) / sizes[:, None] if n else np.zeros((0, k))


_labellers: dict[str, Labeller] = {}


def _windows(docs: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """(y, h, t) of the rows that have a language and a text: it, a hash, and a bounded piece of the text."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    hashed = known.select(F.col(lang).cast("string").alias("y"), F.col(text).alias("t"), F.xxhash64(F.col(key)).alias("h"), F.length(text).alias("n"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.col("n") - CHARACTERS, F.lit(0)) + 1).cast("int") + 1
    return hashed.select("y", "h", F.substring("t", start, F.lit(CHARACTERS)).alias("t"))


def languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(y, level): every language of a row with a text, and the number of the model that learns it."""
    counts = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).cast("string").alias("y")).count()
    ordered = with_positions(materialize(counts, "languages"), [], [F.desc("count"), F.col("y")])
    return ordered.select("y", F.floor((F.col("pos") - 1) / LANGUAGES).cast("int").alias("level"))


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", known: DataFrame | None = None, level: int = 0) -> list[tuple[str, str]]:
    """The bounded training sample of a model: of each of its languages, texts with the smallest hash.

    ``known``: the languages by level, made here if not given. Texts of later levels are FURTHER.
    """
    known = languages(docs, text, lang) if known is None else known
    mine = [r["y"] for r in known.filter(F.col("level") == level).select("y").collect()]  # LANGUAGES at most
    windows = _windows(docs, text, lang, key)
    each = max(1, min(TEXTS, TOTAL // max(1, len(mine))))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))
    chosen = windows.filter(F.col("y").isin(mine)).withColumn("rank", rank).filter(F.col("rank") <= each)
    texts = [(r["t"], r["y"]) for r in chosen.select("t", "y").collect()]
    later = known.filter(F.col("level") > level)
    if not later.isEmpty():
        further = windows.join(later.select("y"), "y", "left_semi").orderBy("h", "t").limit(FURTHER_TEXTS)
        texts += [(r["t"], FURTHER) for r in further.select("t").collect()]
    return texts


def identify(docs: DataFrame, learned: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """``predict`` with all languages of the rows of ``learned``, by as many models as they need.

    With LANGUAGES languages or fewer that is one model. Else a text's score is the product of its means:
    for FURTHER under the earlier models, for its language under the one that knows it.
    """
    known = materialize(languages(learned, text, lang), "languages")
    last = known.agg(F.max("level")).first()[0] or 0
    rest, done, given = docs.drop("lang_pred", "score"), [], "_given"
    while given in rest.columns:
        given += "_"
    rest = rest.withColumn(given, F.lit(1.0))
    for level in range(last + 1):
        found = predict(rest, train(sample(learned, text, lang, key, known, level)), text)
        found = found.withColumn("score", F.col("score") * F.col(given))
        if level == last:
            done.append(found)
            break
        found = materialize(found, "level")
        done.append(found.filter(F.col("lang_pred") != FURTHER))
        rest = found.filter(F.col("lang_pred") == FURTHER).withColumn(given, F.col("score")).drop("lang_pred", "score")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop(given)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, lang_pred and score; of the text alone.

    A text that is null or has no letter, and every text under a model that knows no language, is
    ``und`` with a score of 0. Ties go to the first language in order of name. Rows are judged one by
    one; columns of these names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "score")
    held, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        if name not in _labellers:  # a worker keeps the last model and the words it has met
            _labellers.clear()
            _labellers[name] = Labeller(held.value)
        labeller = _labellers[name]
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        split = [words_of(t) if t else [] for t in texts]
        some = [i for i, w in enumerate(split) if w]
        if some and labeller.k:
            means = labeller.means([split[i] for i in some])
            for i, j in zip(some, means.argmax(1).tolist(), strict=True):
                languages[i] = labeller.model.labels[j]
            for i, s in zip(some, means.max(1).tolist(), strict=True):
                scores[i] = min(max(s, 0.0), 1.0)
        return languages, scores

    def run(batches):
        for whole in batches:
            for batch in small_batches([whole], text, int(CHARACTERS_AT_ONCE * min(1, (50 / max(held.value.emit.shape[1], 1)) ** 2))):
                languages, scores = judge(batch[text].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
                )

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
