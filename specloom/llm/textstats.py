"""Statistics of texts as numbers, many texts at once: characters, words, lines, repetition.

Everything is counted over the bytes of whole texts with array operations. A text is worked through in
pieces of PIECE bytes that end with a line, or else a word, or else a character; a line or word that is
longer than a piece counts as several. Counts add up over pieces, repeated words and lines are found over
the whole text by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of a piece, and of the pieces that are counted at once.
PIECE = 1_000_000

# Kinds of bytes.
SPACE, LINE, SMALL, CAPITAL, DIGIT, STOP, MARK, COMMA, SYMBOL, OTHER, LEAD, REST = range(12)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
KIND[0x0A] = LINE
KIND[ord("a") : ord("z") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("0") : ord("9") + 1] = SMALL, CAPITAL, DIGIT
KIND[[ord(c) for c in ".?"]], KIND[ord("!")], KIND[[ord(c) for c in ",;:"]] = STOP, MARK, COMMA
KIND[[ord(c) for c in "#*$%&|<>@^~_=+\\/{}[]"]] = SYMBOL
KIND[0x80:0xC0], KIND[0xC0:] = REST, LEAD

_rng = np.random.default_rng(11)
_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 2**64))

NAMES = (
    "log_chars", "log_words", "log_lines",
    "capitals", "digits", "stops", "marks", "commas", "symbols", "others", "foreign", "spaces",
    "word_mean", "word_spread", "word_long", "short_words", "long_words",
    "capital_words", "title_words", "symbol_words", "plain_words", "stop_words", "mark_words", "comma_words",
    "distinct_words", "top_word", "doubled_words", "distinct_pairs",
    "line_words", "short_lines", "stopped_lines", "distinct_lines",
)

# Sums over pieces: 12 kinds of characters, then these.
_WORDS, _LENGTH, _SQUARE, _SHORT, _LONG, _CAPITAL, _TITLE, _SYMBOL, _PLAIN, _STOP, _MARK, _COMMA, _LINES, _SHORT_LINES, _STOPPED = range(12, 27)


def pieces_of(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        cut = text.rfind(b"\n", at, end) + 1 or text.rfind(b" ", at, end) + 1
        if not cut:
            cut = end
            while cut > at + 1 and 0x80 <= text[cut] < 0xC0:
                cut -= 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, f)])) for f in (_FACTOR, _INVERSE))


def _before(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def _measure(pieces: list[tuple[int, bytes]], n: int):
    """Sums of each of n texts, (text, hash) of words, (text, hash) of lines, from pieces in order."""
    data = np.frombuffer(b"".join(p + b"\n" for _, p in pieces), np.uint8)
    kind = KIND[data]
    ends = np.cumsum([len(p) + 1 for _, p in pieces])
    owner = np.array([o for o, _ in pieces])
    out = np.zeros((n, 27))
    inside = {}
    for k in range(12):
        inside[k] = _before(kind == k)
        np.add.at(out[:, k], owner, np.diff(inside[k][np.concatenate([[0], ends])]))
    np.add.at(out[:, LINE], owner, -1)  # the line end that each piece got

    with np.errstate(over="ignore"):
        up, down = _powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[:-1])])

        def hashed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
            return (sums[last] - sums[first]) * down[first]

        blank = np.concatenate([[True], kind <= LINE])
        first = np.flatnonzero(blank[:-1] & ~blank[1:])
        last = np.flatnonzero(~blank[:-1] & blank[1:])
        word_of = owner[np.searchsorted(ends, first, "right")]
        words = hashed(first, last)
        edges = np.flatnonzero(kind == LINE)
        starts = np.concatenate([[0], edges[:-1] + 1])
        held = np.searchsorted(first, edges) - np.searchsorted(first, starts)  # words of each line
        some = held > 0
        starts, edges, held = starts[some], edges[some], held[some]
        line_of = owner[np.searchsorted(ends, starts, "right")]
        lines = hashed(starts, edges)

    count = lambda k: inside[k][last] - inside[k][first]
    length = last - first - count(REST)
    capital, letters = count(CAPITAL), count(CAPITAL) + count(SMALL) + count(LEAD)
    closing = kind[last - 1]
    facts = {
        _WORDS: np.ones(len(first)),
        _LENGTH: length,
        _SQUARE: length.astype(float) ** 2,
        _SHORT: length <= 2,
        _LONG: length >= 15,
        _CAPITAL: (capital > 1) & (capital + count(LEAD) == letters),
        _TITLE: (kind[first] == CAPITAL) & (capital == 1),
        _SYMBOL: count(SYMBOL) > 0,
        _PLAIN: letters == length,
        _STOP: closing == STOP,
        _MARK: closing == MARK,
        _COMMA: closing == COMMA,
    }
    for k, fact in facts.items():
        out[:, k] += np.bincount(word_of, fact, n)
    final = last[np.searchsorted(last, edges, "right") - 1] - 1  # the last character of a line that isn't blank
    for k, fact in ((_LINES, held > 0), (_SHORT_LINES, held <= 3), (_STOPPED, kind[final] == STOP)):
        out[:, k] += np.bincount(line_of, fact, n)
    return out, word_of, words, line_of, lines


def _runs(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many different hashes, and how often its most frequent one."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])) if len(o) else np.zeros(0, int)
    top = np.zeros(n)
    np.maximum.at(top, o[new], np.diff(np.concatenate([new, [len(o)]])))
    return np.bincount(o[new], minlength=n).astype(float), top


def statistics(texts: Iterable[bytes]) -> np.ndarray:
    """A row of NAMES per text, finite numbers; all 0 for a text without characters."""
    texts = list(texts)
    n = len(texts)
    sums, found, group, size = np.zeros((n, 27)), [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces_of(text):
            group.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                part, *rest = _measure(group, n)
                sums += part
                found.append(rest)
                group, size = [], 0
    if group:
        part, *rest = _measure(group, n)
        sums += part
        found.append(rest)
    word_of, words, line_of, lines = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    distinct, top = _runs(word_of, words, n)
    distinct_lines, _ = _runs(line_of, lines, n)
    same = word_of[1:] == word_of[:-1]
    with np.errstate(over="ignore"):
        pairs = words[:-1] * _FACTOR + words[1:] if n and len(words) else words
    doubled = np.bincount(word_of[1:][same], (words[1:] == words[:-1])[same], n) if len(words) else np.zeros(n)
    distinct_pairs, _ = _runs(word_of[1:][same], pairs[same], n) if len(words) else (np.zeros(n), None)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    characters = sums[:, :12].sum(1) - sums[:, REST]
    of_words, of_lines = sums[:, _WORDS], sums[:, _LINES]
    mean = share(sums[:, _LENGTH], of_words)
    spread = np.sqrt(np.maximum(share(sums[:, _SQUARE], of_words) - mean**2, 0))
    spaces = sums[:, SPACE] + sums[:, LINE]
    columns = [
        np.log1p(characters), np.log1p(of_words), np.log1p(of_lines),
        share(sums[:, CAPITAL], sums[:, CAPITAL] + sums[:, SMALL]),
        *(share(sums[:, k], characters) for k in (DIGIT, STOP, MARK, COMMA, SYMBOL, OTHER, LEAD)), share(spaces, characters),
        mean, spread, spread / np.maximum(mean, 1),
        *(share(sums[:, k], of_words) for k in (_SHORT, _LONG, _CAPITAL, _TITLE, _SYMBOL, _PLAIN, _STOP, _MARK, _COMMA)),
        share(distinct, of_words), share(top, of_words), share(doubled, of_words), share(distinct_pairs, of_words - 1),
        share(of_words, of_lines), share(sums[:, _SHORT_LINES], of_lines), share(sums[:, _STOPPED], of_lines), share(distinct_lines, of_lines),
    ]
    return np.stack(columns, axis=1)
