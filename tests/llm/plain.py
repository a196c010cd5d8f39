"""The contracts in plain Python, for the tests."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def secrets(text):
    """Spans of the base kinds: (start, rank, kind, end)."""
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)
