"""Structure statistics of whole texts, shared by the quality operators.

Words are `[^\\x20\\x09-\\x0D]+`; null texts have none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from keyloom.llm.text import SPACES, Words, windows, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_PUNCT &= ~_SYMBOL


@dataclass
class Stats:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_lines: np.ndarray
    n_upper: np.ndarray
    n_digit: np.ndarray
    n_punct: np.ndarray
    n_distinct: np.ndarray


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), off))


def repeat_words(h: np.ndarray, W: Words, k: int = 3) -> np.ndarray:
    """Of each text: words in k-word windows that it holds twice or more."""
    w, n = windows(h, W.count, k)
    doc = np.repeat(np.arange(W.n_docs), n)
    at = np.repeat(W.first[:-1] - (np.cumsum(n) - n), n) + np.arange(len(w))
    code, _ = pd.factorize(w ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    twice = at[np.bincount(code)[code] > 1] if len(code) else at
    inside = np.zeros(len(h), bool)
    for i in range(k):
        inside[twice + i] = True
    return _per_text(inside, W.first)


def structure(col: pa.Array) -> tuple[Stats, Words, np.ndarray]:
    """The statistics, the words and their hashes."""
    W = words(col)
    h = W.hashes()
    chars = np.concatenate(([0], np.cumsum((W.data & 0xC0) != 0x80, dtype=np.int64)))
    n_chars = np.zeros(W.n_docs, np.int64)
    each = chars[W.end] - chars[W.start]
    full = np.flatnonzero(W.count)
    if len(full):
        n_chars[full] = np.add.reduceat(each, W.first[:-1][full])
    raw, off = W.data.tobytes(), W.off.tolist()
    dup, n_lines = np.zeros(W.n_docs, np.int64), np.zeros(W.n_docs, np.int64)
    for d, (a, b) in enumerate(zip(off, off[1:])):
        ls = [x for x in raw[a:b].split(b"\n") if x.strip(SPACES)]
        n_lines[d], dup[d] = len(ls), len(ls) - len(set(ls))
    code, _ = pd.factorize(h ^ (W.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    first = np.ones(len(code), bool)
    if len(code):
        seen = np.full(int(code.max()) + 1, -1)
        seen[code[::-1]] = np.arange(len(code))[::-1]
        first = seen[code] == np.arange(len(code))
    s = Stats(W.count, n_chars, _per_text(_SYMBOL[W.data], W.off), dup, repeat_words(h, W), n_lines, _per_text(_UPPER[W.data], W.off), _per_text(_DIGIT[W.data], W.off), _per_text(_PUNCT[W.data], W.off), _per_text(first, W.first))
    return s, W, h


VECTOR = ["log_words", "word_length", "symbols", "upper", "punct", "dup_lines", "repeats", "distinct"]


def vector(s: Stats) -> np.ndarray:
    """(texts, len(VECTOR)): transformed so that counts of any length compare."""
    n = np.maximum(s.n_words, 1).astype(float)
    return np.stack(
        [
            np.log1p(s.n_words), np.log1p(s.word_chars / n), np.sqrt(s.n_symbols / n), np.sqrt(s.n_upper / np.maximum(s.word_chars, 1)), np.sqrt(s.n_punct / n),
            s.n_dup_lines / np.maximum(s.n_lines, 1), s.n_repeat_words / n, np.log(np.maximum(s.n_distinct, 1)) - 0.8 * np.log(n),
        ],
        1,
    )
