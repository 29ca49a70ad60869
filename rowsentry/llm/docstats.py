"""Rule statistics of whole documents, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import kernels as K

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: Exact counts of a text, as ``counts`` returns them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_bangs", "n_pipes", "n_marks", "n_distinct", "n_same_next")


def counts(chunk: K.Chunk) -> np.ndarray:
    """A row of COUNTS for each text.

    n_dup_lines: lines with a word that equal an earlier line. n_repeat_words: words in windows of
    five words that occur twice or more in the text, the first occurrence included. n_lines: lines
    with a word. n_same_next: words equal to the next one.
    """
    raw, out = chunk.raw, np.zeros((chunk.n, len(COUNTS)), np.int64)
    start, end, first = chunk.words()
    word = chunk.hashes(start, end)
    out[:, 0] = np.diff(first)
    lead = (raw & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    in_words = np.concatenate([[0], np.cumsum(upto[end] - upto[start])])
    out[:, 1] = in_words[first[1:]] - in_words[first[:-1]]
    out[:, 2] = chunk.sums(_IS_SYMBOL[raw])
    out[:, 5] = upto[chunk.row[1:]] - upto[chunk.row[:-1]]
    out[:, 7] = chunk.sums((raw >= 65) & (raw <= 90))
    out[:, 8] = chunk.sums((raw >= 48) & (raw <= 57))
    out[:, 9] = chunk.sums(raw == 33)
    out[:, 10] = chunk.sums(raw == 124)
    out[:, 11] = chunk.sums((raw == 44) | (raw == 46))
    ls, le, lf = chunk.lines()
    has = np.searchsorted(start, le) > np.searchsorted(start, ls)
    line = chunk.hashes(ls, le)
    n = word.size - K.SHINGLE + 1
    window = np.zeros(0, K.U)
    if n > 0:
        window = word[:n] * K._SLOT[0]
        for k in range(1, K.SHINGLE):
            window += word[k : k + n] * K._SLOT[k]
    for i in range(chunk.n):
        a, b = first[i], first[i + 1]
        own = line[lf[i] : lf[i + 1]][has[lf[i] : lf[i + 1]]]
        out[i, 6] = own.size
        if own.size > 1:
            out[i, 3] = own.size - np.unique(own).size
        out[i, 12] = np.unique(word[a:b]).size
        out[i, 13] = (word[a : b - 1] == word[a + 1 : b]).sum() if b - a > 1 else 0
        if b - a > K.SHINGLE:
            w = window[a : b - K.SHINGLE + 1]
            order = np.argsort(w)
            equal = w[order[1:]] == w[order[:-1]]
            if equal.any():
                twice = np.zeros(w.size, bool)
                twice[order[1:][equal]] = True
                twice[order[:-1][equal]] = True
                cover = np.zeros(b - a + 1, np.int64)
                at = np.flatnonzero(twice)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + K.SHINGLE, -1)
                out[i, 4] = (np.cumsum(cover)[:-1] > 0).sum()
    return out


#: Scale-free statistics that ``rates`` derives from the counts, each from 0 to about 1.
RATES = ("length", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "bangs", "pipes", "marks", "variety", "stutter")


def rates(c: np.ndarray) -> np.ndarray:
    """Statistics of texts that don't depend on their length, the first apart."""
    c = c.astype(np.float64)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 5], 1), np.maximum(c[:, 6], 1)
    share = lambda x, of: np.sqrt(np.minimum(x / of, 1))  # noqa: E731  spreads small shares
    out = [
        np.minimum(np.log1p(c[:, 0]) / 12, 1), np.minimum(c[:, 1] / words / 20, 1), share(c[:, 2], words), share(c[:, 3], lines), share(c[:, 4], words), share(c[:, 7], chars),
        share(c[:, 8], chars), share(c[:, 9], words), share(c[:, 10], words), share(c[:, 11], words), np.minimum(c[:, 12] / np.sqrt(2 * words) / 12, 1), share(c[:, 13], words),
    ]
    return np.stack(out, axis=1)


def batch_counts(column: pa.Array) -> np.ndarray:
    parts = [counts(chunk) for chunk in K.chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
