"""Weighted word shingles of whole texts, as 64-bit hashes (numpy; used inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, all output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets everything beyond ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of the words (separated by space, tab, LF, VT, FF, CR; A-Z in lower case)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _P)         # of each byte; white space counts nothing
_VALUE[_SPACE] = 0
_BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def flat_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of the texts (words as in :func:`word_hashes`, another hash function).

    The hash of a word is the sum of its bytes' values times powers of an odd base, from running sums over all bytes:
    no word becomes a Python object.
    """
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    n = len(data)
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(2 * n, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    upto = np.cumsum(_VALUE[data] * _powers[0][:n], dtype=np.uint64)
    before = np.where(start > 0, upto[start - 1], np.uint64(0))
    hashes = mixed((upto[end - 1] - before) * _powers[1][start])
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.searchsorted(first, start, side="right") - 1, hashes


def shingle_sets(texts: list[str | None], known: WordHashes, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, counts): the distinct shingles of text i are hashes[starts[i]:starts[i + 1]], ascending.

    A text of fewer than ``size`` words (but one at least) has one shingle: all its words.
    """
    hashes, counts, starts = [], [], [0]
    for text in texts:
        words = word_hashes(text, known)
        n = len(words)
        if n:
            with np.errstate(over="ignore"):
                k = min(size, n)
                h = words[:n - k + 1].copy()
                for j in range(1, k):
                    h = h * _P + words[j:n - k + 1 + j]
                h = mixed(h + np.uint64(k))
            h, c = np.unique(h, return_counts=True)
            hashes.append(h)
            counts.append(c)
        starts.append(starts[-1] + (len(hashes[-1]) if n else 0))
    empty = np.empty(0, np.uint64), np.empty(0, np.int64)
    return (np.array(starts), *((np.concatenate(hashes), np.concatenate(counts)) if hashes else empty))


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact J_P = sum over common d of 1 / sum over d' of max(wa(d') / wa(d), wb(d') / wb(d)).

    For a common element with ratio q = wb(d) / wa(d) the inner sum is (1 / wb(d)) * sum max(wa(d') q, wb(d')); sorted by ratio
    r = wb / wa, elements with r <= q count with wa and the others with wb, so prefix sums give all in n log n.
    """
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    xa, xb = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    q = xb / xa
    order = np.argsort(q, kind="stable")
    xa, xb, q = xa[order], xb[order], q[order]
    sum_a = np.concatenate([[0.0], np.cumsum(xa)])          # elements whose ratio is at most q count with wa * q
    rest_b = xb.sum() - np.concatenate([[0.0], np.cumsum(xb)])
    upto = np.searchsorted(q, q, side="right")
    inner = (only_a + sum_a[upto]) * q + only_b + rest_b[upto]
    return float((xb / inner).sum())
