"""Periodic runs of words, by suffix-tree LCE and Lyndon roots.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word
extends keeping period q, of at least ``least`` words and at least ``times`` periods.

1. A run repeats, at distance q, each of its stretches of ``gram`` words (:func:`gram_of`, 16 for 24 words and 3 periods).  So
   only the stretches of a document in which such word groups recur within a third of the stretch's length can hold
   a run; they are found by hashes, and a hash collision costs time, never a run.
2. For each of these stretches, Ukkonen suffix trees of its words and of their reversal are built.  Of a tree's Euler tour the
   turning points between neighbouring leaves are kept: the shallowest node between two leaves is their lowest
   common ancestor, and its depth their longest common extension (LCE), answered in constant time by a sparse table.
3. The longest Lyndon word at each position, under the order of the words and under its inverse, ends before the next
   smaller suffix.  Every run has such a word as its root.  Each root is extended to the right by the LCE of the tree and to
   the left by that of the reversal; the extension is the whole run.

A task holds a batch of texts and the trees of one stretch of one text at a time, so its memory grows with the longest
repetitive text.

Defined results: null counts as an empty text; a text without words has no run and collapses to an empty text; white space is
the six ASCII characters, and the collapsed text joins the words that stay by one space; rows that repeat an id are
documents of their own, a null id is passed on; an empty table gives an empty result; no extra column is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.llm.common import ship_package, text_of
from skewlens.llm.shingles import WordHashes

#: Words and periods of a run, at least.
LEAST, TIMES = 24, 3
#: Rows of an Arrow batch that are answered at once.
ROWS = 256

_P = np.uint64(0x9E3779B97F4A7C15)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def gram_of(least: int = LEAST, times: int = TIMES) -> int:
    """Words that every run repeats at the distance of its period: the least of max(least, times * q) - q over all q."""
    q = least // times
    return max(1, min(least - q if q else least, (times - 1) * -(-least // times)))


def stretches(hashes: np.ndarray, gram: int, times: int) -> list[tuple[int, int]]:
    """Disjoint (start, end) outside of which no run can lie, from the words' hashes."""
    n = len(hashes)
    if n < 2 or n < gram:
        return []
    h, width, done = hashes, 1, 0
    with np.errstate(over="ignore"):
        parts = []
        for bit in range(gram.bit_length()):            # doubling: the hash of 2w words from two of w words
            if gram >> bit & 1:
                parts.append((h, width, done))
                done += width
            if gram >> (bit + 1):
                power = np.uint64(pow(int(_P), width, 1 << 64))
                h, width = h[:-width] * power + h[width:], 2 * width
        m = n - gram + 1
        whole = np.zeros(m, np.uint64)
        for part, wide, at in parts:
            whole = whole * np.uint64(pow(int(_P), wide, 1 << 64)) + part[at:at + m]
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    if not same.any():
        return []
    near = np.full(m, n, np.int64)                      # distance of the nearest equal group of words
    gap = np.where(same, order[1:] - order[:-1], n)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    at = np.flatnonzero(near < n)
    while len(at):
        first = np.flatnonzero(np.diff(at, prepend=-gram - 1) > gram)
        start, end = at[first], np.append(at[first[1:] - 1], at[-1]) + gram
        size = np.repeat(end - start, np.diff(np.append(first, len(at))))
        stay = near[at] * times <= size
        if stay.all():
            return list(zip(start.tolist(), end.tolist()))
        at = at[stay]
    return []


def suffix_tree(s: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of s, whose last symbol occurs once: (children by node * width + first symbol, start, end of each edge)."""
    n = len(s)
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = open_ = 0
    for i, c in enumerate(s):
        last = 0
        open_ += 1
        while open_:
            if not length:
                edge = i
            key = node * width + s[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                along = end[to] - start[to]
                if length >= along:
                    edge += along
                    length -= along
                    node = to
                    continue
                first = start[to]
                if s[first + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(start)
                start += [first, i]
                end += [first + length, n]
                link += [0, 0]
                start[to] = first + length
                child[key] = middle
                child[middle * width + s[first + length]] = to
                child[middle * width + c] = middle + 1
                if last:
                    link[last] = middle
                last = middle
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - open_ + 1
    return child, start, end


class Tour:
    """The leaves of a suffix tree in their order, with the depth of the turning point between neighbours."""

    def __init__(self, tree: tuple[dict[int, int], list[int], list[int]], size: int, width: int, inverse: bool = False):
        child, start, end = tree
        keys, to = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        parent, symbol = keys // width, keys % width
        if inverse:                                     # the end of the text, symbol 0, stays the smallest
            symbol = np.where(symbol > 0, width - symbol, 0)
        order = np.lexsort((symbol, parent))
        to, parent = to[order][::-1], parent[order][::-1]                   # a stack hands out the smallest first
        upto = np.searchsorted(-parent, -np.arange(len(start)), side="right").tolist()
        since = np.searchsorted(-parent, -np.arange(len(start)), side="left").tolist()
        to, long = to.tolist(), (np.array(end) - np.array(start)).tolist()
        leaves, turns, depth, turn, stack = [], [], [0] * len(start), -1, to[since[0]:upto[0]]
        above = [0] * len(stack)
        while stack:
            node, up = stack.pop(), above.pop()
            if turn < 0:
                turn = up
            down = up + long[node]
            a, b = since[node], upto[node]
            if a == b:
                leaves.append(size - down)
                turns.append(turn)
                turn = -1
            else:
                depth[node] = down
                stack += to[a:b]
                above += [down] * (b - a)
        self.leaves = np.array(leaves, np.int64)
        self.turns = np.array(turns[1:], np.int64)      # between leaf k and leaf k + 1
        self.rank = np.empty(size, np.int64)
        self.rank[self.leaves] = np.arange(size)

    def lce(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extensions of the suffixes x and y (x != y): the least turning point between their leaves.

        The levels of the sparse table are made one after the other, each answers the queries of its width.
        """
        a, b = self.rank[x], self.rank[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out, row = np.zeros(len(x), np.int64), self.turns
        for k in range(int(level.max(initial=-1)) + 1):
            mine = np.flatnonzero(level == k)
            out[mine] = np.minimum(row[low[mine]], row[high[mine] - (1 << k)])
            if len(row) > 1 << k:
                row = np.minimum(row[:-(1 << k)], row[1 << k:])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the last, the next suffix of smaller rank: the end of the longest Lyndon word that starts there."""
    r, out = rank.tolist(), [0] * (len(rank) - 1)
    for i in range(len(r) - 2, -1, -1):
        j, own = i + 1, r[i]
        while r[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the sequence, by start, then period; words as integers from 1."""
    n, width = len(words), max(words, default=0) + 1
    if n < 2:
        return []
    tree = suffix_tree([*words, 0], width)
    back = Tour(suffix_tree([*words[::-1], 0], width), n + 1, width)
    found = set()
    for inverse in (False, True):
        tour = Tour(tree, n + 1, width, inverse)
        i = np.arange(n)
        j = next_smaller(tour.rank)
        may = (j - i) * times <= n
        i, j = i[may], j[may]
        right, left = tour.lce(i, j), back.lce(n - i, n - j)                # words before i and j, from right to left
        period, length = j - i, left + (j - i) + right
        may = (length >= least) & (length >= times * period)
        found.update(zip((i - left)[may].tolist(), length[may].tolist(), period[may].tolist()))
    return sorted(found, key=lambda run: (run[0], run[2]))


def document_runs(words: list[bytes], known: WordHashes, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs of a document, by start, then period."""
    if len(words) < max(least, times):
        return []
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = []
    for first, end in stretches(hashes, gram_of(least, times), times):
        ids: dict[bytes, int] = {}
        own = [ids.setdefault(w, len(ids) + 1) for w in words[first:end]]
        out += [(first + start, length, period) for start, length, period in runs_of(own, least, times)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  times: int = TIMES) -> DataFrame:
    """One row per document: the id, n_words, runs (array of start, length, period; by start, then period), collapsed."""
    def run(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes, runs, texts = [], [], []
                for text in part.column(1):
                    words = text.as_py().encode("utf-8", "surrogatepass").split()
                    own = document_runs(words, known, least, times)
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    texts.append(b" ".join(collapsed(words, own)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, RUNS),
                     pa.array(texts, pa.binary()).cast(pa.string())], [id_col, "n_words", "runs", "collapsed"])

    ship_package(docs.sparkSession)
    used = docs.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).alias("text"))
    return used.mapInArrow(run, f"`{id_col}` bigint, n_words bigint, "
                                "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
