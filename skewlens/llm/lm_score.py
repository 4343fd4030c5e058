"""Language-model scoring with an Elias-Fano n-gram trie.

Training counts n-grams over all training texts, level by level.  Level 1 is the sorted hashes of all words with their
counts, dealt into shards by the hash; a node of level k is a context (a node of level k - 1) and a following word, kept from
``least_count`` occurrences on (a parameter of ``train``; by default every n-gram is kept).  The contexts of a level are dealt
into shards by ranges of their numbers, so a context's successors lie together.  Only the hot contexts, those that hold more than a
shard's share of all tokens (fewer than there are shards), have their successors dealt over all shards.  A shard is one file in
the shared folder:

* pointers, a monotone sequence in Elias-Fano form: where the successors of each of its contexts begin;
* the successors, another one: a word's number among the successors of the context that is a word shorter (its number among all words, in
  level 2), raised by the last value before the context's own, so that the sequence never falls;
* an 8-bit code per node of its discounted probability max(c - D, 0) / c(context), rounded down;
* the weight each context leaves to the shorter one, 1 - the sum of its successors' decoded probabilities.

So p(w | u v) = a(u v w) + left(u v) * p(w | v), down to the add-one unigram, and the quantised model still sums to 1.  Scoring maps the
files into memory; the pointers of a context bound the search for the successor, whose place among the context's own is its relative
number one level below.  No level is ever broadcast or collected, and the driver sees one manifest row per shard.

Defined results: a null or empty text is its end token alone; a word is known by its 64-bit hash; unknown words get the add-one
share of a word never seen, and no context reaches across them; rows are independent, repeated rows count and score as often
as they occur; without training texts every token scores 0 (probability 1); an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.llm.common import cut, fresh, open_fs, pow2_at_least, remembered, shards_of, ship_package, text_of
from skewlens.llm.shingles import flat_word_hashes, mixed
from skewlens.session import scratch_path

ORDER, DISCOUNT, LEAST_COUNT = 3, 0.75, 1
#: Reserved hashes: the end token is a word; the begin mark is only a context (its node follows the last word).
END = np.uint64(1)
#: Bytes of neighbouring texts handled and hashed at once, and n-grams held before they are handed on.
CHUNK, BLOCK, HELD = 4_000_000, 500_000, 1_000_000
BLOBS = "shard int, keys binary, counts binary"
MANIFEST = "shard int, file string, n bigint, total bigint, ends bigint, span bigint, hot array<bigint>, hot_counts array<bigint>, given array<double>"
_KINDS = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()))


def _manifest(*row) -> pa.Table:
    return pa.table([pa.array([x], k) for x, k in zip(row, _KINDS)], [part.split()[0] for part in MANIFEST.split(", ")])


#: One in each byte of a word; the place of each set bit of a byte.
_EACH = np.uint64(0x0101010101010101)
_SELECT1 = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _SELECT1[_b, :_b.bit_count()] = [i for i in range(8) if _b >> i & 1]


class EliasFano:
    """A non-decreasing sequence up to ``universe``: low bits packed in words, high bits in unary with directories of zeros and ones."""

    def __init__(self, arrays: dict, n: int, low_bits: int, universe: int):
        self.n, self.low_bits, self.universe = n, low_bits, universe
        self.low, self.bits, self.zeros, self.ones = (arrays[k] for k in ("low", "bits", "zeros", "ones"))

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple[dict, dict]:
        """(arrays, header) of a sequence of unsigned 64-bit numbers, none above ``universe``."""
        n = len(values)
        low_bits = min(63, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (universe >> low_bits) + 1
        raised = np.zeros(-(-size // 64) * 64, bool)
        raised[high + np.arange(n)] = True
        raised[size:] = True
        bits = np.packbits(raised, bitorder="little").view("<u8")
        set_ = raised.reshape(-1, 64).sum(axis=1)
        rest, at = values & np.uint64((1 << low_bits) - 1), np.arange(n) * low_bits
        word, by = at >> 6, (at & 63).astype(np.uint64)
        low = np.zeros(n * low_bits // 64 + 2, "<u8")
        if n:
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[starts]] = np.bitwise_or.reduceat(rest << by, starts)
            over = np.flatnonzero(by + np.uint64(low_bits) > 64)
            low[word[over] + 1] |= rest[over] >> (np.uint64(64) - by[over])
        kind = np.uint32 if size < 1 << 32 else np.int64
        before = lambda each: (np.cumsum(each) - each).astype(kind)
        return ({"low": low, "bits": bits, "zeros": before(64 - set_), "ones": before(set_)},
                {"n": n, "low_bits": low_bits, "universe": universe})

    def _select(self, j: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the ones or zeros of these ranks: the block from the directory, the byte by byte-wise sums within a word."""
        directory = self.ones if one else self.zeros
        j = j.astype(directory.dtype)
        block = np.searchsorted(directory, j, side="right") - 1
        rest, own = (j - directory[block]).astype(np.uint64), self.bits[block] if one else ~self.bits[block]
        upto = own - ((own >> np.uint64(1)) & _EACH * np.uint64(0x55))
        upto = (upto & _EACH * np.uint64(0x33)) + ((upto >> np.uint64(2)) & _EACH * np.uint64(0x33))
        upto = ((upto + (upto >> np.uint64(4))) & _EACH * np.uint64(0x0F)) * _EACH
        top = _EACH * np.uint64(0x80)
        byte = np.bitwise_count(((rest * _EACH | top) - upto) & top).astype(np.uint64) << np.uint64(3)
        rest -= (upto << np.uint64(8) >> byte) & np.uint64(0xFF)
        return block * 64 + byte.astype(np.int64) + _SELECT1[((own >> byte) & np.uint64(0xFF)).astype(np.intp), rest.astype(np.intp)]

    def _next(self, place: np.ndarray, j: np.ndarray, one: bool) -> np.ndarray:
        """The next one or zero, of rank ``j``, after these places: mostly in the same word or the next."""
        word = place >> 6
        own = self.bits[word] if one else ~self.bits[word]
        own = own & (~np.uint64(0) << (place & 63).astype(np.uint64) << np.uint64(1))
        bare = np.flatnonzero(own == 0)
        word[bare] += 1
        own[bare] = self.bits[word[bare]] if one else ~self.bits[word[bare]]
        out = word * 64 + np.bitwise_count((own & (~own + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        far = bare[own[bare] == 0]
        out[far] = self._select(j[far], one)
        return out

    def _value(self, i: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at these positions."""
        return self._value(i, self._select(i, True))

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at these positions and at the next ones (the last position has no next: its own value)."""
        place = self._select(i, True)
        following = place.copy()
        more = np.flatnonzero(i + 1 < self.n)
        following[more] = self._next(place[more], i[more] + 1, True)
        return self._value(i, place), self._value(np.minimum(i + 1, self.n - 1), following)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        word, by = at >> 6, (at & 63).astype(np.uint64)
        both = self.low[word] >> by | self.low[word + 1] << np.uint64(1) << np.uint64(63) - by
        return both & np.uint64((1 << self.low_bits) - 1)

    def bounds(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last position of the elements with these high parts."""
        before = self._select(np.maximum(high - 1, 0), False)
        end = before.copy()                                                 # of rank 0: the zero itself
        more = np.flatnonzero(high > 0)
        end[more] = self._next(before[more], high[more], False)
        return np.where(high > 0, before - (high - 1), 0), end - high

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Position of each number from ``first`` to ``end`` - 1 (the first, if it repeats), or -1."""
        out = np.full(len(x), -1, np.int64)
        may = np.flatnonzero(x <= np.uint64(self.universe))
        if not self.n or not len(may):
            return out
        high = (x[may] >> np.uint64(self.low_bits)).astype(np.int64)
        want = x[may] & np.uint64((1 << self.low_bits) - 1)
        lo, end_ = self.bounds(high)
        if first is not None:
            lo, end_ = np.maximum(lo, first[may]), np.minimum(end_, end[may])
        hi = np.maximum(end_, lo)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        inside = np.flatnonzero(lo < end_)
        hit = inside[self._low(lo[inside]) == want[inside]]
        out[may[hit]] = lo[hit]
        return out

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.bits.view(np.uint8), bitorder="little"))[:self.n] - np.arange(self.n)
        return high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(np.arange(self.n))


def save(folder: str, sequences: dict[str, tuple[dict, dict]], arrays: dict[str, np.ndarray]) -> str:
    """Write one shard to a file of its own and return its name."""
    fs, top = open_fs(folder)
    fs.create_dir(top, recursive=True)
    name, head, parts, at = uuid.uuid4().hex, {"sequences": {}, "arrays": {}}, [], 0
    flat = dict(arrays)
    for key, (own, about) in sequences.items():
        head["sequences"][key] = about
        flat |= {f"{key}.{part}": a for part, a in own.items()}
    for key, a in flat.items():
        data = memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b""
        head["arrays"][key] = [a.dtype.str, at, len(a)]
        parts += [data, bytes(-len(data) % 8)]
        at += len(data) + -len(data) % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
        for part in (len(text).to_bytes(8, "little"), text, *parts):
            out.write(part)
    return name


def mapped(folder: str, name: str) -> tuple[dict[str, EliasFano], dict[str, np.ndarray]]:
    """A shard's sequences and arrays, mapped into memory (from a store that is no file system: a nameless local copy)."""
    from pyarrow import fs as stores
    fs, top = open_fs(folder)
    if isinstance(fs, stores.LocalFileSystem):
        raw = np.memmap(f"{top}/{name}", np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(f"{top}/{name}", compression=None) as source:
            while data := source.read(8 << 20):
                copy.write(data)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8:8 + size].tobytes())
    base = 8 + size
    flat = {k: np.asarray(raw[base + at:base + at + n * np.dtype(kind).itemsize].view(kind)) for k, (kind, at, n) in head["arrays"].items()}
    sequences = {k: EliasFano({p: flat[f"{k}.{p}"] for p in ("low", "bits", "zeros", "ones")}, **h) for k, h in head["sequences"].items()}
    return sequences, {k: v for k, v in flat.items() if "." not in k}


@dataclass
class Trie:
    """What tasks need to open the model: the folder and, per level, the shards' files, first node numbers and context ranges."""
    folder: str
    shards: int
    least_count: int = LEAST_COUNT
    tokens: int = 0
    texts: int = 0
    files: list[list[str | None]] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)
    span: list[int] = field(default_factory=list)               # successors' numbers in the level below lie below this
    #: From level 2 on (index 1): first context of each shard; hot contexts, their counts, and what they leave.
    bounds: list[np.ndarray | None] = field(default_factory=lambda: [None])
    hot: list[np.ndarray | None] = field(default_factory=lambda: [None])
    hot_counts: list[np.ndarray | None] = field(default_factory=lambda: [None])
    hot_left: list[np.ndarray | None] = field(default_factory=lambda: [None])

    @property
    def words(self) -> int:
        return int(self.first[0][-1])

    def place(self, level: int, context: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, context's number there, whether it is hot) of each successor ``number`` of a context."""
        bounds, hot = self.bounds[level], self.hot[level]
        shard = np.searchsorted(bounds, context, side="right") - 1
        own = context - bounds[shard]
        at = np.minimum(np.searchsorted(hot, context), max(0, len(hot) - 1))
        is_hot = hot[at] == context if len(hot) else np.zeros(len(context), bool)
        if is_hot.any():
            n = len(bounds) - 1
            with np.errstate(over="ignore"):
                mix = mixed(context[is_hot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number[is_hot].astype(np.uint64))
            shard[is_hot] = (mix % np.uint64(n)).astype(np.int64)
            own[is_hot] = (bounds[1:] - bounds[:-1])[shard[is_hot]] + at[is_hot]
        return shard, own, is_hot

    def key_bits(self, level: int) -> int:
        """Bits of a successor's number; a context's number within its shard takes the rest of 64."""
        return max(1, self.span[level - 1].bit_length())


class Reader:
    """A trie mapped by one Python worker."""

    def __init__(self, trie: Trie):
        self.trie, self.held = trie, {}

    def shard(self, level: int, s: int):
        name = self.trie.files[level][s]
        if name is None:
            return None
        if name not in self.held:
            self.held[name] = mapped(self.trie.folder, name)
        return self.held[name]

    def word_nodes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, count) of distinct word hashes, in order."""
        t = self.trie
        node, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shift = 64 - (t.shards.bit_length() - 1)
        for s, at in _by_shard((hashes >> np.uint64(shift)).astype(np.int64) if t.shards > 1 else np.zeros(len(hashes), np.int64)):
            if (got := self.shard(0, s)) is not None:
                rest = hashes[at] & np.uint64((1 << shift) - 1)
                i = got[0]["keys"].find(rest)
                ok = i >= 0
                node[at[ok]], count[at[ok]] = i[ok] + t.first[0][s], got[1]["counts"][i[ok]]
        return node, count

    def next_nodes(self, level: int, context: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, probability, number in the level below) of distinct successors, in the order of their contexts."""
        t = self.trie
        node, prob, below = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.full(len(context), -1, np.int64)
        place, own, hot = t.place(level, context, number)
        n = len(t.bounds[level]) - 1
        for s, at in _by_shard(place):
            if (got := self.shard(level, s)) is not None:
                pointers, successors = got[0]["pointers"], got[0]["successors"]
                heads = np.flatnonzero(np.concatenate([[True], own[at][1:] != own[at][:-1]]))
                mine, times = own[at[heads]], np.diff(heads, append=len(at))
                first, end = (x.astype(np.int64) for x in pointers.pair(mine))
                some = np.flatnonzero(end > first)                              # contexts that have successors here
                first, end, times = first[some], end[some], times[some]
                at = at[np.repeat(heads[some] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                # The value before a context's successors and the first of them; most contexts have no other.
                before, lead = successors.pair(np.maximum(first - 1, 0))
                before, lead = np.where(first > 0, before, np.uint64(0)), np.where(first > 0, lead, before)
                first, end, before, lead = (np.repeat(x, times) for x in (first, end, before, lead))
                want = before + number[at].astype(np.uint64)
                i = np.where(want == lead, first, -1)
                rest = np.flatnonzero((want > lead) & (end - first > 1))
                i[rest] = successors.find(want[rest], first[rest] + 1, end[rest])
                ok = np.flatnonzero(i >= 0)
                i, first, at = i[ok], first[ok], at[ok]
                node[at] = i + t.first[level][s]
                prob[at] = decoded(got[1]["codes"][i])
                below[at] = np.where(hot[at], (i - first) * n + s, i - first)
        return node, prob, below

    def left(self, level: int, context: np.ndarray) -> np.ndarray:
        """What each context leaves to the shorter one; ``level`` is that of its successors."""
        t = self.trie
        out = np.ones(len(context))
        place = np.searchsorted(t.bounds[level], context, side="right") - 1
        for s, at in _by_shard(place):
            if (got := self.shard(level, s)) is not None:
                out[at] = got[1]["left"][context[at] - t.bounds[level][s]]
        if len(hot := t.hot[level]):
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            out = np.where(hot[at] == context, t.hot_left[level][at], out)
        return out

    def counts(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Occurrences of the nodes of a level (of the begin mark: the texts)."""
        t = self.trie
        out = np.full(len(nodes), t.texts, np.int64)
        place = np.searchsorted(t.first[level], nodes, side="right") - 1
        for s, at in _by_shard(place):
            if s < t.first[level].size - 1:
                out[at] = self.shard(level, s)[1]["counts"][nodes[at] - t.first[level][s]]
        return out


def _by_shard(place: np.ndarray):
    small = len(place) > 0 and place.max() < 1 << 16             # sorted by radix
    order = np.argsort(place.astype(np.uint16) if small else place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(place[at[0]]), at


def code(a: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(-8 * np.log2(a)), 0, 255).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.exp2(-codes.astype(float) / 8)


def _open(shared) -> Reader:
    return remembered(shared, Reader)


def _token_chunks(batches):
    """(batch, first row, rows, text number per token, hash per token); each text ends in END."""
    def tokens(texts):
        docs, hashes, some, size, done = [], [], [], 0, 0
        for i, text in enumerate(texts):
            some.append(text)
            size += len(text)
            if size >= BLOCK or i == len(texts) - 1:
                doc, h = flat_word_hashes(some)
                last = np.cumsum(np.bincount(doc, minlength=len(some))) + np.arange(len(some))          # END after the words
                own = np.full(len(h) + len(some), END)
                own[np.arange(len(h)) + doc] = h
                docs.append(np.repeat(np.arange(len(some)), np.diff(last, prepend=-1)) + done)
                hashes.append(own)
                some, size, done = [], 0, i + 1
        return np.concatenate(docs), np.concatenate(hashes)

    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        first, held, size = 0, [], 0
        for i in range(batch.num_rows):
            held.append(column[i].as_py())
            size += len(held[-1])
            if size >= CHUNK or i == batch.num_rows - 1:
                yield batch, first, len(held), *tokens(held)
                first, held, size = i + 1, [], 0


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first parts, second parts, place of each) of the distinct pairs of non-negative numbers, in order."""
    bits = int(two.max(initial=0)).bit_length()
    if int(one.max(initial=0)).bit_length() + bits < 64:
        keys, back = np.unique(one << bits | two, return_inverse=True)
        return keys >> bits, keys & ((1 << bits) - 1), back
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    head = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(head) - 1
    return a[head], b[head], back


def _sequences(reader: Reader, doc: np.ndarray, hashes: np.ndarray, upto: int, lefts: bool = False):
    """Nodes along the texts: (counts, [per level from 2: (probabilities, what the contexts leave)], next contexts, next numbers).

    An n-gram is kept only if the shorter ones within it are, so only those are looked up: contexts and successors that
    cannot have a kept n-gram are -1.
    """
    distinct, back = np.unique(hashes, return_inverse=True)
    node, count = reader.word_nodes(distinct)
    node, count = node[back], count[back]
    starts = np.diff(doc, prepend=-1) > 0
    number = np.where(count >= reader.trie.least_count, node, -1)
    context = np.where(starts, reader.trie.words, np.roll(number, 1))       # the begin mark's node follows the words
    levels = []
    for level in range(1, upto):
        found, prob, below = np.full(len(node), -1, np.int64), np.zeros(len(node)), np.full(len(node), -1, np.int64)
        at = np.flatnonzero((context >= 0) & (number >= 0))
        one, two, back = _distinct(context[at], number[at])
        n, p, b = reader.next_nodes(level, one, two)
        found[at], prob[at], below[at] = n[back], p[back], b[back]
        if lefts:
            left = np.ones(len(node))
            heads = np.flatnonzero(np.diff(one, prepend=-1))
            left[at] = np.repeat(reader.left(level, one[heads]), np.diff(heads, append=len(one)))[back]
            rest = np.flatnonzero((context >= 0) & (number < 0))
            nodes, back = np.unique(context[rest], return_inverse=True)
            left[rest] = reader.left(level, nodes)[back]
            levels.append((prob, left))
        context, number = np.where(starts, -1, np.roll(found, 1)), below
    return count, levels, context, number


def _packed(a: np.ndarray) -> bytes:
    """Numbers byte place by byte place, so that the places that are zero throughout compress to nothing."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts; holds few arrays at a time."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    del order
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([np.cumsum(_unpacked(x.as_py()), dtype=np.uint64) for x in table.column("keys")]),
                   np.concatenate([_unpacked(x.as_py()).astype(np.int64) for x in table.column("counts")]))


class _Held:
    """n-grams counted by one task, by shard, handed on before they take too much memory."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, shard: np.ndarray, keys: np.ndarray):
        for s, at in _by_shard(shard):
            distinct, counts = np.unique(keys[at], return_counts=True)
            self.parts.append((s, distinct, counts))
            self.size += len(distinct)
        if self.size >= HELD:
            yield self.out()

    def out(self):
        rows: tuple[list, list, list] = ([], [], [])
        self.parts.sort(key=lambda part: part[0])
        for s, group in itertools.groupby(self.parts, key=lambda part: part[0]):
            keys, counts = _summed(*(np.concatenate(x) for x in list(zip(*group))[1:]))
            for column, x in zip(rows, (s, _packed(np.diff(keys, prepend=np.uint64(0))), _packed(counts))):     # sorted, so the steps are small
                column.append(x)
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int32(), pa.binary(), pa.binary()))],
                                          ["shard", "keys", "counts"])


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER, shards: int | None = None, folder: str | None = None,
          least_count: int = LEAST_COUNT) -> Trie:
    """Learn from all texts, n-grams from ``least_count`` occurrences on (1: every n-gram); returns where the model lies."""
    spark = texts.sparkSession
    ship_package(spark)
    n = pow2_at_least(shards or max(16, shards_of(spark)))
    trie = Trie(folder or scratch_path(spark, "lm"), n, least_count)
    own = texts.select(text_of(text_col).alias("text"))
    where = trie.folder
    shift = 64 - (n.bit_length() - 1)

    def count_words(batches):
        held = _Held()
        for _, _, _, _, hashes in _token_chunks(fresh(batches)):
            yield from held.add((hashes >> np.uint64(shift)).astype(np.int64) if n > 1 else np.zeros(len(hashes), np.int64), hashes)
        if held.parts:
            yield held.out()

    def build_words(key, table):
        keys, counts = _merged(table)
        rest = keys & np.uint64((1 << shift) - 1)
        name = save(where, {"keys": EliasFano.build(rest, 1 << shift)}, {"counts": counts})
        hot = np.flatnonzero(counts * n > counts.sum())         # what may be hot; the total is not known yet
        return _manifest(key[0].as_py(), name, len(keys), int(counts.sum()), int(counts[keys == END].sum()), 0, hot, counts[hot], [])

    made = cut(own.mapInArrow(count_words, BLOBS).groupBy("shard").applyInArrow(build_words, MANIFEST), "words")
    rows = made.drop("hot", "hot_counts", "given").collect()
    trie.tokens, trie.texts = sum(r["total"] for r in rows), sum(r["ends"] for r in rows)
    _place(trie, rows, n)
    trie.span = [trie.words + 1]
    for level in range(1, order):
        made = _train_level(own, trie, level, made)
    return trie


def _place(trie: Trie, rows, shards: int) -> None:
    files, sizes = [None] * shards, [0] * shards
    for r in rows:
        files[r["shard"]], sizes[r["shard"]] = r["file"], r["n"]
    trie.files.append(files)
    trie.first.append(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _hot_contexts(trie: Trie, level: int, made: DataFrame) -> None:
    """Contexts of the level that hold more than a shard's share of all tokens: fewer than there are shards."""
    pair = F.explode(F.arrays_zip("hot", "hot_counts")).alias("h")
    large = made.select("shard", pair).where(F.col("h.hot_counts") * trie.shards > trie.tokens).select("shard", "h.hot", "h.hot_counts")
    found = [(int(trie.first[level - 1][r[0]]) + r[1], r[2]) for r in large.collect()]
    if level == 1 and trie.texts * trie.shards > trie.tokens:
        found.append((trie.words, trie.texts))                  # the begin mark
    found.sort()
    trie.hot.append(np.array([x for x, _ in found], np.int64))
    trie.hot_counts.append(np.array([x for _, x in found], np.int64))


def _ranges(trie: Trie, level: int) -> np.ndarray:
    """First context of each shard of a level: the shards of the level below, parted where a key would pass 64 bits."""
    bounds = trie.first[level - 1].copy()
    bounds[-1] += level == 1                                    # the begin mark
    most = (1 << (63 - trie.key_bits(level))) - len(trie.hot[level])
    if most < 1:
        raise OverflowError("a word's successors and the hot contexts do not fit a key; train with fewer shards")
    parts = [np.arange(a, b, max(1, min(most, b - a))) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    # A shard without contexts keeps its place.
    parts = [part if len(part) else np.array([a]) for part, a in zip(parts, bounds[:-1].tolist())]
    return np.concatenate([*parts, bounds[-1:]]).astype(np.int64)


def _train_level(own: DataFrame, trie: Trie, level: int, below: DataFrame) -> DataFrame:
    _hot_contexts(trie, level, below)
    trie.bounds.append(_ranges(trie, level))
    n, bits = len(trie.bounds[level]) - 1, trie.key_bits(level)
    shared = own.sparkSession.sparkContext.broadcast(trie)

    def count(batches):
        reader, held = _open(shared), _Held()
        for _, _, _, doc, hashes in _token_chunks(batches):
            _, _, context, number = _sequences(reader, doc, hashes, level)
            at = np.flatnonzero((context >= 0) & (number >= 0))
            if len(at):
                shard, mine, _ = reader.trie.place(level, context[at], number[at])
                yield from held.add(shard, mine.astype(np.uint64) << np.uint64(bits) | number[at].astype(np.uint64))
        if held.parts:
            yield held.out()

    def build(key, table):
        reader, s = _open(shared), key[0].as_py()
        t = reader.trie
        keys, counts = _merged(table)
        keys, counts = keys[counts >= t.least_count], counts[counts >= t.least_count]
        range_, hot = int(t.bounds[level][s + 1] - t.bounds[level][s]), len(t.hot[level])
        mine, number = (keys >> np.uint64(bits)).astype(np.int64), keys & np.uint64((1 << bits) - 1)
        first = np.searchsorted(mine, np.arange(range_ + hot + 1))
        size = np.diff(first)
        # Each context's numbers go on from the last value before them.
        last = np.where(size > 0, number[np.maximum(first[1:], 1) - 1].astype(np.int64), 0) if len(keys) else np.zeros(len(size), np.int64)
        values = number + np.repeat(np.cumsum(last) - last, size).astype(np.uint64)
        some = np.flatnonzero(size)
        whole = np.zeros(len(size))
        inside = some[some < range_]
        whole[inside] = reader.counts(level - 1, inside + t.bounds[level][s])
        whole[range_:] = t.hot_counts[level]
        codes = code((counts - DISCOUNT) / whole[mine]) if len(keys) else np.empty(0, np.uint8)
        given = np.bincount(mine, weights=decoded(codes), minlength=range_ + hot)
        large = np.flatnonzero(counts * t.shards > t.tokens)
        name = save(t.folder, {"pointers": EliasFano.build(first.astype(np.uint64), len(keys)),
                               "successors": EliasFano.build(values, int(values[-1]) if len(keys) else 0)},
                    {"codes": codes, "counts": counts.astype(np.min_scalar_type(int(counts.max(initial=0)))),
                     "left": np.maximum(1 - given[:range_], 0).astype(np.float32)})
        span = max(int(size[:range_].max(initial=0)), int(size[range_:].max(initial=0)) * n + n)
        return _manifest(s, name, len(keys), int(counts.sum()), 0, span, large, counts[large], given[range_:])

    made = cut(own.mapInArrow(count, BLOBS).groupBy("shard").applyInArrow(build, MANIFEST), "level")
    rows = made.select("shard", "file", "n", "span").collect()
    _place(trie, rows, n)
    trie.span.append(max((r["span"] for r in rows), default=1))
    # A hot context's successors lie in all shards: their shares are put together in the order of the shards.
    parts = made.select("shard", F.posexplode("given").alias("hot", "given")).groupBy("hot").agg(
        F.array_sort(F.collect_list(F.struct("shard", "given"))).alias("parts"))
    left = np.ones(len(trie.hot[level]))
    for hot, given in parts.select("hot", F.aggregate("parts", F.lit(1.0), lambda x, part: x - part["given"])).collect():
        left[hot] = max(given, 0.0)
    trie.hot_left.append(left)
    return made


def score(docs: DataFrame, trie: Trie, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` (columns of these names replaced) with n_tokens, n_known, train_tokens, base_score and score of each whole text."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trie)
    names = [prefix + c for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    kept = docs.drop(*names)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)
    order = len(trie.files)

    def run(batches):
        reader = _open(shared)
        t = reader.trie
        named = ([b, pa.RecordBatch.from_arrays([b.column(b.schema.names.index(text_col)).fill_null("")], ["text"])] for b in batches)
        for batch, only in named:
            for _, first, rows, doc, hashes in _token_chunks([only]):
                count, levels, _, _ = _sequences(reader, doc, hashes, order, lefts=True)
                base = (count + 1) / (t.tokens + t.words + 1)
                p = base
                for prob, left in levels:
                    p = prob + left * p
                total = lambda x: pa.array(np.bincount(doc, weights=x, minlength=rows))
                whole = lambda x: pa.array(np.bincount(doc, weights=x, minlength=rows).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, rows).columns, whole(np.ones(len(doc))), whole(count > 0),
                     pa.array(np.full(rows, t.tokens, np.int64)), total(np.log10(base)), total(np.log10(p))], [*batch.schema.names, *names])

    kinds = ("bigint", "bigint", "bigint", "double", "double")
    return kept.mapInArrow(run, ", ".join([schema, *(f"{c} {k}" for c, k in zip(names, kinds))]))
