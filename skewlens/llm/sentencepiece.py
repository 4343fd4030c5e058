"""SentencePiece encoding and decoding with a Unigram vocabulary.

Encoding is a Viterbi search for the segmentation of highest summed log score.  The pieces lie in a double-array trie
over their UTF-8 bytes, in which all pieces that start at a position are found by one walk.  A character that no piece
of its own covers costs 10 less than the worst score and becomes byte pieces (byte fallback).  Spaces
become the marker U+2581, one is put in front, and decoding undoes both.

No piece holds the marker after another character (checked when the vocabulary is read), so the best segmentation never
crosses from a non-space to a space: a text falls apart into (spaces, non-spaces) chunks, each found once and remembered.

Defined results: a null or empty text has no pieces and decodes to the empty text; a literal U+2581 is encoded as
bytes, so every text decodes to itself; white space other than the space is an ordinary character; of segmentations
with equal scores the one whose last piece starts first wins; rows are independent, so repeated rows repeat their result;
an input column with the name of an output column is replaced.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skewlens.llm.common import remembered, ship_package

MARK = "▁".encode()
UNKNOWN_PENALTY = 10.0
CHUNKS = re.compile(rb" *[^ ]+| +")
#: Longest chunk that is remembered, and how many are in each of two generations.
MEMO_BYTES, MEMO_CHUNKS = 40, 200_000


@dataclass
class Vocabulary:
    """Pieces (marker as space), log scores (None: not for matching) and the byte pieces' ids."""
    pieces: list[bytes]
    scores: list[float | None]
    bytes_: list[int]


def read_vocabulary(model_file: str, zipf: bool = True) -> Vocabulary:
    """Read a SentencePiece model file on the driver; it is bounded by its vocabulary (some 10^5 pieces).

    ``zipf``: the file's scores are merge ranks, not log probabilities; piece number r (from 1) of n then gets the
    log probability of Zipf's law, -ln(r) - ln(1 + 1/2 + ... + 1/n).  False takes the file's scores as they are.
    """
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = m.vocab_size()
    plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    scores: list[float | None] = [None] * n
    norm = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
    for r, i in enumerate(sorted(plain, key=lambda i: (-m.get_score(i), i)), 1):
        scores[i] = -math.log(r) - norm if zipf else m.get_score(i)
    bytes_, pieces = [0] * 256, [b""] * n
    for i in range(n):
        if m.is_byte(i):
            value = int(m.id_to_piece(i)[3:5], 16)
            bytes_[value], pieces[i] = i, bytes([value])
        elif scores[i] is not None:
            pieces[i] = m.id_to_piece(i).encode().replace(MARK, b" ")
            if b" " in pieces[i].lstrip(b" "):
                raise ValueError(f"piece {i} holds the space marker after another character")
    return Vocabulary(pieces, scores, bytes_)


@dataclass
class DoubleArray:
    """Trie as arrays: child = base[node] + byte + 1 exists if check[child] == node; value is a piece or -1."""
    base: list[int]
    check: list[int]
    value: list[int]

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, number in keys.items():
            at = 0
            for b in key:
                if b not in tree[at]:
                    tree[at][b] = len(tree)
                    tree.append({})
                at = tree[at][b]
            ends[at] = number
        size = 2 * len(tree) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], lowest, waiting = 0, 1, [(0, 0)]
        while waiting:
            node, pos = waiting.pop()
            value[pos] = ends.get(node, -1)
            codes = sorted(tree[node])
            if not codes:
                continue
            slot, tried = max(lowest, codes[0] + 2), 0
            while True:
                if slot + 300 >= len(check):
                    base += [0] * size
                    check += [-1] * size
                    value += [-1] * size
                start = slot - codes[0] - 1
                if check[slot] < 0 and all(check[start + c + 1] < 0 for c in codes):
                    break
                slot, tried = slot + 1, tried + 1
            if tried > 64:
                lowest = max(lowest, slot - 256)
            base[pos] = start
            for c in codes:
                check[start + c + 1] = pos
                waiting.append((tree[node][c], start + c + 1))
        return cls(base, check, value)


class Encoder(dict):
    """Encoder of a Python worker; as a dict it remembers chunk -> ids (little-endian 4-byte numbers)."""

    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray):
        super().__init__()
        self.v, self.trie, self.older = vocabulary, trie, {}
        self.unknown = min((s for s in vocabulary.scores if s is not None), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, s in zip(vocabulary.pieces, vocabulary.scores) if s is not None), default=0)
        # A child is at base + byte; what ends nowhere has no score, and no sum with it is greater than another.
        self.base = [x + 1 for x in trie.base]
        self.gain = [-math.inf if x < 0 else vocabulary.scores[x] for x in trie.value]

    def viterbi(self, text: bytes) -> tuple[list[int], float]:
        """(ids, score) of the best segmentation of UTF-8 bytes in which spaces stand for the marker."""
        base, check, gain, value, n = self.base, self.trie.check, self.gain, self.trie.value, len(text)
        best, back, piece = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], at, longest, unknown = 0.0, 0, self.longest, self.unknown
        while at < n:
            lead, here, node, i = text[at], best[at], 0, at
            after = at + 1 if lead < 0x80 else min(n, at + (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4))
            for byte in text[at:at + longest]:
                child = base[node] + byte
                if check[child] != node:
                    break
                node, i = child, i + 1
                score = here + gain[child]
                if score > best[i]:
                    best[i], back[i], piece[i] = score, at, value[child]
            if here + unknown > best[after]:            # never, if a piece covers the character
                best[after], back[after], piece[after] = here + unknown, at, -1
            at = after
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(self.v.bytes_[b] for b in reversed(text[back[at]:at]))
            at = back[at]
        out.reverse()
        return out, best[n]

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = struct.pack(f"<{len(found := self.viterbi(chunk)[0])}I", *found)
        if len(chunk) <= MEMO_BYTES:
            if len(self) >= MEMO_CHUNKS:                    # what was not used since the last change is forgotten
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if not text:
            return b""
        parts = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                parts.append(np.array([self.v.bytes_[b] for b in MARK], "<u4").tobytes())
            parts.extend(map(self.__getitem__, CHUNKS.findall(part if k else b" " + part)))
        return b"".join(parts)


def trie_of(vocabulary: Vocabulary) -> DoubleArray:
    return DoubleArray.build({p: i for i, (p, s) in enumerate(zip(vocabulary.pieces, vocabulary.scores)) if s is not None})


def decoded(pieces: list[bytes], ids: list[int]) -> str:
    """Bytes that are no UTF-8 become U+FFFD; ids without text (control pieces) vanish."""
    return b"".join(map(pieces.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _with_column(df: DataFrame, name: str, kind: str, make) -> DataFrame:
    """``df`` and a column that ``make`` yields for each Arrow batch."""
    df = df.drop(name)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in make(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "piece_ids", lossless: bool = False) -> DataFrame:
    """``docs`` with the array of piece ids of each whole text.

    ``lossless`` keeps only the rows whose ids decode to their own text; they are decoded in the same task, so an executor
    holds one worker a task and the ids cross to it once.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, trie_of(vocabulary)))

    def make(batches):
        encoder = remembered(shared, lambda value: Encoder(*value))
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).cast(pa.binary())
            ids = [encoder.encode(t.as_py() or b"") for t in texts]
            if lossless:
                keep = [decoded(encoder.v.pieces, np.frombuffer(x, "<u4").tolist()) == (t.as_py() or b"").decode("utf-8", "replace")
                        for x, t in zip(ids, texts)]
                batch, ids = batch.filter(pa.array(keep, pa.bool_())), [x for x, k in zip(ids, keep) if k]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32), pa.int32())
            yield batch, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return _with_column(docs, out, "array<int>", make)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each array of piece ids (null: empty)."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    def make(batches):
        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col)).fill_null([])
            texts = [decoded(shared.value, x.values.to_numpy(zero_copy_only=False).tolist()) for x in ids]
            yield batch, pa.array(texts, pa.string())

    return _with_column(df, out, "string", make)
