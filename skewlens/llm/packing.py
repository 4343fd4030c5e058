"""Best-two-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

1. A document's token ids, then the separator id, are cut into pieces of ``capacity`` tokens; only longer documents are cut, and
   a last piece may be shorter.
2. Pieces of one length are interchangeable, so a packing is a list of fillings (lengths and how often each), each with the number
   of sequences that it fills.  It is found from the counts of the lengths alone, at most ``capacity`` numbers: a sequence
   takes the largest piece that fits, again and again; if a gap is left, its smallest piece gives way to two unpacked pieces that
   fit the larger gap more tightly; the filling is then repeated as long as its lengths last.  Each filling leaves
   some length L with fewer pieces than it took, at most capacity / L, so there are at most
   capacity * (2 + ln capacity) fillings however many pieces there are.
3. Pieces are numbered within their length (in buckets, so that no length is numbered in one task), and the number gives the
   sequence and the place in it by a search in the table of the fillings, whose size the same bound limits.

Defined results: null counts as an empty text, which is the separator alone; rows that repeat an id are documents of their own, a
null id is passed on; pieces of equal length are interchangeable, so ties change neither the number of sequences nor their
lengths; an empty table gives an empty result; :func:`pack` keeps all columns of its rows, whose names must not begin with ``__pk_``.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.llm.common import cut, remembered, shards_of, ship_package, text_of

CAPACITY = 2048
#: Token that ends each document.
SEPARATOR = 0
#: Words longer than this (bytes) are encoded each time, and this many shorter ones are remembered.
LONGEST, MOST = 64, 800_000
#: Where a letter meets a sign that follows it; the apostrophe may begin an ending of the word and counts as neither.
_BORDER = re.compile(rb"(?<=[a-z])(?=[.,;:!?()\[\]{}\"*_=+/|~#$%&@^<>-])")
#: Characters of the texts that are encoded together.
CHUNK = 2_000_000


class WordIds(dict):
    """word (bytes) -> its token ids as little-endian 32-bit integers; forgets everything beyond ``MOST`` words."""

    def __init__(self, model: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)            # tokens that end a run of letters or signs
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __missing__(self, word: bytes) -> bytes:
        return self._ids(word.decode("utf-8", "replace")).tobytes()

    def words(self, text: bytes) -> list[bytes]:
        """Parts of the text whose ids, one after the other, are the text's.

        The tokenizer lowers letters, parts at white space and never joins a letter with a sign; only its special tokens are
        looked for before that, so a text that may hold one is left as it is.
        """
        return text.split() if b"<|" in text else _BORDER.sub(b" ", text.lower()).split()

    def learn(self, words: set[bytes]) -> None:
        """Remember the words.  Plain letters are one run each, so new ones are encoded together and parted at the runs' ends."""
        new = [w for w in words.difference(self) if len(w) <= LONGEST]
        if len(self) + len(new) > MOST:
            self.clear()
            new = [w for w in words if len(w) <= LONGEST]
        plain = []
        for word in new:
            text = word.decode("utf-8", "replace")
            if text.isalpha() and max(text) < "\u0180" and "\u0130" not in text:
                plain.append(text)
            else:
                self[word] = self._ids(text).tobytes()
        if plain:
            ids = self._ids(" ".join(plain))
            upto = np.flatnonzero(self.last[ids]) + 1
            assert len(upto) == len(plain), "a run of letters is one word of the tokenizer"
            raw, start = ids.tobytes(), 0
            for text, end in zip(plain, (4 * upto).tolist()):
                self[text.encode()] = raw[start:end]
                start = end


def tokenised(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
              separator: int = SEPARATOR) -> DataFrame:
    """(id, piece, start, length, ids), one row per piece; ids are little-endian 32-bit integers.

    ``model`` is the JSON of a tokenizer that, like the word BPE, never joins what white space separates: its normaliser and
    split treat ASCII white space as a border, so a text's ids are those of its words, one after the other.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = remembered(shared, WordIds)
        for batch in batches:
            first, held, size = 0, [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
                held.append(known.words(text))
                size += len(text)
                if size >= CHUNK or i == batch.num_rows - 1:
                    known.learn(set().union(*held))
                    rows = ([], [], [], [], [])
                    for own, words in zip(batch.column(0).slice(first, len(held)).to_pylist(), held):
                        ids = b"".join(map(known.__getitem__, words)) + end
                        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                            part = ids[at:at + 4 * capacity]
                            for column, x in zip(rows, (own, k, at // 4, len(part) // 4, part)):
                                column.append(x)
                    yield _pieces(rows, id_col)
                    first, held, size = i + 1, [], 0

    ship_package(spark)
    used = docs.select(F.col(id_col).cast("long").alias(id_col), text_of(text_col).alias("text"))
    return used.mapInArrow(run, f"`{id_col}` bigint, piece int, start bigint, length bigint, ids binary")


def _pieces(rows, id_col: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], [id_col, "piece", "start", "length", "ids"])


def _tighter(room: int, least: int, mask: int, left) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is above ``least``, at most ``room`` and as large as can be."""
    best, pair = least, None
    larger = mask & ((1 << room) - 1)
    while larger:
        x = larger.bit_length() - 1
        larger ^= 1 << x
        if 2 * x <= best:
            break
        y = (mask & ((1 << (min(x - (left(x) < 2), room - x) + 1)) - 1)).bit_length() - 1
        if y > 0 and x + y > best:
            best, pair = x + y, (x, y)
            if best == room:
                break
    return pair


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Best-two-fit over counts of lengths: (pieces of each length in a sequence, sequences filled so)."""
    counts = {size: n for size, n in counts.items() if n}
    if any(not 0 < size <= capacity for size in counts):
        raise ValueError(f"a piece has from 1 to {capacity} tokens")
    mask, out = sum(1 << size for size in counts), []
    while mask:
        used, free, gap = Counter(), mask, capacity
        left = lambda size: counts[size] - used[size]
        while fit := free & ((1 << (gap + 1)) - 1):
            size = fit.bit_length() - 1
            n = min(gap // size, left(size))
            used[size] += n
            gap -= n * size
            if not left(size):
                free ^= 1 << size
        while gap:
            small = min(used)
            pair = _tighter(gap + small, small, free, left)
            if not pair:
                break
            for size, n in ((small, -1), (pair[0], 1), (pair[1], 1)):
                used[size] += n
                free = free | 1 << size if left(size) else free & ~(1 << size)
                if not used[size]:
                    del used[size]
            gap += small - sum(pair)
        times = min(counts[size] // n for size, n in used.items())
        out.append((dict(used), times))
        for size, n in used.items():
            counts[size] -= times * n
            if not counts[size]:
                mask ^= 1 << size
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The fillings by length and number: where the numbers of a slot begin, pieces a sequence, first sequence, offset."""
    rows, upto, sequence = [], Counter(), 0
    for used, times in plan:
        offset = 0
        for size in sorted(used, reverse=True):
            rows.append((size << 48 | upto[size], used[size], sequence, offset))
            upto[size] += used[size] * times
            offset += used[size] * size
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("key", "each", "sequence", "offset"), table.T))


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """The rows with ``sequence_id`` and ``offset``: a gapless place in a sequence of at most ``capacity`` tokens.

    The rows are written once; a row's file and place there number it, so a lost executor changes no number.
    """
    spark = pieces.sparkSession
    size, buckets = F.col(length_col).cast("long"), shards_of(spark)
    kept = cut(pieces, "pieces").select("*", size.alias("__pk_size"), F.col("_metadata.file_name").alias("__pk_file"),
                                        F.col("_metadata.row_index").alias("__pk_row"))
    kept = kept.withColumn("__pk_bucket", F.pmod(F.xxhash64("__pk_file", "__pk_row"), F.lit(buckets)))
    cells = cut(kept.groupBy("__pk_size", "__pk_bucket").agg(F.count("*").alias("__pk_n")), "cells")
    # At most ``capacity`` numbers reach the driver, however many pieces there are.
    counts = {r[0]: r[1] for r in cells.groupBy("__pk_size").agg(F.sum("__pk_n")).collect()}
    table = spark.sparkContext.broadcast(slots(fillings(counts, capacity)))
    before = Window.partitionBy("__pk_size").orderBy("__pk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("__pk_size", "__pk_bucket", F.coalesce(F.sum("__pk_n").over(before), F.lit(0)).alias("__pk_first"))
    own = Window.partitionBy("__pk_size", "__pk_bucket").orderBy("__pk_file", "__pk_row")
    numbered = kept.withColumn("__pk_own", F.row_number().over(own) - 1).join(first, ["__pk_size", "__pk_bucket"])

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        t = table.value
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        at = np.searchsorted(t["key"], length << 48 | number, side="right") - 1
        number = number - (t["key"][at] & ((1 << 48) - 1))
        each = t["each"][at]
        return pd.DataFrame({"sequence_id": t["sequence"][at] + number // each,
                             "offset": t["offset"][at] + number % each * length})

    ship_package(spark)
    placed = numbered.withColumn("__pk_place", place("__pk_size", F.col("__pk_own") + F.col("__pk_first")))
    return placed.select(*pieces.columns, "__pk_place.sequence_id", "__pk_place.offset")


def sequences(packed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(sequence_id, ids, starts): the sequences themselves, with the places where their pieces begin.

    A sequence has at most its capacity in tokens, so no group grows with the data.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids"))))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"),
        F.transform("parts", lambda x: x["offset"]).alias("starts"))
