"""Phrase collocations by mergeable Misra-Gries summaries and an exact second pass.

A phrase is one to ``longest`` words in a row within a piece of text, counted per language.  Every part of a frequent phrase is
at least as frequent, so all counts that a score needs are counts of frequent phrases.

1. Pass 1 hashes every phrase occurrence and deals the hashes to hash partitions.  Each stretch of text becomes one Misra-Gries
   summary per partition (its distinct hashes with their counts), and a partition's summaries are merged: counts add up, and
   beyond the capacity the least count that makes room is taken from all.  The capacity is ``SPARE`` times the partition's mass over the
   threshold, so what is taken from a count is less than threshold / SPARE in total, and every phrase that reaches the threshold survives
   with at least the rest.  The number of partitions follows the mass, so a partition's summaries stay of one size.
2. Pass 2 reads the texts again, finds the surviving hashes' occurrences and counts them exactly, as phrases.  The survivors
   reach the tasks as a bitmap of hash slots (a false hit costs a row, no count), in as many rounds over ranges of hash partitions
   as it takes to keep each bitmap below ``MAP_BYTES``.
3. Scores come from joins of the cuts' parts with the counts, in decimals of 38 digits; phrases inside a longer one that is as
   frequent go; each language's first phrases stay.

Words that recur, in a hot language or a passage that all documents share, are counted within each task before anything is shuffled.

Defined results: null counts as an empty text, a null language as ``und``; A-Z count as a-z, nothing else changes; ids and
extra columns are not read, so rows that repeat an id count as often as they stand there; ties are ordered by score, then count, then
the phrase's UTF-8 bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewlens.llm.common import cut, ship_package, text_of
from skewlens.llm.shingles import mixed

LONGEST, THRESHOLD, SHARE, TOP = 5, 100, 100, 2000
#: Counters of a summary: this many times mass / threshold.
SPARE = 4
#: Phrase occurrences of a hash partition (about), bytes of one round's bitmap, and its slots per hash.
MASS, MAP_BYTES, PROBES = 8_000_000, 16 << 20, 3
#: Characters that are hashed together, and phrases that a task of pass 2 counts before it hands them on.
CHUNK, HELD = 1_200_000, 200_000
UNDETERMINED = "und"

_P = np.uint64(0xD1342543DE82EF95)
_KIND = np.zeros(256, np.int8)                  # 0 part of a word, 1 ends a word, 2 ends a piece as well
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = [mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Words:
    """The words of some texts: bytes, places, pieces, texts and hashes."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray):
        self.data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[self.data]
        edge = np.diff((kind > 0).astype(np.int8), prepend=np.int8(1))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.end = self.end[len(self.end) - len(self.start):]
        self.piece = np.cumsum(kind == 2)[self.start]
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(first, self.start, side="right") - 1
        self.seed = seeds[self.text]

    def hashes(self, which: int = 0) -> np.ndarray:
        """Of each word: its bytes' values times powers of an odd base, summed up and mixed."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        size = self.end - self.start
        within = np.arange(len(self.data)) - np.repeat(np.append(0, self.start), np.diff(np.concatenate([[0], self.start, [len(self.data)]])))
        power = np.full(int(size.max()) + 1, _P, np.uint64)
        power[0] = 1
        with np.errstate(over="ignore"):
            power = np.cumprod(power)
            value = np.where(_KIND[self.data] == 0, _VALUES[which][self.data], np.uint64(0))
            value *= power[np.minimum(within, len(power) - 1)]
            return mixed(np.add.reduceat(value, self.start) + size.astype(np.uint64))

    def other(self, own: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
        """A second hash of the phrases of k words at these places, from the words' second hashes."""
        with np.errstate(over="ignore"):
            h = self.seed[at]
            for j in range(k):
                h = h * _P + own[at + j]
            return mixed(h)

    def phrases(self, longest: int):
        """(words, place of the first word, hash) for each length; the language's seed is part of the hash."""
        own = self.hashes()
        with np.errstate(over="ignore"):
            h = own * _P + self.seed
            at = np.arange(len(own))
            for k in range(1, longest + 1):
                if k > 1:
                    stay = at + (k - 1) < len(own)
                    at, h = at[stay], h[stay]
                    stay = self.piece[at] == self.piece[at + (k - 1)]
                    at, h = at[stay], h[stay]
                    h = h * _P + own[at + (k - 1)]
                yield k, at, mixed(h + np.uint64(k))


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _chunks(batches):
    """(texts, languages, their seeds) of about ``CHUNK`` characters each."""
    for batch in batches:
        texts, langs, size = [], [], 0
        for i in range(batch.num_rows):
            langs.append(batch.column(0)[i].as_py())
            texts.append(batch.column(1)[i].as_py().encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= CHUNK or i == batch.num_rows - 1:
                yield texts, langs, np.array([_seed(x) for x in langs], np.uint64)
                texts, langs, size = [], [], 0


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition, from the upper half of the hash (``parts`` below 2^32); the lower half tells hashes of a partition apart."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys as differences, byte by byte, so that a compressor finds the zeros of the upper bytes."""
    return np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64).astype(np.uint32)


def summaries(docs: DataFrame, parts: int, longest: int = LONGEST) -> DataFrame:
    """(part, mass, keys, counts): per stretch of text and hash partition the distinct hashes and how often each occurs."""
    def run(batches):
        for texts, _, seeds in _chunks(batches):
            words = Words(texts, seeds)
            h = np.sort(np.concatenate([x for _, _, x in words.phrases(longest)]))
            if not len(h):
                continue
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(first, len(h)))
            h = h[first]
            part, low = _part(h, parts), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.lexsort((low, part))
            part, low, n = part[order], low[order], n[order]
            border = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            rows: tuple[list, ...] = ([], [], [], [])
            for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
                for column, x in zip(rows, (int(part[a]), int(n[a:b].sum()), _pack(low[a:b]), n[a:b].astype("<u4").tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(
                rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "mass", "keys", "counts"])

    return docs.mapInArrow(run, "part bigint, mass bigint, keys binary, counts binary")


def merged(summary: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray, counts: np.ndarray,
           capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary (keys, counts, taken) and further counts; beyond ``capacity`` the least surplus is taken from all."""
    k, c, taken = summary
    k, c = np.concatenate([k, keys]), np.concatenate([c, counts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    k, c = k[first], np.add.reduceat(c, first) if len(first) else c
    if len(k) > capacity:
        surplus = int(np.partition(c, len(c) - capacity - 1)[len(c) - capacity - 1])
        c = c - surplus
        k, c, taken = k[c > 0], c[c > 0], taken + surplus
    return k, c, taken


def frequent(rows: DataFrame, threshold: int = THRESHOLD, spare: int = SPARE) -> DataFrame:
    """(part, keys): the hashes of every phrase that may reach the threshold."""
    def run(table: pa.Table) -> pa.Table:
        mass = sum(table.column("mass").to_pylist())
        capacity = spare * mass // threshold + 1
        summary = np.empty(0, np.uint32), np.empty(0, np.int64), 0
        held: tuple[list, list] = [], []
        size = 0
        pairs = zip(table.column("keys"), table.column("counts"))
        for i, (keys, counts) in enumerate(pairs):
            held[0].append(_unpack(keys.as_py()))
            held[1].append(np.frombuffer(counts.as_py(), "<u4").astype(np.int64))
            size += len(held[0][-1])
            if size >= max(capacity, 1 << 16) or i == table.num_rows - 1:
                summary = merged(summary, np.concatenate(held[0]), np.concatenate(held[1]), capacity)
                held, size = ([], []), 0
        keys, counts, taken = summary
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int64()),
                         pa.array([_pack(keys[counts + taken >= threshold])], pa.binary())], ["part", "keys"])

    return rows.groupBy("part").applyInArrow(run, "part bigint, keys binary")


def _groups(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first, number) of each distinct pair of hashes."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    if (np.minimum.reduceat(b, first) != np.maximum.reduceat(b, first)).any():          # equal in one hash only
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return order[first], np.diff(np.append(first, len(order)))


def exact_counts(docs: DataFrame, bitmap: bytes, parts: int, low: int, high: int, longest: int = LONGEST,
                 threshold: int = THRESHOLD) -> DataFrame:
    """(lang, phrase, f) of every phrase whose hash partition is from low to high - 1 and that reaches the threshold.

    The phrase '' carries the number of words of a language, in the round from partition 0.  A task puts equal phrases together by
    128 bits of hash and hands on one list of phrases and counts per hash partition; a partition's lists hold at most its
    occurrences, are merged list by list, and are compared as phrases.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def rows(found: dict) -> pa.RecordBatch:
        keys = sorted(found)                            # (part, language, line feed, phrase)
        part = np.array([k[0] for k in keys], np.int64)
        border = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        lists = lambda kind, values: pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[border[:-1]]), lists(pa.binary(), [k[1] for k in keys]), lists(pa.int64(), [found[k] for k in keys])],
            ["part", "phrases", "counts"])

    def run(batches):
        held = np.frombuffer(shared.value, np.uint8)
        slots, found = 8 * len(held), {}
        for texts, langs, seeds in _chunks(batches):
            words, names = Words(texts, seeds), [x.encode() + b"\n" for x in langs]
            if not low:
                for lang, n in zip(names, np.bincount(words.text, minlength=len(texts)).tolist()):
                    found[0, lang] = found.get((0, lang), 0) + n
            second = words.hashes(1)
            for k, at, h in words.phrases(longest):
                hit = np.arange(len(h))
                if (low, high) != (0, parts):
                    part = _part(h, parts)
                    hit = np.flatnonzero((part >= low) & (part < high))
                for probe in range(PROBES):
                    slot = _slot(h[hit], probe, slots)
                    hit = hit[held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0]
                if not len(hit):
                    continue
                order, n = _groups(h[hit], words.other(second, k, at[hit]))
                order = hit[order]
                for i, p, count in zip(at[order].tolist(), _part(h[order], parts).tolist(), n.tolist()):
                    phrase = b" ".join(words.data[a:b].tobytes() for a, b in zip(words.start[i:i + k].tolist(),
                                                                               words.end[i:i + k].tolist()))
                    key = p, names[words.text[i]] + phrase
                    found[key] = found.get(key, 0) + count
            if len(found) >= HELD:
                yield rows(found)
                found = {}
        if found:
            yield rows(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            keys, counts = batch.column("phrases").flatten().to_pylist(), batch.column("counts").flatten().to_pylist()
            for key, n in zip(keys, counts):
                total[key] = total.get(key, 0) + n
        out = [(*key.rpartition(b"\n")[::2], n) for key, n in total.items() if n >= threshold or key.endswith(b"\n")]
        text = lambda i: pa.array([x[i] for x in out], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([text(0), text(1), pa.array([x[2] for x in out], pa.int64())], ["lang", "phrase", "f"])

    counted = docs.mapInArrow(run, "part bigint, phrases array<binary>, counts array<bigint>")
    return counted.groupBy("part").applyInArrow(merge, "lang string, phrase string, f bigint")


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST,
                  threshold: int = THRESHOLD, spare: int = SPARE, mass: int = MASS, map_bytes: int = MAP_BYTES) -> DataFrame:
    """(lang, phrase, f): the exact count of every phrase that occurs ``threshold`` times; phrase '' has the words in all."""
    spark = docs.sparkSession
    ship_package(spark)
    used = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), text_of(text_col).alias("text"))
    # About the mass, for the number of hash partitions only: the capacity of a summary comes from the mass it has.
    total = longest * (used.agg(F.sum(F.octet_length("text") / 6)).first()[0] or 0)
    parts = max(1, int(total // mass))
    kept = cut(frequent(summaries(used, parts, longest), threshold, spare), "frequent")
    size = F.octet_length("keys") / 4
    held = kept.agg(F.sum(size)).first()[0] or 0
    slots = 1 << max(16, int(64 * held).bit_length() - 1)
    rounds = max(1, slots // (8 * map_bytes))
    found = None
    for r in range(rounds):
        low, high = parts * r // rounds, parts * (r + 1) // rounds
        if low < high:
            bitmap = _bitmap(kept.where(F.col("part").between(low, high - 1)), min(slots, 8 * map_bytes), parts)
            part = cut(exact_counts(used, bitmap, parts, low, high, longest, threshold), "counts")
            found = part if found is None else found.unionByName(part)
    return found


def _slot(h: np.ndarray, probe: int, slots: int) -> np.ndarray:
    """The slots of a hash, from its lower half."""
    low = h & np.uint64(0xFFFFFFFF)
    return (low * np.uint64((1, 0x9E3779B1, 0x85EBCA77)[probe]) >> np.uint64(5 * probe)) & np.uint64(slots - 1)


def _bitmap(kept: DataFrame, slots: int, parts: int) -> bytes:
    """The slots of the kept keys; ``slots`` bits, whatever the number of keys."""
    bits = min(slots, 1 << 15)

    def run(batches):
        for batch in batches:
            for raw in batch.column(1):
                keys = _unpack(raw.as_py()).astype(np.uint64)
                slot = np.unique(np.concatenate([_slot(keys, probe, slots) for probe in range(PROBES)])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot // bits, pa.int64()), pa.array(slot % bits, pa.int64())], ["block", "bit"])

    blocks = kept.mapInArrow(run, "block bigint, bit bigint").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(slots // 8, np.uint8)
    for block, raw in blocks.toLocalIterator():         # at most ``slots`` bits
        at = block * bits // 8
        out[at:at + bits // 8] = np.frombuffer(bytes(raw), np.uint8)[:bits // 8]
    return out.tobytes()


def score(a: str, n: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)) of long columns, exact: products of up to 38 digits, divided as whole numbers."""
    number = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    over = F.lit(1000).cast("decimal(4,0)") * number(a, 15) * number(n, 18)
    return F.floor((over - over % (number(l, 18) * number(r, 18))) / (number(l, 18) * number(r, 18))).cast("long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST,
                 threshold: int = THRESHOLD, share: int = SHARE, top: int = TOP, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` collocations of 2 to ``longest`` words.

    ``share``: a phrase goes if some longer phrase that holds it has this percentage of its count, at least.
    """
    counts = phrase_counts(docs, lang_col, text_col, longest, threshold, **sizes)
    total = counts.where("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counts.where("phrase != ''").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    phrases = known.where(F.size("w") > 1)
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    scored = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", score("a", "n", "l", "r").alias("score"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("c")).select(
        "lang", "phrase", "c.*")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = phrases.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stay = lowest.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < F.lit(share) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    return stay.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
