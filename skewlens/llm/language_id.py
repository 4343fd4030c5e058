"""Language identification by multilingual mixture inference.

Training counts letter-centred character trigrams (hashed to ``buckets``) per language over all labelled rows.
Each document is then a mixture of languages: expectation-maximisation estimates the shares from the
likelihoods of its trigrams, and the language set grows from the best single language: each step tries every other
language and adds the one whose log likelihood gains most, as long as it gains more than ``penalty * ln(trigrams)``.  EM
runs until the likelihood settles; a language is left untried only where a bound shows that it cannot gain enough.  The
predicted language has the largest share in the chosen set, and the score is that share.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text when nothing was
learned; ties between languages go to the smaller name by code point; repeated rows get the same answer; rows with null
language or text teach nothing; whole texts are read, whatever their length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.llm.common import fresh, ship_package

UNDETERMINED = "und"
#: Letters looked at together; texts are cut into calls of about this size, and longer ones stand alone.
CHUNK = 200_000
_ALPHA: np.ndarray | None = None


@dataclass
class LanguageModel:
    """Trigram likelihoods: ``p[bucket, language]``; its size is buckets x languages x 8 bytes."""
    languages: list[str]
    p: np.ndarray


def _letters(codes: np.ndarray) -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA[codes]


def trigrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, bucket) of each letter with its two neighbours; other characters count as one space."""
    flat = "\0".join(t.lower().replace("\0", " ") for t in texts)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = _letters(codes)
    doc = np.cumsum(codes == 0)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    before, after = np.roll(codes, 1), np.roll(codes, -1)
    before[0] = after[-1] = 32
    mixed = (before * np.uint64(0x9E3779B1) + codes) * np.uint64(0x85EBCA77) + after
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(40)) % np.uint64(buckets)
    return doc[letter], bucket[letter].astype(np.int64)


def _chunks(texts: Iterator[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first number, texts) of neighbours that hold about CHUNK characters."""
    held, size, first, n = [], 0, 0, 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > CHUNK:
            yield first, held
            held, size, first = [], 0, n
        held.append(t)
        size += len(t)
        n += 1
    if held:
        yield first, held


def count_trigrams(rows: DataFrame, lang_col: str, text_col: str, buckets: int) -> DataFrame:
    """(lang, bucket, n) over all rows with a language and a text."""
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in fresh(batches):
            langs = batch.column(0).to_pylist()
            for first, texts in _chunks(t.as_py() for t in batch.column(1)):
                doc, bucket = trigrams(texts, buckets)
                own = langs[first:first + len(texts)]
                names = sorted(set(own))
                number = np.array([names.index(x) for x in own], np.int64)
                sums = np.bincount(number[doc] * buckets + bucket, minlength=len(names) * buckets)
                for i, name in enumerate(names):
                    part = sums[i * buckets:(i + 1) * buckets]
                    total[name] = total[name] + part if name in total else part.copy()
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(sums[at], pa.int64())], ["lang", "bucket", "n"])

    ship_package(rows.sparkSession)
    used = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return (used.mapInArrow(count, "lang string, bucket int, n bigint")
                .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = 1 << 15,
          smoothing: float = 0.5) -> LanguageModel:
    """Fit on all labelled rows.  What reaches the driver is at most ``buckets`` rows per language."""
    counts = count_trigrams(rows, lang_col, text_col, buckets).toPandas()
    languages = sorted(counts["lang"].unique())
    c = np.zeros((buckets, len(languages)))
    at = {name: i for i, name in enumerate(languages)}
    c[counts["bucket"].to_numpy(np.int64), counts["lang"].map(at).to_numpy(np.int64)] = counts["n"].to_numpy()
    p = (c + smoothing) / (c.sum(axis=0) + smoothing * buckets) if languages else c
    return LanguageModel([str(x) for x in languages], p)


def shares(p: np.ndarray, weight: np.ndarray, tolerance: float, least: float = -np.inf) -> tuple[np.ndarray, float]:
    """(mixture weights of the columns of ``p``, log likelihood) by EM until it settles; -inf once it cannot reach ``least``."""
    mix, total, seen = np.full(p.shape[1], 1.0 / p.shape[1]), weight.sum(), -np.inf
    for n in itertools.count(1):
        each = p @ mix
        slope = (weight / each) @ p
        short = slope.max() - total                     # concave: the largest likelihood is not farther away than this
        if short <= tolerance or n & (n - 1) == 0:
            value = float(weight @ np.log(each))
            if short <= tolerance or value - seen <= tolerance:
                return mix, value
            if value + short < least:
                return mix, -np.inf
            seen = value
        mix = mix * slope
        mix /= mix.sum()


def infer(p: np.ndarray, weight: np.ndarray, penalty: float, tolerance: float = 1e-6) -> tuple[int, float]:
    """(language number, share) of a document from the likelihoods ``p`` of its trigrams."""
    alone = weight @ np.log(p)
    chosen, best, mix = [int(np.argmax(alone))], float(alone.max()), np.ones(1)
    total = weight.sum()
    cost = penalty * np.log(total + 1)
    while len(chosen) < p.shape[1]:
        slope = (weight / (p[:, chosen] @ mix)) @ p
        added, least = None, best + cost
        for k in (int(i) for i in np.argsort(-slope, kind="stable") if i not in chosen):
            if best + max(slope[k] - total, slope[chosen].max() - total) < least:     # nor can those after it gain enough
                break
            wider, gained = shares(p[:, [*chosen, k]], weight, tolerance, least)
            if gained > least or (added and gained == least and k < added[0]):
                added, least = (k, wider), gained
        if added is None:
            break
        chosen, mix, best = [*chosen, added[0]], added[1], least
    top = max(range(len(chosen)), key=lambda i: (mix[i], -chosen[i]))
    return chosen[top], float(mix[top])


def identify(model: LanguageModel, spark, penalty: float = 3.0, tolerance: float = 1e-6):
    """A column function: text -> struct(lang, score)."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m: LanguageModel = shared.value
        for texts in fresh(series):
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for first, some in _chunks(iter(texts)) if m.languages else ():
                doc, bucket = trigrams(some, len(m.p))
                ends = np.searchsorted(doc, np.arange(len(some) + 1))
                for i in np.flatnonzero(np.diff(ends)):
                    own = bucket[ends[i]:ends[i + 1]]
                    if len(own) > 20_000:       # a long text repeats its trigrams
                        own, weight = np.unique(own, return_counts=True)
                    else:
                        weight = np.ones(len(own))
                    k, score[first + i] = infer(m.p[own], weight.astype(float), penalty, tolerance)
                    lang[first + i] = m.languages[k]
            yield pd.DataFrame({"lang": lang, "score": np.clip(score, 0, 1)})

    return predict


def held_out(id_col: str | Column, modulus: int = 4, remainder: int = 2) -> Column:
    """Whether the checksum of the id as text falls into the fold that never teaches (a null id never does)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learn_fold(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    return learn(docs.where(~held_out(id_col)), lang_col, text_col)
