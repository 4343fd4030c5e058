"""Exact top-k by inner product, term at a time.

Vectors are sparse rows of integers (term = position, weight = value; weight 0 is no posting).  Queries and candidates are
dealt into blocks by a hash of their id, and every query block meets every candidate block in one task: for each
term, the queries that hold it scatter weight times posting into a dense score array (queries x candidates of the
block); partition selection keeps each query's k best of the block, and the blocks' results are merged by rank.  The work is
exhaustive, so nothing is approximated, and a task holds one block pair whatever the table's size.

Defined results: null vectors, and vectors holding a null, NaN or infinite component, take no part; an empty vector scores
0 with all; vectors of different lengths meet in the positions both have; a query never meets rows of its own id; rows that repeat an id are
candidates of their own, while of queries that repeat an id the smallest vector asks; a null id takes no part; ties go to the smaller
id; scores outside a long are cut to its range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewlens.llm.common import cut, ship_package

LONG = 2 ** 63


def quantised(vec: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null for vectors that take no part."""
    x = F.col(vec).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


class Postings:
    """The posting lists of a block of sparse rows: per term the rows that hold it and their weights.

    ``values`` are the rows' weights one after the other, ``starts`` where each row begins.  A term that most rows hold is
    kept as one weight per row, in which a weight of zero adds nothing.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        self.rows, self.top = len(starts) - 1, int(np.abs(values).max(initial=0))
        row = np.repeat(np.arange(self.rows), np.diff(starts))
        term = np.arange(len(values)) - np.repeat(starts[:-1], np.diff(starts))
        held = np.flatnonzero(values)
        order = held[np.argsort(term[held], kind="stable")]
        self.terms = int(np.diff(starts).max(initial=0))
        border = np.searchsorted(term[order], np.arange(self.terms + 1))
        self.lists = []
        for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
            at, weight = row[order[a:b]], values[order[a:b]]
            if 2 * len(at) > self.rows:
                full = np.zeros(self.rows, values.dtype)
                full[at] = weight
                at, weight = None, full
            self.lists.append((at, weight))


def block_scores(queries: Postings, candidates: Postings) -> np.ndarray:
    """Inner products (queries x candidates), accumulated term by term; exact for any integers."""
    terms = min(queries.terms, candidates.terms)
    kind = np.int64 if queries.top * candidates.top * max(terms, 1) < LONG else object
    out = np.zeros((queries.rows, candidates.rows), kind)
    for (ask, w), (hold, posting) in zip(queries.lists, candidates.lists):
        if not len(w) or not len(posting):
            continue
        part = np.multiply.outer(w.astype(kind), posting.astype(kind))
        if ask is None and hold is None:
            out += part
        elif hold is None:
            out[ask] += part
        elif ask is None:
            out[:, hold] += part
        else:
            out[np.ix_(ask, hold)] += part
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places of each query's k best scores, ties to the smaller id, without rows of its ``own`` id."""
    other = ids[None, :] != own[:, None]
    if scores.dtype == object:
        found = [(q, j) for q in range(len(own)) for j in sorted(
            np.flatnonzero(other[q]).tolist(), key=lambda j: (-scores[q, j], ids[j]))[:k]]
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)
    scores = np.where(other, scores, -LONG)             # no sum is as low: block_scores keeps them above
    if scores.shape[1] > k:
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        query, at = np.nonzero(other & (scores >= bound[:, None]))
    else:
        query, at = np.nonzero(other)
    order = np.lexsort((ids[at], -scores[query, at], query))
    query, at = query[order], at[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], at[rank < k]


def top_k(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 5, block: int = 2048,
          query_block: int = 4096, slice_: int = 512) -> DataFrame:
    """(query_id, rank, id, score) of each query's k best rows; ``vec_col`` holds integer arrays (null: no part).

    A candidate crosses the shuffle once per query block and a query once per candidate block.  Scores are held for
    ``slice_`` queries of a block at a time.
    """
    candidates = cut(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("v"))
                         .where("id is not null and v is not null"), "candidates")
    asked = cut(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("v"))
                       .where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, q = (max(1, math.ceil(x.count() / size)) for x, size in ((candidates, block), (asked, query_block)))
    spread = lambda df, own, other, m, width: (
        df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(m)))
          .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))))
    left = spread(asked, "qb", "cb", q, n).select("qb", "cb", "id", "v")
    right = spread(candidates, "cb", "qb", n, q).select("qb", "cb", "id", "v")

    def postings(table: pa.Table) -> Postings:
        v = table.column("v").combine_chunks()
        return Postings(v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy())]))

    def meet(key, ask: pa.Table, hold: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if ask.num_rows and hold.num_rows:
            ids, held = hold.column("id").to_numpy(), postings(hold)
            for at in range(0, ask.num_rows, slice_):
                part = ask.slice(at, slice_)
                own, scores = part.column("id").to_numpy(), block_scores(postings(part), held)
                query, best = best_of(scores, ids, own, k)
                out[0].append(own[query])
                out[1].append(ids[best])
                out[2].append(np.array([max(-LONG, min(LONG - 1, int(x))) for x in scores[query, best]], np.int64))
        join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        return pa.table([join(x) for x in out], ["query_id", "id", "score"])

    ship_package(rows.sparkSession)
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(
        meet, "query_id bigint, id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
