"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a fixed 50-bit hash of its id.  A mix takes, per source, all documents a whole number
of times plus those whose hash lies below a threshold.  The threshold comes from histograms: words summed by
(source, hash bucket) show in which bucket the budget ends, and only that boundary bucket is refined, 10 bits
at a time, until a bucket is a single hash.  No document is sorted, and thresholds of growing budgets nest: a
smaller mix of the same weights is contained in a larger one.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in
order; a source of size 0 has target 0; the document at the boundary is taken if that brings its source nearer to
the target (ties: taken); rows that repeat an id are taken or left together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewlens.llm.common import WORD, cut, text_of

HASH_BITS, STEP_BITS = 50, 10


def word_count(text: str | Column) -> Column:
    return F.size(F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))).cast("long")


def id_hash(id_col: str | Column) -> Column:
    """The first 50 bits of the MD5 of the id as text (null: of the empty text)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    head = F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    return F.shiftright(head.cast("long"), 2)


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """(__mx_source, source_size) -> + target: ``share`` of all words dealt by weight, at most ``most`` times a source.

    Sharing the excess again and again ends at a water level L with target = min(weight * L, cap): sources in order
    of cap / weight are full up to some rank, and the rest share what is left.  One row per source; windows
    over the list of sources only.
    """
    by_name = Window.orderBy(F.col("__mx_source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    listed = (sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
                   .withColumn("cap", F.col("source_size") * F.lit(float(most))))
    everything = Window.partitionBy()
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("__mx_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    listed = (listed.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
                    .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
                    .withColumn("level", (F.col("budget") - F.col("full")) / F.col("w_left")))
    # The first source in this order that is not full sets the level for all after it.
    listed = listed.withColumn("open_level", F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")))
    found = F.min_by("level", F.when(F.col("open_level").isNotNull(), F.col("cap") / F.col("w"))).over(everything)
    return listed.select("__mx_source", "source_size",
                         F.when(F.col("source_size") == 0, 0.0)
                          .when(found.isNull(), F.col("cap"))
                          .otherwise(F.least(F.col("w") * found, F.col("cap"))).alias("target"))


def thresholds(slim: DataFrame, need: DataFrame) -> DataFrame:
    """(__mx_source, need) -> (__mx_source, __mx_below): documents with a smaller hash are taken.

    ``slim``: __mx_source, __mx_hash, size.  Each step sums the words of the boundary range by sub-bucket; the sums
    of a source are at most 1024 rows, whatever its share of the data.
    """
    edge = need.select(F.col("__mx_source").alias("src"), F.col("need").alias("left"), F.lit(0).cast("long").alias("lo"))
    for step in range(HASH_BITS // STEP_BITS):
        shift = HASH_BITS - STEP_BITS * (step + 1)
        span = 1 << (shift + STEP_BITS)
        joined = slim.join(edge, slim["__mx_source"].eqNullSafe(edge["src"]))
        inside = joined.where((F.col("__mx_hash") >= F.col("lo")) & (F.col("__mx_hash") < F.col("lo") + span))
        sums = (inside.groupBy("src", "left", "lo", F.shiftright("__mx_hash", shift).alias("bucket"))
                      .agg(F.sum("size").alias("words")))
        until = F.sum("words").over(Window.partitionBy("src").orderBy("bucket"))
        first = (sums.withColumn("until", until).where("until > left")
                     .groupBy("src").agg(F.min_by(F.struct((F.col("left") - F.col("until") + F.col("words")).alias("left"),
                                                           F.col("bucket"), F.col("words")), "bucket").alias("b")))
        edge = cut(first.select("src", "b.left", F.shiftleft(F.col("b.bucket"), shift).alias("lo"), "b.words"),
                   "edge").select("src", "left", "lo", *(["words"] if shift == 0 else []))
    # The boundary is now one hash: in if that is nearer to the budget.
    return edge.select(F.col("src").alias("__mx_source"),
                       (F.col("lo") + (2 * F.col("left") >= F.col("words")).cast("long")).alias("__mx_below"))


def _plan(slim: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: source_size, target, the whole times its documents are taken, and the threshold."""
    sizes = slim.groupBy("__mx_source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("times", whole.cast("long"))
    need = goal.select("__mx_source", (F.col("target") - F.col("times") * F.col("source_size")).alias("need"))
    below = thresholds(slim, need).withColumnRenamed("__mx_source", "__mx_s")
    plan = goal.join(below, F.col("__mx_source").eqNullSafe(F.col("__mx_s")), "left")
    return cut(plan.select(F.col("__mx_source").alias("__mx_s"), F.col("source_size").alias("__mx_size"),
                           F.col("target").alias("__mx_target"), F.col("times").alias("__mx_whole"),
                           F.coalesce("__mx_below", F.lit(0).cast("long")).alias("__mx_below")), "plan")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("__mx_id"), F.col(source_col).alias("__mx_source"),
                           word_count(text_col).alias("size"), id_hash(id_col).alias("__mx_hash")), "sizes")


def _times(most: float) -> Column:
    return F.least(F.col("__mx_whole") + (F.col("__mx_hash") < F.col("__mx_below")).cast("long"), F.lit(int(most)).cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken, times."""
    slim = _slim(docs, id_col, text_col, source_col)
    out = slim.join(_plan(slim, weights, share, most), F.col("__mx_source").eqNullSafe(F.col("__mx_s")))
    return out.select(F.col("__mx_id").alias(id_col), "size", F.col("__mx_size").alias("source_size"),
                      F.col("__mx_target").alias("target"), (F.col("size") * _times(most)).alias("taken"),
                      _times(most).alias("times"))


def resample(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns (none beginning with ``__mx_``)."""
    plan = _plan(_slim(docs, id_col, text_col, source_col), weights, share, most)
    out = (docs.withColumn("__mx_hash", id_hash(id_col))
               .join(plan, F.col(source_col).eqNullSafe(F.col("__mx_s"))).withColumn("__mx_times", _times(most)))
    return out.where("__mx_times > 0").withColumn("__mx_n", F.explode(F.sequence(F.lit(1), F.col("__mx_times").cast("int")))
                                                  ).select(*docs.columns)
