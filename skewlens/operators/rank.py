"""A global rank without a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.session import written

_WITHIN = (1 << 33) - 1         # Spark numbers rows from partition id << 33


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in the whole table under ``order``, from 1 (long).

    The rows are sorted into range partitions and written once with their place in their partition; the rank is that place plus
    the rows of the partitions before it.  Only the partitions' row counts, one number each, pass the driver.  Rows that are equal in
    the order get different ranks; give a total order for a result that does not depend on how the rows are dealt.
    """
    spark = df.sparkSession
    placed = written(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit(_WITHIN))
    counts = dict(placed.groupBy(part.alias("part")).count().collect())
    before, rows = [], 0
    for p in sorted(counts):
        before.append((p, rows))
        rows += counts[p]
    offsets = spark.createDataFrame(before, "_part bigint, _before bigint")
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")       # one row per range partition
    return ranked.select(*df.columns, (F.col("_before") + within + 1).alias(name))
