"""A training corpus from ``documents``: STAGES in order, each over all rows its predecessor kept.

Every stage gives an empty table for an empty table, keeps further columns as they are, and but for the last returns the
columns it was given (names that begin with ``__`` are the stages' own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.llm import exact_dedup, language_id, mixture, near_dedup, sentencepiece
from skewlens.llm.common import cut, table
from skewlens.llm.queries import PIECES, tokenizer_file

#: A document goes if its language is undetermined or the largest language has less than this share.
LEAST_SHARE = 0.4


#: Whole texts are long: so many rows, not Spark's ten thousand, go to a Python worker at once.
ARROW_ROWS = 1000


def _in_small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; a null or empty text and one without letters go, rows that repeat an id are judged each."""
    _in_small_batches(spark)
    guess = language_id.identify(language_id.learn_fold(docs), spark)
    named = docs.withColumn("__guess", guess("text"))
    return named.where((F.col("__guess.lang") != language_id.UNDETERMINED) & (F.col("__guess.score") >= LEAST_SHARE)
                       ).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id; null counts as empty, repeated rows leave one."""
    return exact_dedup.drop_duplicates_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id; a text without words is a class of its own."""
    _in_small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a document appears as often as its source's target takes it; a null source is a source, a text without
    words has size 0 and may appear or not."""
    return mixture.resample(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``piece_ids`` and ``n_pieces``; what does not decode to its own text would go.  A null text has no pieces.

    Columns of these two names are replaced.
    """
    _in_small_batches(spark)
    v = sentencepiece.read_vocabulary(tokenizer_file(spark, PIECES))
    return sentencepiece.encode(docs, v, lossless=True).withColumn("n_pieces", F.size("piece_ids"))


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixture", mixed), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
