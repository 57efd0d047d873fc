"""A corpus pipeline over ``documents``: quality, exact copies, near copies, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimflow.llm import exact_dedup, jaccard, mixing, packing, quality
from claimflow.llm.common import stored
from claimflow.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns.

    Null and empty texts are scored like any other text; equal rows stand or fall together. With nothing to
    learn from, every document scores 0.5 and stays. No documents give none.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after lower-casing A-Z, the row with the largest id, with all its columns.

    Null and empty texts are one text. A null id is the smallest; of rows that tie in the id one stays.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the rows with the smallest id, with all their columns.

    Texts without words, null texts and rows without an id are near copies of nothing and stay.
    """
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row for each unbroken run of blocks, with all other columns.

    A document may come up to twice or in part. Documents without words fill no block and go. A null source
    is a source of its own. Rows that repeat each other each take part.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences of at most 1024 tokens; a null or empty text is its end token alone."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mix", mix_sources), ("pack", pack_sequences)]

#: Training, hashing into sets and pseudorandom permutations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
