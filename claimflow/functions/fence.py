"""A boundary the optimizer does not move filters and formulas across."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """The same rows, with the columns that are read above computed here and once.

    A filter above a chain of projections is pushed below them by writing each column's formula
    out in full. Over phases whose columns mention each other many times that grows without
    bound. A generator of one row per row stops it: what lies above refers to columns, not to
    formulas. No filter passes it, as its one value (the number of the partition) is not
    deterministic. The columns go past the generator and not through it, so those that nothing
    above reads are not computed, and no row is copied for it.
    """
    names = df.columns
    return df.select("*", F.explode(F.array(F.spark_partition_id())).alias("_settled")).select(*names)
