"""Tables of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(left: DataFrame, one: DataFrame) -> DataFrame:
    """``left`` with the columns of ``one``, an aggregate of exactly one row, sent to every task."""
    return left.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")
