"""How far parameters moved between two checkpoints, over (param, idx, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(vectors: DataFrame, id_col: str = "vec_id", value_col: str = "embedding") -> DataFrame:
    return vectors.select(F.col(id_col).alias("param"), F.posexplode(value_col).alias("idx", "value")).withColumn("value", F.col("value").cast("double"))


def check_shapes(base: DataFrame, trained: DataFrame) -> None:
    n = lambda d: d.groupBy("param").agg(F.count("*").alias("n"))
    bad = n(base).join(n(trained).withColumnRenamed("n", "m"), "param", "full_outer").where("n is null or m is null or n <> m").orderBy("param").limit(20).collect()
    if bad:
        raise ValueError(f"Parameters differ in shape: {[(r['param'], r['n'], r['m']) for r in bad]}")


def tensor_change(base: DataFrame, trained: DataFrame) -> DataFrame:
    """param, numel, exactly_equal, changed_elements, mean and greatest absolute change, L2 change and its ratio to the base's norm (null for norm 0)."""
    j = base.join(trained.withColumnRenamed("value", "new"), ["param", "idx"]).withColumn("d", F.col("new") - F.col("value"))
    g = j.groupBy("param").agg(F.count("*").alias("numel"), F.min(F.col("d") == 0).alias("exactly_equal"), F.count(F.when(F.col("d") != 0, 1)).alias("changed_elements"), F.avg(F.abs("d")).alias("mean_absolute_change"), F.max(F.abs("d")).alias("max_absolute_change"),
                               F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2_change"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("base_norm"))
    return g.withColumn("relative_l2_change", F.when(F.col("base_norm") > 0, F.col("l2_change") / F.when(F.col("base_norm") > 0, F.col("base_norm")))).drop("base_norm")


def check_changed(change: DataFrame, allow_identical: bool = False) -> None:
    if not allow_identical and not change.where("not exactly_equal").limit(1).collect():
        raise ValueError("The parameters of both checkpoints are identical")
