"""Judge scores of raw records.

A record's evaluations are nested in its row, so everything up to the pair is computed inside the row by array functions: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.stats import exact_sum, finite
from prefloom.functions.text import stripped


def judge_stats(judgments: Column) -> Column:
    """Array of (judge, mean, repeat_std, valid_attempts) of a list of judgments.

    Only successful judgments of a named judge count. Their finite attempts are averaged; without any, the reported average and
    deviation stand in; without either, the judgment is missing. A judge's later judgment replaces an earlier one.
    """
    named = F.filter(F.coalesce(judgments, F.array()), lambda j: j.isNotNull() & (F.lower(j["status"]) == "success") & (stripped(j["judge_model"]) != ""))

    def shape(j: Column) -> Column:
        xs = F.filter(F.transform(F.coalesce(j["scores"], F.array()), lambda s: finite(s["judge_score"])), lambda x: x.isNotNull())
        return F.struct(stripped(j["judge_model"]).alias("judge"), xs.alias("xs"), finite(j["score_avg"]).alias("avg"), finite(j["score_std"]).alias("std"))

    def mean(v: Column) -> Column:
        n = F.size(v["xs"])
        return F.struct(v["judge"].alias("judge"), v["xs"].alias("xs"), v["std"].alias("std"), F.when(n > 0, exact_sum(v["xs"]) / F.greatest(n, F.lit(1))).otherwise(v["avg"]).alias("mean"))

    def result(v: Column) -> Column:
        n = F.size(v["xs"])
        spread = F.sqrt(exact_sum(F.transform(v["xs"], lambda x: (x - v["mean"]) * (x - v["mean"]))) / F.greatest(n, F.lit(1)))
        return F.struct(v["judge"].alias("judge"), v["mean"].alias("mean"), F.when(n > 1, spread).when(n == 1, F.lit(0.0)).otherwise(F.coalesce(v["std"], F.lit(0.0))).alias("repeat_std"), n.cast("double").alias("valid_attempts"))

    valued = F.transform(F.filter(F.transform(F.transform(named, shape), mean), lambda v: v["mean"].isNotNull()), result)
    # bound to a variable, so that it is computed once and not for each element
    last = lambda all_: F.filter(all_, lambda v, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda w: w["judge"] == v["judge"]))
    return F.element_at(F.transform(F.array(valued), last), 1)


def expected_judges(evaluations: Column) -> Column:
    """Number of distinct judges named anywhere in a record, whatever the status."""
    lists = F.transform(F.coalesce(F.map_values(evaluations), F.array()), lambda e: F.transform(F.filter(F.coalesce(e["judgments"], F.array()), lambda j: j.isNotNull()), lambda j: stripped(j["judge_model"])))
    return F.size(F.filter(F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull()))), lambda x: x.isNotNull() & (x != "")))


def judge_scores(raw: DataFrame) -> DataFrame:
    """row_no, source, judge, mean, repeat_std, valid_attempts."""
    e = raw.select("row_no", F.explode(F.map_entries("evaluations")).alias("e"))
    return e.select("row_no", F.col("e.key").alias("source"), F.explode(judge_stats(F.col("e.value")["judgments"])).alias("s")).select("row_no", "source", "s.*")
