"""Summaries of evaluated pairs, comparisons of two models on the same pairs, and intervals by resampling prompts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.rows import beside
from prefloom.functions.stats import close, mcnemar, positive, wilson
from prefloom.functions.text import margin_bucket
from prefloom.operators.audit import check_same_keys, check_unique


#: Half the width of the share of rows around the middle that are ranked exactly, and the accuracy of the sketch that finds them.
MIDDLE, ACCURACY = 0.001, 10_000


def medians(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by`` and ``median`` of ``value``, exact, for groups of any size: a mergeable sketch bounds the middle of each group, the rows below are only
    counted, and the distinct values within the bounds (about one row in 500) are ranked."""
    one = [F.lit(1).alias("_g")] if not by else []
    v = rows.where(F.col(value).isNotNull()).select(*by, *one, F.col(value).alias("v"))
    keys = list(by) or ["_g"]
    q = v.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", [0.5 - MIDDLE, 0.5 + MIDDLE], ACCURACY).alias("q"))
    # a value of the sketch is off by at most n / ACCURACY ranks, far less than MIDDLE * n; of few rows it is exact, but the two middle ones are wanted
    small = F.col("n") < 2 * ACCURACY
    lo, hi = F.when(small, F.lit(float("-inf"))).otherwise(F.col("q")[0]), F.when(small, F.lit(float("inf"))).otherwise(F.col("q")[1])
    bounds = q.select(*keys, "n", lo.alias("lo"), hi.alias("hi"))
    c = v.join(bounds, keys).groupBy(*keys, "n", F.when((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), F.col("v")).otherwise(F.when(F.col("v") < F.col("lo"), F.lit(float("-inf")))).alias("at")).agg(F.count("*").alias("c")).where("at is not null")
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("at"))
    ranked = c.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("c"))
    holds = lambda k: (F.col("first") <= k) & (F.col("upto") > k)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    m = ranked.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("at"))).alias("x"), F.max(F.when(holds(high), F.col("at"))).alias("y"))
    return m.select(*by, ((F.col("x") + F.col("y")) / 2).alias("median"))


def subgroups(details: DataFrame, groupings: dict[str, Column | None]) -> DataFrame:
    """grouping, label and the metrics of every group of every grouping in one pass (a grouping of None is the whole): n, unique_prompts, correct,
    ties, accuracy with its interval, the mean over prompts, margins and log-probabilities.

    Sums are formed per group and prompt first; from these come counts of prompts and means over prompts without a second shuffle of the rows.
    """
    tags = F.array(*[F.struct(F.lit(k).alias("grouping"), (F.lit(None).cast("string") if c is None else c.cast("string")).alias("label")) for k, c in groupings.items()])
    rows = details.select("prompt_id", "correct", "tie", "model_margin", "chosen_logprob_per_token", "rejected_logprob_per_token", F.explode(tags).alias("t")).select("t.*", "*").drop("t").withColumn("label", F.coalesce("label", F.lit("")))
    ok = F.col("correct").cast("int")
    per = rows.groupBy("grouping", "label", "prompt_id").agg(
        F.count("*").alias("n"), F.sum(ok).alias("ok"), F.sum(F.col("tie").cast("int")).alias("ties"), F.avg(ok).alias("share"), F.sum("model_margin").alias("m"), F.sum(F.col("model_margin") * F.col("model_margin")).alias("m2"),
        F.sum("chosen_logprob_per_token").alias("c"), F.sum("rejected_logprob_per_token").alias("r"))
    n = F.sum("n")
    one = per.groupBy("grouping", "label").agg(
        n.alias("n"), F.count("prompt_id").alias("unique_prompts"), F.sum("ok").cast("bigint").alias("correct"), F.sum("ties").cast("bigint").alias("ties"), (F.sum("ok") / n).alias("preference_accuracy"), (F.sum("m") / n).alias("mean_model_margin"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("m2") / n - F.pow(F.sum("m") / n, 2))).alias("model_margin_std"), (F.sum("c") / n).alias("mean_chosen_logprob_per_token"), (F.sum("r") / n).alias("mean_rejected_logprob_per_token"), F.avg("share").alias("prompt_macro_accuracy"))
    lo, hi = wilson(F.col("correct"), F.col("n"))
    return one.join(medians(rows, ["grouping", "label"], "model_margin").withColumnRenamed("median", "median_model_margin"), ["grouping", "label"], "left").withColumns({"accuracy_wilson_lo": lo, "accuracy_wilson_hi": hi})


def all_subgroups(details: DataFrame) -> DataFrame:
    """``subgroups`` of an evaluation: overall and by confidence, comparison type and margin bucket."""
    return subgroups(details, {"overall": None, "label_confidence": F.col("label_confidence"), "comparison_type": F.col("comparison_type"), "label_margin_bucket": margin_bucket(F.col("label_margin"))})


def metrics(details: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The metrics of ``subgroups`` per group of one column, or of all rows."""
    key = by[0] if by else "overall"
    out = subgroups(details, {key: F.col(key) if by else None}).drop("grouping")
    if by:
        return out.withColumnRenamed("label", key)
    counts = ("n", "unique_prompts")  # one row, also of no rows
    return out.drop("label").agg(*[(F.coalesce(F.max(c), F.lit(0)) if c in counts else F.max(c)).alias(c) for c in out.columns if c != "label"])


def by_margin_bucket(details: DataFrame) -> DataFrame:
    return metrics(details.withColumn("label_margin_bucket", margin_bucket(F.col("label_margin"))), ["label_margin_bucket"])


def check_comparable(base: DataFrame, other: DataFrame, beta: float) -> None:
    """Unique and equal pair ids, a positive beta, the needed columns, and equal token counts."""
    if beta <= 0:
        raise ValueError("beta must be positive")
    needed = {"pair_id", "prompt_id", "correct", "model_margin", "chosen_logprob_sum", "rejected_logprob_sum", "chosen_token_count", "rejected_token_count"}
    missing = sorted((needed - set(base.columns)) | (needed - set(other.columns)))
    if missing:
        raise ValueError(f"Columns that the comparison needs are missing: {missing}")
    check_unique(base)
    check_unique(other)
    check_same_keys(base, other)
    bad = token_mismatches(base, other).limit(1).collect()
    if bad:
        raise ValueError(f"The two models disagree on the token counts of pair {bad[0]['pair_id']}")


def token_mismatches(base: DataFrame, other: DataFrame) -> DataFrame:
    b, o = base.alias("b"), other.alias("o")
    return b.join(o, "pair_id").where("b.chosen_token_count <> o.chosen_token_count or b.rejected_token_count <> o.rejected_token_count").select("pair_id")


def relative_details(base: DataFrame, other: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row per pair: the candidate's margins relative to the baseline."""
    b = base.select("pair_id", "prompt_id", F.col("correct").alias("b_ok"), F.col("model_margin").alias("b_m"), F.col("chosen_logprob_sum").alias("b_c"), F.col("rejected_logprob_sum").alias("b_r"))
    o = other.select("pair_id", F.col("correct").alias("o_ok"), F.col("model_margin").alias("o_m"), F.col("chosen_logprob_sum").alias("o_c"), F.col("rejected_logprob_sum").alias("o_r"))
    j = b.join(o, "pair_id").withColumns({"chosen_policy_logratio": F.col("o_c") - F.col("b_c"), "rejected_policy_logratio": F.col("o_r") - F.col("b_r")})
    m = F.lit(beta) * (F.col("chosen_policy_logratio") - F.col("rejected_policy_logratio"))
    return j.select("pair_id", "prompt_id", F.col("b_ok").alias("baseline_correct"), F.col("o_ok").alias("candidate_correct"), (F.col("o_ok").cast("int") - F.col("b_ok").cast("int")).cast("double").alias("absolute_accuracy_delta"),
                    F.col("b_m").alias("baseline_model_margin"), F.col("o_m").alias("candidate_model_margin"), (F.col("o_m") - F.col("b_m")).alias("absolute_margin_delta"), "chosen_policy_logratio", "rejected_policy_logratio",
                    m.alias("implicit_reward_margin"), positive(m).alias("implicit_reward_correct"), close(m, 1e-12).alias("implicit_reward_tie"),
                    (~close(F.col("chosen_policy_logratio"), 1e-8) | ~close(F.col("rejected_policy_logratio"), 1e-8)).alias("behavior_changed"))


def compare(rel: DataFrame) -> DataFrame:
    """One row with all aggregates of ``relative_details``."""
    num = lambda c: F.col(c).cast("double")
    cnt = lambda c: F.count(F.when(c, 1))
    b, o = F.col("baseline_correct"), F.col("candidate_correct")
    one = rel.agg(
        F.count("*").alias("paired_n"), F.countDistinct("prompt_id").alias("unique_prompts"), cnt(F.col("implicit_reward_correct")).alias("implicit_correct"), F.avg(num("implicit_reward_correct")).alias("implicit_reward_accuracy"),
        F.avg("implicit_reward_margin").alias("mean_implicit_reward_margin"), cnt(F.col("implicit_reward_tie")).alias("ties"),
        F.avg(num("baseline_correct")).alias("baseline_preference_accuracy"), F.avg(num("candidate_correct")).alias("candidate_preference_accuracy"),
        F.avg("baseline_model_margin").alias("mean_model_margin_baseline"), F.avg("candidate_model_margin").alias("mean_model_margin_candidate"), F.avg("absolute_margin_delta").alias("mean_model_margin_delta"),
        cnt(b & ~o).alias("baseline_correct_candidate_wrong"), cnt(~b & o).alias("baseline_wrong_candidate_correct"), cnt(F.col("behavior_changed")).alias("pairs_changed"),
        F.avg(F.abs("chosen_policy_logratio")).alias("mean_abs_chosen_policy_logratio"), F.avg(F.abs("rejected_policy_logratio")).alias("mean_abs_rejected_policy_logratio"))
    per = rel.groupBy("prompt_id").agg(*[F.avg(num(c)).alias(c) for c in ("implicit_reward_correct", "baseline_correct", "candidate_correct", "absolute_accuracy_delta")])
    macro = per.agg(F.avg("implicit_reward_correct").alias("implicit_reward_prompt_macro_accuracy"), F.avg("baseline_correct").alias("baseline_prompt_macro_accuracy"), F.avg("candidate_correct").alias("candidate_prompt_macro_accuracy"), F.avg("absolute_accuracy_delta").alias("prompt_macro_accuracy_delta"))
    lo, hi = wilson(F.col("implicit_correct"), F.col("paired_n"))
    middle = medians(rel, [], "implicit_reward_margin").agg(F.max("median").alias("median_implicit_reward_margin"))  # one row, also of no rows
    return beside(beside(one, macro), middle).withColumns({"implicit_reward_wilson_lo": lo, "implicit_reward_wilson_hi": hi, "accuracy_delta": F.col("candidate_preference_accuracy") - F.col("baseline_preference_accuracy"),
                                             "mcnemar_p": mcnemar(F.col("baseline_correct_candidate_wrong"), F.col("baseline_wrong_candidate_correct")), "all_pairs_changed": F.col("pairs_changed") == F.col("paired_n")})


def prompt_means(rows: DataFrame, value: Column, max_prompts: int = 2_000_000) -> DataFrame:
    """One row with the means per prompt as an array in the order of prompt ids, for draws that other engines repeat. Its size is that of
    the evaluation's prompts; beyond ``max_prompts`` use ``bootstrap``."""
    per = rows.groupBy("prompt_id").agg(F.avg(value).alias("m"))
    n = per.count()
    if n > max_prompts:
        raise ValueError(f"{n} prompts are too many for one array; use bootstrap")
    return per.agg(F.sort_array(F.collect_list(F.struct("prompt_id", "m"))).alias("a")).select(F.transform("a", lambda x: x["m"]).alias("means"), F.size("a").alias("p"))


def _interval(estimates: DataFrame, samples: int) -> DataFrame:
    """lo, hi of the column ``e`` of ``samples`` rows: lower order statistics, no interpolation."""
    k = lambda q: int(q * (samples - 1))
    ordered = estimates.agg(F.sort_array(F.collect_list("e")).alias("e")).where(F.size("e") > 0)
    return ordered.select(F.get("e", F.lit(k(0.025))).alias("lo"), F.get("e", F.lit(k(0.975))).alias("hi"))


#: Prompts of a slice of the resampling, on average, and draws made at a time.
SLICE, DRAWS = 20_000, 1 << 22


def bootstrap(rows: DataFrame, value: Column, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """lo, hi: 95 per cent interval of the mean over prompts by resampling prompts; lower order statistics, no interpolation.

    For any number of prompts: a hash puts each into a slice; how many of a replicate's draws fall into which slice is multinomial, and each
    slice makes its own draws and sums them. Draws depend on seed, slice and the prompts in it alone, not on the partitioning.
    """
    per = rows.groupBy("prompt_id").agg(F.avg(value).alias("m")).where("prompt_id is not null and m is not null")
    p = per.count()
    slices = max(1, -(-p // SLICE))
    per = per.withColumn("slice", F.pmod(F.xxhash64("prompt_id"), F.lit(slices)).cast("int"))
    sizes = {r["slice"]: r["count"] for r in per.groupBy("slice").count().collect()}  # one row per SLICE prompts
    order = sorted(sizes)

    def draw(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        k = order.index(int(key[0]))
        # every slice derives the same split of draws: conditional binomials over the slices before it
        g, left, rest = np.random.default_rng([seed, 0]), np.full(samples, p, np.int64), p
        for s in order[:k + 1]:
            mine = g.binomial(left, min(1.0, sizes[s] / rest)) if rest else left * 0
            left, rest = left - mine, rest - sizes[s]
        m = f.sort_values("prompt_id")["m"].to_numpy(float)
        g, total, done = np.random.default_rng([seed, 1, int(key[0])]), np.zeros(samples), 0
        step = max(1, DRAWS // max(1, int(mine.mean()) + 1))
        while done < samples:
            n = mine[done:done + step]
            total[done:done + step] = np.bincount(np.repeat(np.arange(len(n)), n), weights=m[g.integers(0, len(m), int(n.sum()))], minlength=len(n))
            done += step
        return pd.DataFrame({"rep": np.arange(samples, dtype=np.int32), "s": total})

    sums = per.groupBy("slice").applyInPandas(draw, "rep int, s double").groupBy("rep").agg((F.sum("s") / p).alias("e"))
    return _interval(sums, samples)


def bootstrap_portable(rows: DataFrame, value: Column, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """The same interval with draws from MD5 hashes of (seed, replicate, slot), which another engine can repeat, over one array of a checked size."""
    means = prompt_means(rows, value).where("p > 0")
    r = rows.sparkSession.range(samples).select(F.col("id").alias("rep"))
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), i.cast("string"))), 1, 15), 16, 10).cast("bigint") % F.col("p")
    mean = F.aggregate(F.sequence(F.lit(0), F.col("p") - 1), F.lit(0.0), lambda acc, i: acc + F.get("means", draw(i).cast("int"))) / F.col("p")
    return _interval(beside(r, means).select(mean.alias("e")), samples)  # one row, of a checked size, beside every replicate


def bootstrap_poisson(rows: DataFrame, value: Column, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """The same interval by weights: each prompt enters each replicate a Poisson(1) number of times, drawn by a generator keyed by seed and prompt, so the
    draws depend on no partitioning. Sums are formed where the prompts are: a task sends one row per replicate."""
    per = rows.groupBy("prompt_id").agg(F.avg(value).alias("m")).where("prompt_id is not null and m is not null").select(F.xxhash64("prompt_id").alias("h"), "m")

    def run(batches):
        w, wm = np.zeros(samples), np.zeros(samples)
        for b in batches:
            for h, m in zip(b["h"], b["m"]):
                k = np.random.Generator(np.random.Philox(key=[seed, int(h) % 2**64])).poisson(1.0, samples)
                w += k
                wm += k * m
        if w.any():
            yield pd.DataFrame({"rep": np.arange(samples, dtype=np.int32), "w": w, "wm": wm})

    sums = per.mapInPandas(run, "rep int, w double, wm double").groupBy("rep").agg(F.sum("wm").alias("wm"), F.sum("w").alias("w"))
    return _interval(sums.where("w > 0").select((F.col("wm") / F.col("w")).alias("e")), samples)


def bootstrap_twister(rows: DataFrame, value: Column, samples: int = 10_000, seed: int = 42) -> DataFrame:
    """The same interval with the draws of Python's own generator over prompts in the order of ids, in one Python task over one array of a checked size."""

    def run(batches):
        import random
        from statistics import fmean

        for b in batches:
            out = []
            for means in b["means"]:
                means, g = list(means), random.Random(seed)
                if means and samples > 0:
                    e = sorted(fmean(means[g.randrange(len(means))] for _ in means) for _ in range(samples))
                    out.append((e[int(0.025 * (samples - 1))], e[int(0.975 * (samples - 1))]))
            yield pd.DataFrame(out, columns=["lo", "hi"], dtype="float64")

    return prompt_means(rows, value).select("means").mapInPandas(run, "lo double, hi double")
