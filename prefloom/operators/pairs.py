"""Chosen and rejected pairs of judged responses, with their quality measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.stats import close, exact_sum
from prefloom.functions.text import assign_split, confidence_label, normalize_prompt, pair_id, prompt_group_id, stripped
from prefloom.operators.judges import expected_judges, judge_stats


@dataclass(frozen=True)
class Policy:
    seed: int = 42
    train_share: float = 0.80
    validation_share: float = 0.10
    min_common_judges: int = 2
    min_margin: float = 0.10
    min_confidence: float = 0.60
    score_span: float = 4.0


#: Exclusion reasons in the order in which they are listed.
REASONS = ("empty_prompt", "empty_response", "identical_responses", "insufficient_common_successful_judges", "aggregate_tie", "margin_below_threshold", "confidence_below_threshold")


def prompts(raw: DataFrame, policy: Policy = Policy(), exact_casefold: bool = False) -> DataFrame:
    """row_no, record_id, prompt, prompt_id, split of every record."""
    norm = normalize_prompt("instruction", exact_casefold)
    return raw.select("row_no", F.coalesce(F.col("id"), F.lit("")).alias("record_id"), stripped(F.coalesce("instruction", F.lit(""))).alias("prompt"), prompt_group_id(norm).alias("prompt_id"),
                      assign_split(norm, policy.seed, policy.train_share, policy.validation_share).alias("split"))


def combinations(raw: DataFrame) -> DataFrame:
    """row_no, source_a, source_b of all pairs of a record's responses, source_a first by code points."""
    s = F.sort_array(F.map_keys("responses"))
    both = F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.greatest(F.size(s), F.lit(1))), lambda b: F.struct(a.alias("source_a"), b.alias("source_b")))))
    return raw.where("responses is not null").select("row_no", F.explode(both).alias("c")).select("row_no", "c.*")


def _common(a: Column, b: Column) -> Column:
    """Judges of both sides in order, with both scores; each judge occurs once per side."""

    def meet(ab: Column) -> Column:
        found = F.transform(ab["a"], lambda x: F.struct(x.alias("x"), F.get(F.filter(ab["b"], lambda y: y["judge"] == x["judge"]), F.lit(0)).alias("y")))
        return F.transform(F.filter(found, lambda m: m["y"].isNotNull()), lambda m: F.struct(m["x"]["judge"].alias("judge"), m["x"]["mean"].alias("ma"), m["y"]["mean"].alias("mb"), m["x"]["repeat_std"].alias("sa"), m["y"]["repeat_std"].alias("sb")))

    # both sides bound to one variable, so that they are looked up once
    return F.sort_array(F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), meet), 1))


def _mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, exact_sum(xs) / F.greatest(F.size(xs), F.lit(1)))


def measured(raw: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row per pair with texts, common judges and the unrounded measures; no shuffle, since a record is one row."""
    norm = normalize_prompt("instruction")
    s = F.sort_array(F.map_keys("responses"))
    both = F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.greatest(F.size(s), F.lit(1))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    per = raw.where("responses is not null").select(
        "row_no", F.coalesce(F.col("id"), F.lit("")).alias("record_id"), stripped(F.coalesce("instruction", F.lit(""))).alias("prompt"), norm.alias("norm"), "responses", stripped(F.coalesce("preferred_response", F.lit(""))).alias("preferred"),
        F.transform_values(F.coalesce("evaluations", F.create_map().cast(raw.schema["evaluations"].dataType)), lambda k, e: judge_stats(e["judgments"])).alias("stats"), expected_judges(F.col("evaluations")).alias("expected_judges"), both.alias("both"))
    p = per.select("*", F.explode("both").alias("c")).drop("both")
    none = F.array().cast("array<struct<judge:string,mean:double,repeat_std:double,valid_attempts:double>>")
    text = lambda k: stripped(F.coalesce(F.col("responses")[F.col(k)], F.lit("")))
    p = p.select("row_no", "record_id", "prompt", prompt_group_id(F.col("norm")).alias("prompt_id"), assign_split(F.col("norm"), policy.seed, policy.train_share, policy.validation_share).alias("split"), "preferred", "expected_judges",
                 F.col("c.a").alias("source_a"), F.col("c.b").alias("source_b"), text("c.a").alias("text_a"), text("c.b").alias("text_b"),
                 _common(F.coalesce(F.col("stats")[F.col("c.a")], none), F.coalesce(F.col("stats")[F.col("c.b")], none)).alias("common"))
    n = F.size("common")
    p = p.withColumn("n_common", n).withColumn("deltas", F.transform("common", lambda x: x["ma"] - x["mb"])).withColumn("delta", F.coalesce(_mean(F.col("deltas")), F.lit(0.0)))
    d = F.col("delta")
    same = F.size(F.filter("deltas", lambda x: ~close(x, 1e-12) & ((x > 0) == (d > 0))))
    agreement = F.when((F.col("n_common") > 0) & (d != 0), same / F.greatest(F.col("n_common"), F.lit(1))).otherwise(F.lit(0.0))
    coverage = F.when(F.col("expected_judges") > 0, F.col("n_common") / F.greatest(F.col("expected_judges"), F.lit(1))).otherwise(F.lit(0.0))
    stds = F.coalesce(_mean(F.flatten(F.transform("common", lambda x: F.array(x["sa"], x["sb"])))), F.lit(0.0))
    p = p.withColumns({"judge_agreement": agreement, "judge_coverage": coverage, "average_repeat_std": stds})
    p = p.withColumn("repeat_consistency", F.greatest(F.lit(0.0), 1.0 - F.col("average_repeat_std") / policy.score_span))
    p = p.withColumn("confidence_score", F.col("judge_agreement") * F.col("judge_coverage") * F.col("repeat_consistency"))
    mean_a, mean_b = _mean(F.transform("common", lambda x: x["ma"])), _mean(F.transform("common", lambda x: x["mb"]))
    return p.withColumns({"score_a": mean_a, "score_b": mean_b, "label_margin": F.abs(d)}).drop("deltas", "common")


def build_pairs(raw: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Every pair with all its columns; gates work on unrounded numbers."""
    p = measured(raw, policy)
    a_first = F.col("delta") >= 0
    side = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    tests = (F.col("prompt") == "", (F.col("text_a") == "") | (F.col("text_b") == ""), F.col("text_a") == F.col("text_b"), F.col("n_common") < policy.min_common_judges, F.col("delta") == 0, F.col("label_margin") < policy.min_margin, F.col("confidence_score") < policy.min_confidence)
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS)]))
    p = p.withColumns({"exclusion_reasons": reasons, "chosen_source": side("source_a", "source_b"), "rejected_source": side("source_b", "source_a")})
    agrees = F.when(((F.col("preferred") == F.col("source_a")) | (F.col("preferred") == F.col("source_b"))) & (F.col("delta") != 0), F.col("preferred") == F.col("chosen_source"))
    return p.select(
        "row_no", pair_id(F.col("record_id"), F.col("prompt_id"), F.col("source_a"), F.col("source_b")).alias("pair_id"), "record_id", "prompt_id", "split", "prompt", side("text_a", "text_b").alias("chosen"), side("text_b", "text_a").alias("rejected"),
        "chosen_source", "rejected_source", F.concat_ws("__vs__", "source_a", "source_b").alias("comparison_type"), side("score_a", "score_b").alias("chosen_score_common_judges"), side("score_b", "score_a").alias("rejected_score_common_judges"),
        "label_margin", confidence_label(F.col("confidence_score")).alias("label_confidence"), "confidence_score", "judge_agreement", "judge_coverage", "repeat_consistency", "average_repeat_std", F.col("n_common").alias("common_successful_judges"), "expected_judges",
        F.col("preferred").alias("raw_preferred_response"), agrees.alias("preferred_field_agrees"), F.lit(1.0).alias("pair_weight"), (F.size("exclusion_reasons") == 0).alias("retain"), "exclusion_reasons")
