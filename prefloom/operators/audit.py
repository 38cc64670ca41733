"""Audits: leakage, uniqueness, equal key sets, and the report on built pairs. ``check_*`` run at once and raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.functions.rows import beside
from prefloom.operators.pairs import REASONS


def leaked_prompts(pairs: DataFrame) -> DataFrame:
    """prompt_id, n_splits of prompts that occur in more than one split."""
    # a split is one of few names: the set per prompt stays small
    return pairs.groupBy("prompt_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def check_no_leakage(pairs: DataFrame) -> None:
    bad = leaked_prompts(pairs).limit(5).collect()
    if bad:
        raise ValueError(f"Prompt leakage: these prompts lie in several splits: {[r['prompt_id'] for r in bad]}")


def duplicate_keys(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(rows: DataFrame, key: str = "pair_id") -> None:
    bad = duplicate_keys(rows, key).limit(1).collect()
    if bad:
        raise ValueError(f"Duplicate {key}: {bad[0][key]}")


def key_sets(base: DataFrame, other: DataFrame, key: str = "pair_id") -> DataFrame:
    """n_base, n_other, n_shared: sizes of the two key sets."""
    both = base.select(key, F.lit(1).alias("a")).distinct().join(other.select(key, F.lit(1).alias("b")).distinct(), key, "full_outer")
    return both.agg(F.count("a").alias("n_base"), F.count("b").alias("n_other"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_shared"))


def check_same_keys(base: DataFrame, other: DataFrame, key: str = "pair_id") -> None:
    r = key_sets(base, other, key).first()
    if not r["n_base"] or not r["n_other"]:
        raise ValueError(f"Both sides must be nonempty (baseline={r['n_base']}, candidate={r['n_other']})")
    if r["n_base"] != r["n_shared"] or r["n_other"] != r["n_shared"]:
        raise ValueError(f"Both sides must hold exactly the same pair IDs (baseline={r['n_base']}, candidate={r['n_other']}, shared={r['n_shared']})")


def report_totals(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    made = pairs.agg(F.count("*").alias("possible_pairs"), F.count(F.when(F.col("retain"), 1)).alias("retained_pairs"), F.countDistinct(F.when(F.col("retain"), F.col("prompt_id"))).alias("retained_prompts"))
    return beside(made, raw.agg(F.count("*").alias("records"))).select("records", "possible_pairs", "retained_pairs", "retained_prompts")


def report_counts(pairs: DataFrame) -> DataFrame:
    """split, label_confidence, comparison_type, pairs, retained: one pass with grouping sets; exactly one key is set in each row."""
    keys = ("split", "label_confidence", "comparison_type")
    pairs = pairs.select(*keys, "retain")
    g = pairs.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys])
    return g.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("retain"), 1)).alias("retained"))


def report_exclusions(pairs: DataFrame, reasons: tuple[str, ...] = REASONS) -> DataFrame:
    """reason, pairs of the reasons that occur: one row of conditional counts, turned."""
    counts = pairs.agg(*[F.count(F.when(F.array_contains("exclusion_reasons", r), 1)).alias(r) for r in reasons])
    return counts.unpivot([], list(reasons), "reason", "pairs").where("pairs > 0")


def report_preferred(pairs: DataFrame) -> DataFrame:
    a = F.col("preferred_field_agrees")
    return pairs.agg(F.count(F.when(a, 1)).alias("agrees"), F.count(F.when(~a, 1)).alias("disagrees"), F.count(F.when(a.isNull(), 1)).alias("not_applicable"))
