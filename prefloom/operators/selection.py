"""Which pairs are trained on and evaluated, and in what form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.text import unit_interval


def eligible(pairs: DataFrame, split: str | None = None, confidence: Sequence[str] = ("high", "medium"), min_margin: float = 0.0) -> DataFrame:
    """Retained pairs of the allowed confidence and margin, of one split or all."""
    kept = pairs.where(F.col("retain") & F.col("label_confidence").isin(*confidence) & (F.coalesce("label_margin", F.lit(0.0)) >= min_margin))
    return kept if split is None else kept.where(F.col("split") == split)


def check_splits(pairs: DataFrame, needed: Sequence[str] = ("train", "validation", "test")) -> dict[str, int]:
    """Rows per split; raises where one is empty."""
    n = {r["split"]: r["count"] for r in pairs.groupBy("split").count().collect()}  # one row per split
    for s in needed:
        if not n.get(s):
            raise ValueError(f"No eligible {s} pairs remain")
    return n


def capped(pairs: DataFrame, n: int, seed: int = 42, key: str = "pair_id") -> DataFrame:
    """At most ``n`` rows in an order given by seed and key alone, the same under any partitioning."""
    return pairs.orderBy(F.sha2(F.concat(F.lit(f"{seed}::"), F.col(key)), 256), key).limit(n)


def n_words(text: Column) -> Column:
    """Tokens of the built-in tokenizer: runs of lower-case ASCII letters and digits."""
    return F.size(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != ""))


def within_length(pairs: DataFrame, max_length: int) -> DataFrame:
    """Pairs whose prompt and longer side have at most ``max_length`` tokens."""
    return pairs.where(n_words(F.col("prompt")) + F.greatest(n_words(F.col("chosen")), n_words(F.col("rejected"))) <= max_length)


def messages(pairs: DataFrame) -> DataFrame:
    """prompt, chosen, rejected as chat messages; every other column goes."""
    m = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))
    return pairs.select(m("user", "prompt").alias("prompt"), m("assistant", "chosen").alias("chosen"), m("assistant", "rejected").alias("rejected"))


def manifest(pairs: DataFrame, max_length: int, **how) -> DataFrame:
    """split, before, within_length, dropped: counts of eligible pairs before and after the length filter."""
    e = eligible(pairs, **how)
    fits = n_words(F.col("prompt")) + F.greatest(n_words(F.col("chosen")), n_words(F.col("rejected"))) <= max_length
    return e.groupBy("split").agg(F.count("*").alias("before"), F.count(F.when(fits, 1)).alias("within_length"), F.count(F.when(~fits, 1)).alias("dropped"))


def portable_order(key: Column, seed: int) -> Column:
    return unit_interval(F.concat(F.lit(f"{seed}::"), key))
