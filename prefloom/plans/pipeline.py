"""End-to-end runs: raw records to landed pairs and report, pairs to details and summary, two models to a comparison."""

from __future__ import annotations

import json
import os
import platform
from dataclasses import asdict
from datetime import datetime, timezone
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.operators import audit, selection, summary
from prefloom.operators.pairs import Policy, build_pairs
from prefloom.operators.scoring import Scorer, UnigramScorer, evaluated, score_pairs, skip_reasons
from prefloom.operators.tuning import policy_fingerprint
from prefloom.plans.lineage import land
from prefloom.sources import records


def run_id(policy: Policy, stem: str = "run") -> str:
    return f"{stem}-{policy_fingerprint(asdict(policy))}"


def build(raw: DataFrame, output: str, policy: Policy = Policy()) -> tuple[DataFrame, dict]:
    """Land the pairs of ``raw`` as parquet by split, audit them and return them with the report.

    Landing comes before the audit and the report, so both read columns from files instead of building the pairs again.
    """
    spark = raw.sparkSession
    records.write_parquet(build_pairs(raw, policy), output, ("split",))
    pairs = spark.read.parquet(output)
    audit.check_no_leakage(pairs)
    counts = audit.report_counts(pairs).collect()  # one row per split, label and comparison type
    of = lambda key, value: {r[key]: r[value] for r in counts if r[key] is not None and r[value]}
    report = audit.report_totals(pairs, raw).first().asDict() | {
        "pairs_by_split": of("split", "pairs"), "retained_by_split": of("split", "retained"), "retained_by_confidence": of("label_confidence", "retained"), "retained_by_comparison_type": of("comparison_type", "retained"),
        "exclusion_reasons": {r["reason"]: r["pairs"] for r in audit.report_exclusions(pairs).collect()}, "preferred_field_agreement": audit.report_preferred(pairs).first().asDict(),
        "configuration": asdict(policy) | {"test_share": round(1.0 - policy.train_share - policy.validation_share, 10)}, "run_id": run_id(policy)}
    return pairs, report


def training_view(pairs: DataFrame, min_margin: float = 0.0, confidence: tuple[str, ...] = ("high", "medium"), caps: dict[str, int] | None = None, max_length: int | None = None, seed: int = 42, train_as_validation: bool = False) -> dict[str, DataFrame]:
    """Message tables by split after eligibility, caps and the length filter; every split must keep a row."""
    audit.check_no_leakage(pairs)
    e = selection.eligible(pairs, min_margin=min_margin, confidence=confidence)
    selection.check_splits(e)
    parts = {s: e.where(F.col("split") == s) for s in ("train", "validation", "test")}
    for s in ("train", "validation"):
        if caps and caps.get(s) is not None:
            parts[s] = selection.capped(parts[s], caps[s], seed)
    if train_as_validation:
        parts["validation"] = parts["train"]
    if max_length is not None:
        parts = {s: selection.within_length(p, max_length) for s, p in parts.items()}
        for s in ("train", "validation"):
            if parts[s].isEmpty():
                raise ValueError(f"No {s} pairs remain within {max_length} tokens")
    return {s: selection.messages(p) for s, p in parts.items()}


def training_manifest(pairs: DataFrame, view: dict[str, DataFrame], config: dict, min_margin: float = 0.0, confidence: tuple[str, ...] = ("high", "medium"), max_length: int | None = None) -> dict:
    """What identifies a training view: counts of eligible pairs before caps, after caps and length, and dropped for length, the resolved configuration with
    its fingerprint, and versions. The test split is never evaluated here."""
    e = selection.eligible(pairs, min_margin=min_margin, confidence=confidence)
    before = {r["split"]: r for r in (selection.manifest(pairs, max_length, min_margin=min_margin, confidence=confidence) if max_length is not None else e.groupBy("split").agg(F.count("*").alias("before"), F.lit(0).alias("dropped"))).collect()}  # one row per split
    return {"created_at": datetime.now(timezone.utc).isoformat(), "platform": platform.platform(), "python": platform.python_version(), "package_versions": {n: metadata.version(n) for n in ("pyspark", "pyarrow", "pandas", "numpy")},
            "config": config, "config_fingerprint": policy_fingerprint(config), "eligible_pairs_before_caps": {s: r["before"] for s, r in before.items()}, "eligible_pairs": {s: v.count() for s, v in view.items()},
            "dropped_for_length": {s: r["dropped"] for s, r in before.items()}, "test_evaluated": False}


def open_test(folder: str, fingerprint: str) -> None:
    """Open the test split for one configuration: the first to ask is noted in ``folder``, any other is refused, so that a test result can't choose
    among configurations."""
    path = os.path.join(folder, "test_opened.json")
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            first = json.load(f)["fingerprint"]
        if first != fingerprint:
            raise ValueError(f"The test split was opened for configuration {first}; {fingerprint} must not see it")
        return
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"fingerprint": fingerprint, "opened_at": datetime.now(timezone.utc).isoformat()}, f)


def evaluate(pairs: DataFrame, scorer: Scorer, split: str = "validation", max_length: int = 1024, confidence: tuple[str, ...] = ("high", "medium"), min_margin: float = 0.10, allow_test: bool = False, bootstrap_samples: int = 10_000) -> tuple[DataFrame, dict]:
    """Details of the eligible pairs of a split and their summary. The test split opens only with ``allow_test``."""
    if split == "test" and not allow_test:
        raise ValueError("The test split is locked; pass allow_test=True for the final evaluation")
    rows = selection.eligible(pairs, split, confidence, min_margin)
    if rows.isEmpty():
        raise ValueError("No pair of this split passes the filters of the evaluation")
    scored = land(score_pairs(rows, scorer, max_length))  # the model runs once; everything below reads columns
    details = evaluated(scored)
    groups = summary.all_subgroups(details).collect()  # a few groups
    flat = lambda key: {r["label"]: {k: v for k, v in r.asDict().items() if k not in ("grouping", "label")} for r in sorted(groups, key=lambda r: r["label"]) if r["grouping"] == key}
    overall = flat("overall").get("", {"n": 0})
    interval = summary.bootstrap(details, F.col("correct").cast("double"), bootstrap_samples).first()
    overall |= {"prompt_cluster_bootstrap_95": [interval["lo"], interval["hi"]] if interval else None}
    return details, {"split": split, "max_length": max_length, "overall": overall, "skipped": {r["skip_reason"]: r["n"] for r in skip_reasons(scored).collect()},
                     "subgroups": {k: flat(k) for k in ("label_confidence", "comparison_type", "label_margin_bucket")}}


def compare(base: DataFrame, other: DataFrame, beta: float = 0.1, seed: int = 42, bootstrap_samples: int = 10_000) -> tuple[DataFrame, dict]:
    """Relative details and the comparison report with its three intervals."""
    summary.check_comparable(base, other, beta)
    rel = summary.relative_details(base, other, beta)
    report = summary.compare(rel).first().asDict() | {"beta": beta}
    for k, (name, column) in enumerate((("implicit_reward_accuracy_95", "implicit_reward_correct"), ("implicit_reward_margin_95", "implicit_reward_margin"), ("accuracy_delta_95", "absolute_accuracy_delta"))):
        r = summary.bootstrap(rel, F.col(column).cast("double"), bootstrap_samples, seed + k).first()
        report[name] = [r["lo"], r["hi"]] if r else None
    return rel, report


def run(spark: SparkSession, raw_path: str, folder: str, corpus: DataFrame, text_col: str = "text", policy: Policy = Policy(), split: str = "validation", allow_test: bool = False) -> dict:
    """Records to pairs, evaluation of two unigram models, and their comparison; tables land in ``folder``. The test split opens only with ``allow_test``,
    and only for the first configuration that asks (see ``open_test``)."""
    if split == "test" and allow_test:
        open_test(folder, run_id(policy))
    raw = records.read_raw_json(spark, raw_path)
    records.write_parquet(raw, f"{folder}/raw")
    pairs, report = build(spark.read.parquet(f"{folder}/raw"), f"{folder}/pairs", policy)
    chosen = pairs.where("split = 'train' and retain").select("chosen")
    base = UnigramScorer(corpus, text_col)
    vocabulary = base.vocabulary.unionByName(UnigramScorer(chosen, "chosen").vocabulary).distinct()
    models = {"baseline": UnigramScorer(corpus, text_col, vocabulary), "candidate": UnigramScorer(chosen, "chosen", vocabulary)}
    out = {"pairs": report}
    for name, m in models.items():
        details, out[name] = evaluate(pairs, m, split, allow_test=allow_test)
        records.write_parquet(details, f"{folder}/{name}_details")
    rel, out["comparison"] = compare(*(spark.read.parquet(f"{folder}/{n}_details") for n in models))
    records.write_parquet(rel, f"{folder}/relative_details")
    return out
