"""``python -m prefloom.cli build|train-view|evaluate|compare|verify``: the pipeline steps on files."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from prefloom.operators import tensors
from prefloom.operators.pairs import Policy
from prefloom.operators.scoring import UnigramScorer
from prefloom.plans import pipeline
from prefloom.sources import records


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prefloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="raw JSON list or parquet to pairs and a report")
    for flag, kind, default in (("--seed", int, 42), ("--train-share", float, 0.80), ("--validation-share", float, 0.10), ("--min-common-judges", int, 2), ("--min-margin", float, 0.10), ("--min-confidence", float, 0.60), ("--score-span", float, 4.0)):
        b.add_argument(flag, type=kind, default=default)
    for flag in ("--input", "--output", "--report"):
        b.add_argument(flag, required=True)
    t = sub.add_parser("train-view", help="eligible pairs as messages, by a configuration file")
    t.add_argument("--config", required=True)
    e = sub.add_parser("evaluate", help="score pairs under a unigram model of a text table")
    for flag in ("--pairs", "--corpus", "--output", "--details"):
        e.add_argument(flag, required=True)
    e.add_argument("--text-column", default="text")
    e.add_argument("--split", default="test", choices=["train", "validation", "test"])
    e.add_argument("--max-length", type=int, default=1024)
    e.add_argument("--confidence", nargs="+", default=["high", "medium"])
    e.add_argument("--min-margin", type=float, default=0.10)
    c = sub.add_parser("compare", help="two detail tables to a comparison")
    for flag in ("--baseline-details", "--candidate-details", "--output", "--details-output"):
        c.add_argument(flag, required=True)
    c.add_argument("--beta", type=float, default=0.1)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--bootstrap-samples", type=int, default=10_000)
    v = sub.add_parser("verify", help="how far parameters (param, idx, value) moved")
    for flag in ("--baseline", "--trained", "--output"):
        v.add_argument(flag, required=True)
    v.add_argument("--parameter")
    v.add_argument("--allow-identical", action="store_true")
    return p


def _save(report: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    text = json.dumps(report, indent=2, ensure_ascii=False, default=str)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text + "\n")
    print(text)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("prefloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "build":
        raw = records.read_raw_json(spark, a.input) if a.input.endswith(".json") else spark.read.parquet(a.input)
        policy = Policy(a.seed, a.train_share, a.validation_share, a.min_common_judges, a.min_margin, a.min_confidence, a.score_span)
        _save(pipeline.build(raw, a.output, policy)[1], a.report)
    elif a.command == "train-view":
        conf = records.load_config(a.config)
        pairs = spark.read.parquet(conf["pairs_file"])
        caps = {"train": conf.get("max_train_samples"), "validation": conf.get("max_validation_samples")}
        margin, confidence = float(conf.get("min_label_margin", 0.0)), tuple(conf.get("allowed_confidence", ("high", "medium")))
        views = pipeline.training_view(pairs, margin, confidence, caps, conf.get("max_length"), int(conf.get("seed", 42)), bool(conf.get("sanity_use_train_as_validation", False)))
        for split, view in views.items():
            records.write_jsonl(view, os.path.join(conf["output_dir"], split))
        _save(conf, os.path.join(conf["output_dir"], "resolved_config.json"))
        _save(pipeline.training_manifest(pairs, views, conf, margin, confidence, conf.get("max_length")), os.path.join(conf["output_dir"], "run_manifest.json"))
    elif a.command == "evaluate":
        details, report = pipeline.evaluate(spark.read.parquet(a.pairs), UnigramScorer(spark.read.parquet(a.corpus), a.text_column), a.split, a.max_length, tuple(a.confidence), a.min_margin, allow_test=True)
        records.write_jsonl(details, a.details)
        _save(report, a.output)
    elif a.command == "compare":
        schema = "pair_id string, prompt_id string, correct boolean, model_margin double, chosen_logprob_sum double, rejected_logprob_sum double, chosen_token_count bigint, rejected_token_count bigint"
        rel, report = pipeline.compare(records.read_jsonl(spark, a.baseline_details, schema), records.read_jsonl(spark, a.candidate_details, schema), a.beta, a.seed, a.bootstrap_samples)
        records.write_jsonl(rel.orderBy("pair_id"), a.details_output)
        _save(report, a.output)
    else:
        base, trained = spark.read.parquet(a.baseline), spark.read.parquet(a.trained)
        if a.parameter:
            base, trained = base.where(base["param"] == a.parameter), trained.where(trained["param"] == a.parameter)
            if base.isEmpty():
                raise ValueError(f"Unknown parameter {a.parameter}")
        tensors.check_shapes(base, trained)
        change = tensors.tensor_change(base, trained)
        tensors.check_changed(change, a.allow_identical)
        records.write_jsonl(change, a.output)


if __name__ == "__main__":
    main()
