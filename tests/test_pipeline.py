"""End-to-end runs on small files, the command line and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from prefloom import cli
from prefloom.operators.pairs import Policy, build_pairs
from prefloom.plans import pipeline
from prefloom.sources import records
from prefloom.streaming.incremental import stream_pairs


def raw_file(tmp_path, n=150):
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        good = rnd.choice("ab")
        ev = {s: {"judgments": [{"judge_model": f"j{k}", "status": "success", "scores": [{"judge_score": (4.5 if s == good else 2.0) + rnd.choice([0, 0.5])}]} for k in range(3)]} for s in "ab"}
        rows.append({"id": f"r{i}", "instruction": f"question number {i}", "responses": {s: f"answer {s} " + ("plan rest " if s == good else "noise word ") * 3 for s in "ab"}, "preferred_response": good, "evaluations": ev})
    p = tmp_path / "raw.json"
    p.write_text(json.dumps(rows))
    return p


def test_run(spark, tmp_path):
    corpus = spark.createDataFrame([("answer a noise word answer b",)], "text string")
    out = pipeline.run(spark, str(raw_file(tmp_path)), str(tmp_path / "run"), corpus, policy=Policy(train_share=0.6, validation_share=0.2), split="test", allow_test=True)
    r = out["pairs"]
    assert r["records"] == r["possible_pairs"] == 150 == sum(r["pairs_by_split"].values()) and r["retained_pairs"] == sum(r["retained_by_split"].values()) > 100
    assert out["candidate"]["overall"]["preference_accuracy"] > out["baseline"]["overall"]["preference_accuracy"] and out["comparison"]["paired_n"] == out["baseline"]["overall"]["n"]
    lo, hi = out["comparison"]["implicit_reward_accuracy_95"]
    assert 0 <= lo <= hi <= 1
    pairs = spark.read.parquet(str(tmp_path / "run" / "pairs"))
    v = pipeline.training_view(pairs, caps={"train": 5}, max_length=50)
    assert v["train"].count() == 5 and v["test"].columns == ["prompt", "chosen", "rejected"]
    assert pipeline.training_view(pairs, caps={"train": 3}, train_as_validation=True)["validation"].count() == 3
    with pytest.raises(ValueError, match="remain within"):
        pipeline.training_view(pairs, max_length=1)
    with pytest.raises(ValueError, match="locked"):
        pipeline.evaluate(pairs, None, "test")
    with pytest.raises(ValueError, match="passes the filters"):
        pipeline.evaluate(pairs, None, "validation", min_margin=99.0)
    with pytest.raises(ValueError, match="Prompt leakage"):
        pipeline.training_view(pairs.unionByName(pairs.withColumn("split", F.lit("test"))))


def test_locked_test_split(spark, tmp_path):
    corpus = spark.createDataFrame([("answer a",)], "text string")
    with pytest.raises(ValueError, match="locked"):
        pipeline.run(spark, str(raw_file(tmp_path)), str(tmp_path / "run"), corpus, split="test")
    pipeline.open_test(str(tmp_path / "x"), "one")
    pipeline.open_test(str(tmp_path / "x"), "one")
    with pytest.raises(ValueError, match="must not see"):
        pipeline.open_test(str(tmp_path / "x"), "two")


def test_cli(spark, tmp_path):
    t = lambda x: str(tmp_path / x)
    cli.main(["build", "--input", str(raw_file(tmp_path)), "--output", t("pairs"), "--report", t("out/report.json"), "--train-share", "0.6", "--validation-share", "0.2"], spark)
    assert json.load(open(t("out/report.json")))["records"] == 150
    for name, text in (("base", "noise word"), ("cand", "plan rest")):
        spark.createDataFrame([(text,)], "text string").write.parquet(t(f"corpus_{name}"))
        cli.main(["evaluate", "--pairs", t("pairs"), "--corpus", t(f"corpus_{name}"), "--output", t(f"{name}.json"), "--details", t(name), "--split", "validation"], spark)
    cli.main(["compare", "--baseline-details", t("base"), "--candidate-details", t("cand"), "--output", t("cmp.json"), "--details-output", t("rel"), "--bootstrap-samples", "200"], spark)
    c = json.load(open(t("cmp.json")))
    assert c["baseline_wrong_candidate_correct"] == c["paired_n"] > 10 and c["all_pairs_changed"]
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "c.yaml").write_text("pairs_file: pairs\noutput_dir: view\nmax_train_samples: 4\n")
    cli.main(["train-view", "--config", t("conf/c.yaml")], spark)
    assert spark.read.json(t("view/train")).count() == 4
    m = json.load(open(t("view/run_manifest.json")))
    assert m["eligible_pairs"]["train"] == 4 < m["eligible_pairs_before_caps"]["train"] and m["test_evaluated"] is False and m["package_versions"]["pyspark"] and json.load(open(t("view/resolved_config.json")))["max_train_samples"] == 4
    w = spark.createDataFrame([("w", 0, 1.0), ("w", 1, 2.0)], "param string, idx int, value double")
    w.write.parquet(t("w0"))
    w.withColumn("value", F.col("value") + 1).write.parquet(t("w1"))
    cli.main(["verify", "--baseline", t("w0"), "--trained", t("w1"), "--output", t("change"), "--parameter", "w"], spark)
    assert spark.read.json(t("change")).first()["changed_elements"] == 2
    with pytest.raises(ValueError, match="identical"):
        cli.main(["verify", "--baseline", t("w0"), "--trained", t("w0"), "--output", t("same")], spark)
    with pytest.raises(ValueError, match="Unknown parameter"):
        cli.main(["verify", "--baseline", t("w0"), "--trained", t("w0"), "--output", t("same"), "--parameter", "nope"], spark)


def test_stream_equals_batch(spark, tmp_path):
    raw = records.read_raw_json(spark, str(raw_file(tmp_path, 40)))
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_pairs(src, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = build_pairs(spark.read.parquet(str(tmp_path / "in")))
    assert got.select("pair_id", "label_margin").exceptAll(want.select("pair_id", "label_margin")).count() == 0 and got.count() == want.count() == 40
