"""Readers and writers of raw records, pairs, details, reports and configurations."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.operators.audit import check_unique

RAW = ("id string, instruction string, responses map<string,string>, preferred_response string, "
       "evaluations map<string, struct<judgments: array<struct<judge_model: string, status: string, scores: array<struct<judge_score: double>>, score_avg: double, score_std: double>>>>")
PAIR = ("pair_id string, record_id string, prompt_id string, split string, prompt string, chosen string, rejected string, chosen_source string, rejected_source string, comparison_type string, "
        "chosen_score_common_judges double, rejected_score_common_judges double, label_margin double, label_confidence string, confidence_score double, judge_agreement double, judge_coverage double, repeat_consistency double, "
        "average_repeat_std double, common_successful_judges int, expected_judges int, raw_preferred_response string, preferred_field_agrees boolean, pair_weight double, retain boolean, exclusion_reasons array<string>")


def _first_signs(spark: SparkSession, path: str):
    """The first sign that is no white space of each file: a few bytes of it are read, whatever its size."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    open_ = [s for s in fs.globStatus(at) or ()]
    while open_:
        status = open_.pop()
        if status.isDirectory():
            open_ += [s for s in fs.listStatus(status.getPath()) if s.getPath().getName()[0] not in "._"]
            continue
        stream = fs.open(status.getPath())
        try:
            byte = stream.read()
            while byte in (0x20, 0x09, 0x0A, 0x0D, 0xEF, 0xBB, 0xBF):
                byte = stream.read()
            yield chr(byte) if byte > 0 else ""
        finally:
            stream.close()


def read_raw_json(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A JSON array of records, typed, with row_no in file order. One file is one task; land the result as parquet before large work."""
    if any(first not in ("", "[") for first in _first_signs(spark, path)):
        raise ValueError("The input must be a JSON list of records")
    df = spark.read.schema(RAW).option("multiLine", True).json(path).withColumn("row_no", F.monotonically_increasing_id())
    return df.repartition(partitions) if partitions else df


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """One object per line; with ``key``, a key that occurs twice is an error."""
    df = spark.read.schema(schema).json(path)
    if key:
        check_unique(df, key)
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(row: DataFrame, path: str, echo: bool = True) -> dict:
    """One-row table to an indented JSON file on the driver."""
    report = row.first().asDict(recursive=True)
    text = json.dumps(report, indent=2, ensure_ascii=False, default=str)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text + "\n")
    if echo:
        print(text)
    return report


def load_config(path: str) -> dict:
    """A YAML (or JSON) mapping; relative ``*_file`` and ``*_dir`` values resolve against the parent of the configuration's folder."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        config = yaml.safe_load(text)
    except ImportError:
        config = json.loads(text)
    if not isinstance(config, dict):
        raise ValueError("The configuration must be a mapping")
    root = os.path.dirname(os.path.dirname(os.path.abspath(path)))
    return {k: os.path.normpath(os.path.join(root, v)) if isinstance(v, str) and k.endswith(("_file", "_dir")) and not os.path.isabs(v) else v for k, v in config.items()}
