"""Choosing a training candidate, and what identifies a run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _known(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def ranked(candidates: DataFrame, metric: str, margin: str, loss: str, tie: str) -> DataFrame:
    """Candidates, best first: metric and margin high, loss low; missing values last; equal ones by ``tie``."""
    order = [_known(metric).desc_nulls_last(), _known(margin).desc_nulls_last(), _known(loss).asc_nulls_last(), F.col(tie)]
    return candidates.orderBy(*order)


def winner(candidates: DataFrame, metric: str, margin: str, loss: str, tie: str) -> DataFrame:
    return ranked(candidates, metric, margin, loss, tie).limit(1)


def with_schedule(candidates: DataFrame, pairs: str, batch: str, epochs: str, ratio: str) -> DataFrame:
    """``updates`` = ceil(pairs / batch) * ceil(epochs) and ``warmup`` = their share, rounded half to even, at least 1."""
    updates = (F.ceil(F.col(pairs) / F.col(batch)) * F.ceil(F.col(epochs))).cast("bigint")
    return candidates.withColumn("updates", updates).withColumn("warmup", F.greatest(F.lit(1).cast("bigint"), F.bround(F.col("updates") * F.col(ratio), 0).cast("bigint")))


def grid(spark: SparkSession, **choices: Sequence) -> DataFrame:
    """One candidate per combination of the given settings, numbered in order; settings are few, so the list is made on the driver."""
    names = list(choices)
    rows = [(f"c{k:03}", *map(float, combo)) for k, combo in enumerate(product(*choices.values()))]
    return spark.createDataFrame(rows, "candidate string, " + ", ".join(f"{n} double" for n in names))


def to_train(candidates: DataFrame, finished: DataFrame, settings: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(open, done): candidates without and with a finished, complete run of exactly the same settings, which is used again."""
    complete = finished.where("complete").select(*settings).distinct()
    return candidates.join(complete, list(settings), "left_anti"), candidates.join(complete, list(settings), "left_semi")


def policy_fingerprint(policy: dict) -> str:
    """First 12 hex digits of the SHA-256 of the policy as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]


def file_fingerprint(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def table_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """n, fingerprint of a table, whatever the order of its rows: the rows' hashes are added up in four parts of 60 bits."""
    row = F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    s = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(k)), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"p{k}") for k in range(4)])
    return s.select("n", F.sha2(F.concat_ws(":", "p0", "p1", "p2", "p3"), 256).alias("fingerprint"))
