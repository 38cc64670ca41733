"""Pairs from a stream of raw records.

Everything from a record to its pairs happens inside the record's row, so the batch operator is also the streaming one: no state, no
watermark, late records are as good as early ones. Each micro-batch is written under its own number, so a batch that is
repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prefloom.operators.pairs import Policy, build_pairs


def stream_pairs(records: DataFrame, output: str, checkpoint: str, policy: Policy = Policy(), **trigger) -> StreamingQuery:
    """Write the pairs of each micro-batch of ``records`` to ``output/batch=<n>``; ``trigger`` as for ``DataStreamWriter.trigger``."""

    def land(batch: DataFrame, n: int) -> None:
        build_pairs(batch, policy).write.mode("overwrite").parquet(f"{output}/batch={n}")

    return records.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
