"""Cutting lineage so that a lost executor never costs more than the current step.

The folder comes from the session setting ``spark.checkpoint.dir``, which on a cluster names shared storage. Only a local master,
as in tests, gets a temporary folder where it is unset; elsewhere that is an error, since executors of several machines share no such folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_landed: list[tuple[SparkSession, str]] = []


def _own_dir() -> str:
    made = tempfile.mkdtemp(prefix="prefloom-ckpt-")
    atexit.register(shutil.rmtree, made, True)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Remove the files of a landed table (or of a projection of one) that nothing will read again."""
    for file in df.inputFiles():
        path = os.path.dirname(file)
        for known in [x for x in _landed if path.endswith(x[1].split(":", 1)[-1].lstrip("/"))]:
            _landed.remove(known)
            _delete(*known)


def release() -> None:
    """Remove all landed tables: for a driver that goes on after it has read or written its results."""
    while _landed:
        _delete(*_landed.pop())


@atexit.register
def _remove_landed() -> None:
    """What is left goes when the driver ends; frames made from landed tables may be read until then."""
    try:
        release()
    except Exception:  # the session is gone, and its folder is the cluster's to clean
        return


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; also makes sure that ``checkpoint()`` writes there."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = jsc.getCheckpointDir()
        if have.isDefined():
            found = have.get()
        elif spark.sparkContext.master.startswith("local"):
            found = _own_dir()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share: steps are written there")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared folder (rows; for small, short-lived steps)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed like a landed table."""
    path = f"{shared_dir(spark).rstrip('/')}/prefloom-{uuid.uuid4().hex}"
    _landed.append((spark, path))
    return path


def land(df: DataFrame) -> DataFrame:
    """``df``, written once as parquet to the shared folder and read again (columns; for steps that are read repeatedly)."""
    path = own_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
