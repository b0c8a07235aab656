"""The folder that a cluster shares, and cutting lineage there where a plan would otherwise grow with every round."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of one part of dealt().
PART = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only where that is unset on a single machine (tests) a temporary
    folder takes its place; a cluster's executors wouldn't share it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="juristream-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as checkpointed in the shared folder: it survives the loss of executors, and what follows plans from a file."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, *keys: str, part: int = PART) -> DataFrame:
    """df by its keys in as many parts as `rows` need, so that a task's memory stays as it is when tables grow. Spark itself joins parts
    by their compressed size, which says little of what joins and groups of well-compressed rows take."""
    return df.repartition(max(1, -(-rows // part)), *keys)
