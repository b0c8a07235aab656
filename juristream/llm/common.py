"""What the operators of this subpackage share: reading tables, the shared folder, materialised tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word is a run of bytes that are neither space nor one of the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset on a single machine (local tests) a temporary folder takes its place; on a cluster that would be a
    folder that executors don't see.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="juristream-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: The scopes that are open in this thread (or other context) of the driver, innermost first, each with the tables written in it so far.
_open: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("open", default=())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of every executor that worked on df, and a later
    recomputation can't repeat a nondeterministic choice (a range partitioning's sample, say) differently.
    """
    path = shared_path(df.sparkSession, name)
    if scopes := _open.get():
        scopes[0].append((df.sparkSession, path))
    return written(df, path)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables that materialise() writes inside are deleted at the end. What is needed after it must have been written outside, or
    within through finished()."""
    mine: list[tuple[SparkSession, str]] = []
    before = _open.set((mine, *_open.get()))
    try:
        yield
    finally:
        _open.reset(before)
        for spark, path in mine:
            drop_path(spark, path)


def finished(df: DataFrame, name: str) -> DataFrame:
    """A result written inside a scope() that stays when it ends (it belongs to the next scope outwards)."""
    before = _open.set(_open.get()[1:])
    try:
        return materialise(df, name)
    finally:
        _open.reset(before)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Freed memory, back to the system: a worker process outlives its task, and idle ones beside it count too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for mapInArrow, with give_back() at the end of each task."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


class BoundedCache(dict):
    """key -> make(key), remembered for up to `most` keys that are at most `longest` long.

    Two generations: the older one is dropped when the younger is full, and what is still in use moves over. One
    worker process keeps it over all its tasks. Forgetting only costs time: values are pure functions of keys.
    """

    def __init__(self, make, most: int, longest: int = 128):
        super().__init__()
        self.make, self.half, self.longest, self.old = make, most // 2, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def recall(self, keys) -> dict:
        """What is remembered of each key, else None."""
        return {k: self[k] if k in self else self.old.get(k) for k in keys}

    def remember(self, found: dict) -> None:
        for key, value in found.items():
            if len(key) <= self.longest:
                if len(self) >= self.half:
                    self.old = dict(self)
                    self.clear()
                self[key] = value

    def forget(self) -> None:
        self.clear()
        self.old = {}
