"""Shared scratch folder for checkpoints and intermediate tables.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a single-process local
master, where driver and executors share one disk, may fall back to a temporary folder of its own,
which goes when the process ends.

Tables stay until their folder goes, unless the code that wrote them says that no later step reads them:
:func:`passing` and :func:`discard` delete those, and only those.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes the shuffle files of an execution at its end, not when the driver's garbage is collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables written in the innermost :func:`passing`, if any.
_PASSING: ContextVar[list[DataFrame] | None] = ContextVar("passing", default=None)


def scratch_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back: survives the loss of any executor.

    Nothing reads the shuffle files of the write again, so they go with it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    if (inside := _PASSING.get()) is not None:
        inside.append(table)
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`cut_lineage` returned and that nothing reads any more; others are left alone."""
    if path := vars(table).pop("_scratch", None):
        spark = table.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that :func:`cut_lineage` writes inside go at the end; those that the function given writes stay."""
    inside: list[DataFrame] = []
    around = _PASSING.get()
    token = _PASSING.set(inside)

    def kept(df: DataFrame) -> DataFrame:
        here = _PASSING.set(around)
        try:
            return cut_lineage(df)
        finally:
            _PASSING.reset(here)

    try:
        yield kept
    finally:
        _PASSING.reset(token)
        for table in inside:
            discard(table)
