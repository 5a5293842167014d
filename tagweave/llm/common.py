"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import sys
import tempfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
BATCH_BYTES = 4_000_000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Only on one machine, as in tests, where the session names none, a local one is set; on a cluster that raises.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tagweave-"))
        got = context._jsc.sc().getCheckpointDir().get()
    return got.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until none of columns is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def modest_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: texts are long, and each batch stands in the JVM and in Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@functools.cache
def hold_memory() -> None:
    """Has a worker's C library keep some freed memory until release_memory: the system clears each page that it gives anew."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None) if sys.platform == "linux" else None
    if mallopt is not None:
        for option, size in ((-1, 64 << 20), (-3, 32 << 20)):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            mallopt(option, size)


def release_memory() -> None:
    """Gives a worker's freed memory back to the system, where the C library can: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Each word, with what stands before it, becomes one character, so that no array of words is built."""
    marks = F.regexp_replace(F.rtrim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(marks).cast("long"), F.lit(0).cast("long"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)
