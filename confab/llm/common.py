"""What the operators share: text batches, durable intermediate results, deterministic folds."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of text that a worker handles at once (a longer text is handled alone).
SLICE_CHARS = 1_500_000


def _fallback(spark: SparkSession, prefix: str) -> str:
    """A local folder, for sessions whose executors are threads of the driver. On a cluster it would be another one on each
    machine, so there the setting is asked for."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


#: Rows of a few numbers that one file of a checkpoint should hold at least.
FILE_ROWS = 250_000


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df, written to the shared folder in spark.checkpoint.dir and cut off from their lineage.

    Where about how many (narrow) rows there will be is known, as in later rounds of a loop, few rows make few files. A local
    folder is set only where the setting is missing in local mode, as in tests."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or _fallback(df.sparkSession, "checkpoint-"))
    if rows is not None and (files := -(-max(rows, 1) // FILE_ROWS)) < parallelism(df.sparkSession):
        df = df.coalesce(files)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir as a URI; a local one only where that is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _fallback(spark, "shared-")
    return (folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string")) % n


def unused(names: list[str], n: int) -> list[str]:
    """n column names that differ from the given ones, whatever their case."""
    taken, out, k = {x.lower() for x in names}, [], 0
    while len(out) < n:
        if (name := f"own_{k}") not in taken:
            out.append(name)
        k += 1
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[str]:
    """Texts of a string column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts batches to slices of about limit characters and gives each with its texts."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        begin = 0
        while begin < batch.num_rows:
            found, size, end = [], 0, begin
            while end < batch.num_rows and size < limit:
                # a few rows at a time, so that long texts aren't all decoded at once
                for x in texts(batch.column(at).slice(end, min(64, batch.num_rows - end))):
                    found.append(x)
                    size += len(x)
                end = begin + len(found)
            yield batch.slice(begin, end - begin), found
            begin = end


def text_slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[str]]:
    """Texts of one-column batches in lists of about limit characters, across batches."""
    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = texts(batch.column(0).slice(k, 64))
            held += part
            size += sum(map(len, part))
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python: Arrow batches of 1,024 rows, where the session has the default of 10,000, keep what a
    worker holds at once to a few megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1024")


def _release() -> None:
    """Gives memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow. Workers are kept from task to task and stage to stage, so each task releases what it has freed."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return df.mapInArrow(tidy, schema)


def by_text(df: DataFrame, columns: list[str], schema: str, make: Callable, text: str = "text") -> DataFrame:
    """mapInArrow over slices: make(slice without text as dict of arrow arrays, texts) gives a dict of output columns.

    schema is a DDL string whose names are those of the dict. Only the named columns are read."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in slices(batches, text):
            rest = {c: part.column(part.schema.get_field_index(c)) for c in columns}
            out = make(rest, found)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[c], pa.Array) else pa.array(x) for c in names], names=names)

    small_batches(df.sparkSession)
    return arrow(df.select(*columns, text), run, schema)
