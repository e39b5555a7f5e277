"""Shared plumbing: bounded Arrow batches for Python operators, and the shared checkpoint folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that one step of a Python operator takes at most, unless a single text is longer.
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch that Spark sends to Python at most, unless a single row is longer.
BATCH_BYTES = 8 << 20


def steps(batches: Iterable[pa.RecordBatch], columns: str | tuple[str, ...], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, in order, each of one row or of at most ``limit`` bytes in ``columns`` together."""
    names = (columns,) if isinstance(columns, str) else columns
    for batch in batches:
        sizes = [sum(x) for x in zip(*[pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in names])]
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def bounded_batches(spark: SparkSession) -> None:
    """Make Spark send batches of ``BATCH_BYTES`` at most; a smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(key) if c.isdigit())) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return what a task has freed to the machine: Spark keeps a Python worker for later tasks, and freed memory would stay with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call, and needs none
        pass


def map_rows(df: DataFrame, column: str | tuple[str, ...], schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = STEP_BYTES) -> DataFrame:
    """Map ``df`` by Arrow batches of bounded size.

    ``make`` runs once in each task and returns the function that turns a slice, of one row or of at most ``limit`` bytes of text, into columns
    (name to list or array) of the output schema.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kind)
        work = make()
        for part in steps(batches, column, limit):
            got = work(part)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)
        del work
        give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, kind)


def crc32_mod(column: str | Column, n: int) -> Column:
    """crc32 of the column as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary")) % n


def with_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the cluster's spark.checkpoint.dir rules. A folder of ours serves where none is set and
    driver and executors are one process; on a cluster it would be another folder on each machine, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints")


def small_enough(table: DataFrame, rows: int) -> bool:
    """Whether the table has at most so many rows; reads no more than are needed to tell."""
    return table.limit(rows + 1).count() <= rows


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list[bytes | None]], list[bool]]]) -> DataFrame:
    """The rows whose ``column``, as UTF-8 bytes, is accepted; all columns are kept as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = make()
        for part in steps(batches, column):
            yield part.filter(pa.array(accept(part.column(column).cast(pa.binary()).to_pylist()), pa.bool_()))
        del accept
        give_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def excerpt(text: Column, most: int) -> Column:
    """The text, or of one longer than ``most`` characters four parts spread evenly from its start to its end, as many in all."""
    part = most // 4
    step = (F.length(text) - part) / 3
    parts = [F.substring(text, F.floor(step * k).cast("int") + 1, F.lit(part)) for k in range(4)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws("\n", *parts))
