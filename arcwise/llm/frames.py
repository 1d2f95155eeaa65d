"""Small helpers of the text operators: tables, stored results, joins of measured size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from arcwise.session import scratch_path, scratch_root

BROADCAST_KEYS = 200_000
"""Keys of at most 64 bytes that may be sent to every executor; more are joined by a shuffle."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once to the shared folder and read back; cuts lineage, survives executors."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    scratch_root(frame.sparkSession)
    return frame.checkpoint()


_kept: dict[tuple, object] = {}
_asked: set[tuple] = set()


def kept(make: Callable) -> Callable:
    """``make``, whose results stay in a worker until a task ends that has not asked for them."""

    @wraps(make)
    def get(*arguments):
        key = (make.__module__, make.__qualname__, *arguments)
        _asked.add(key)
        if key not in _kept:
            _kept[key] = make(*arguments)
        return _kept[key]

    return get


def give_back() -> None:
    """Returns to the system what a task has freed, and drops what another operator's tasks have kept.

    Workers live on over many tasks, and their allocators would hold all that the largest one took.
    """
    for key in [key for key in _kept if key not in _asked]:
        del _kept[key]
    _asked.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(
    frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return frame.mapInArrow(run, schema)


def batch_of(schema, columns: list) -> pa.RecordBatch:
    """An Arrow batch of a Spark schema from its columns, lists or Arrow arrays."""
    fields = to_arrow_schema(schema)
    arrays = [
        column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.array(column, type=field.type)
        for column, field in zip(columns, fields, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=fields)


FILE_ROWS = 1 << 36  # room for the rows of one file


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, made longer until no column is called so."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(frame: DataFrame, name: str) -> DataFrame:
    """The rows of a Parquet table with a long ``name``, the same on every scan, whatever the splits and cores.

    A row's number is its file's place among the table's sorted paths and its own place in the file. Anything
    but a table (or a selection) of Parquet files is stored first, and is then numbered for this call only.
    """
    try:
        meta = frame.metadataColumn("_metadata")
        files = frame.select(meta["file_path"].alias("file"), meta["row_index"].alias("at"))
    except AnalysisException:
        return numbered(stored(frame, "numbered"), name)
    paths = sorted(row[0] for row in files.select("file").distinct().collect())  # files, not rows
    if len(paths) < 2:
        return frame.withColumn(name, meta["row_index"])
    path, base, at = (free_name(frame, key) for key in ("_path", "_base", "_at"))
    bases = frame.sparkSession.createDataFrame([(own, k * FILE_ROWS) for k, own in enumerate(paths)], f"{path} STRING, {base} LONG")
    side = F.broadcast(bases) if len(paths) <= BROADCAST_KEYS else bases.hint("merge")
    placed = frame.withColumns({path: meta["file_path"], at: meta["row_index"]}).join(side, path)
    return placed.withColumn(name, F.col(base) + F.col(at)).drop(path, base, at)


def with_keys(frame: DataFrame, keys: DataFrame, column: str, keep: bool, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``frame`` whose ``column`` is among ``keys`` (or, with keep=False, is not).

    ``keys`` is a stored table of distinct non-null keys. It is sent to all executors only up to
    ``limit`` keys, which are counted; a larger one is joined by a shuffle.
    """
    small = keys.limit(limit + 1).count() <= limit
    side = F.broadcast(keys) if small else keys.hint("merge")
    return frame.join(side, column, "left_semi" if keep else "left_anti")
