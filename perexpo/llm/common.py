"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perexpo.sources.tables import materialize

#: White space that separates words in every contract of this package (ASCII only).
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder of the session and continue from the files."""
    return materialize(df, f"llm-{name}")


def id_crc(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def give_back(cycles: bool = True) -> None:
    """Return memory that a Python worker no longer needs to the machine, also of ``cycles`` of objects.

    Workers are used again by later tasks; without this, what one task held for a moment stays with
    the worker. Where the C library has no such call, nothing happens.
    """
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_columns(batch: pa.RecordBatch, drop: Iterable[str], **more: pa.Array) -> pa.RecordBatch:
    """The batch without some columns and with others after it."""
    names = [n for n in batch.schema.names if n not in set(drop)]
    arrays = [batch.column(n) for n in names] + list(more.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *more])


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys, none of them null, in tables that never cut a run of equal keys.

    With each table come the bounds of its runs, from 0 to the number of rows.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bounds = bounds_of(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch]), keys)
        last = int(bounds[-2]) - bool(held) if len(bounds) > 2 else 0
        if not batch.num_rows or len(bounds) == 2:
            held += [batch] if batch.num_rows else []
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, last)])
        yield whole, bounds_of(whole, keys)
        held = [batch.slice(last)]
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, bounds_of(whole, keys)


def bounds_of(rows: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for key in keys:
        column = rows[key].combine_chunks()
        column = column.dictionary_encode().indices if pa.types.is_string(column.type) else column
        values = column.to_numpy(zero_copy_only=False)
        changed |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [rows.num_rows]])


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of numbers of one length, as rows."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in column.chunks])
