"""Vectors as packed unit float32 bytes: one binary per row moves through shuffles faster than an array of floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unit_rows(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers with a usable vector (dim finite values, not all zero) and those vectors at unit length, as float64."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = np.asarray(col.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim))
    flat = col.take(pa.array(rows)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good][:, None]


def binary(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.dtype.itemsize
    offsets = pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x.tobytes())])


def matrix(col: pa.Array, dtype: np.dtype, width: int) -> np.ndarray:
    """The inverse of binary()."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, width), dtype)
    _, offsets, data = col.buffers()
    start, end = (int(np.frombuffer(offsets, np.int32)[col.offset + i]) for i in (0, len(col)))
    return np.frombuffer(data, np.uint8)[start:end].view(dtype).reshape(len(col), width)


def with_unit(df: DataFrame, vec: str = "vec", out: str = "u", dim: int = 64, dtype: type = np.float32) -> DataFrame:
    """Rows of df with a usable vector; vec is replaced by out, the packed unit vector (float32, or float64 for scores to report)."""
    keep = [f for f in df.schema.fields if f.name != vec]
    schema = T.StructType([*keep, T.StructField(out, T.BinaryType(), False)])
    names = [f.name for f in keep]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = unit_rows(b.column(b.schema.get_field_index(vec)), dim)
            kept = pa.Table.from_batches([b.select(names)]).take(pa.array(rows)).combine_chunks()
            yield from kept.append_column(out, binary(x.astype(dtype))).to_batches()

    return df.where(F.col(vec).isNotNull()).mapInArrow(pack, schema)


def current_notes(notes: DataFrame, *columns: str) -> DataFrame:
    """The row of each path with the greatest indexed_at (null counts as least; ties: greatest values of the columns asked for)."""
    rest = [c for c in columns if c != "path"]
    best = F.max(F.struct("indexed_at", *rest)).alias("best")
    return notes.where(F.col("path").isNotNull()).groupBy("path").agg(best).select("path", *[F.col(f"best.{c}").alias(c) for c in rest])


def with_unit_or_null(df: DataFrame, vec: str = "vec", out: str = "u", dim: int = 64) -> DataFrame:
    """All rows of df; vec is replaced by out, the packed unit vector, null where vec isn't usable."""
    keep = [f for f in df.schema.fields if f.name != vec]
    names = [f.name for f in keep]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = unit_rows(b.column(b.schema.get_field_index(vec)), dim)
            place = np.full(b.num_rows, -1)
            place[rows] = np.arange(len(rows))
            yield from pa.Table.from_batches([b.select(names)]).append_column(out, binary(x.astype(np.float32)).take(pa.array(place, mask=place < 0))).combine_chunks().to_batches()

    return df.mapInArrow(pack, T.StructType([*keep, T.StructField(out, T.BinaryType())]))
