"""Average-linkage clustering of a bounded number of vectors (cosine distance), in one task by nearest-neighbour chains.

Its memory is quadratic, so it refuses more than MOST rows; for whole collections use density clustering instead."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions.vectors import matrix

MOST = 5000


def merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, distance) of the merges of unit vectors, by rising distance; a merged cluster goes by its lesser row."""
    n = len(x)
    d = 1.0 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    alive = np.ones(n, bool)
    out, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            chain = chain[:-2]
            a, b = min(a, b), max(a, b)
            out.append((a, b, float(d[a, b])))
            mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a], d[:, a] = mean, mean
            d[a, a] = np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(b)
    return sorted(out, key=lambda m: m[2])


def labels(x: np.ndarray, distance: float | None = 0.35, k: int | None = None) -> np.ndarray:
    """A label for each row: k clusters, or those that merges below the distance make."""
    n = len(x)
    if k is not None and not 1 <= k <= n:
        raise ValueError(f"k is {k}, but there are {n} rows")
    top = np.arange(n)

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for step, (a, b, d) in enumerate(merges(x)):
        if n - step <= k if k is not None else d >= distance:
            break
        ra, rb = root(a), root(b)
        top[max(ra, rb)] = min(ra, rb)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1] if n else np.zeros(0, int)


def average_linkage(rows: DataFrame, distance: float | None = 0.35, k: int | None = None, dim: int = 64) -> DataFrame:
    """(key, label) of rows (key, u), at most MOST of them."""
    n = rows.limit(MOST + 1).count()
    if n > MOST:
        raise ValueError(f"average linkage takes at most {MOST} rows")
    kind = rows.schema["key"].dataType.simpleString()

    def kernel(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks().sort_by("key")
        x = matrix(t.column("u"), np.dtype(np.float64), dim)
        yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), pa.array(labels(x, distance, k).astype(np.int32))], names=["key", "label"])

    return rows.select("key", "u").groupBy(F.lit(0).alias("all")).applyInArrow(kernel, f"key {kind}, label int")
