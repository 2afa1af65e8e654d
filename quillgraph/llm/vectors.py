"""What the vector operators share: which vectors take part, and moving them between Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    ok = F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix of doubles."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches, put together so that each one returned holds all rows of one value of ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(batch.schema.get_field_index(key)).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if held and held[-1].column(part.schema.get_field_index(key))[0].as_py() != part.column(part.schema.get_field_index(key))[0].as_py():
                yield pa.concat_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_batches(held)


def pair_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the order of the components: equal vectors give equal sums."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def most_common_size(vectors: DataFrame, vector: str) -> int | None:
    top = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top["d"] if top else None
