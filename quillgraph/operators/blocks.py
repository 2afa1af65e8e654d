"""Vectors as dense blocks: matrix products inside tasks, and few rows out of each meeting of two blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.sources.state import written

#: Vectors that a block holds.
ROWS = 4096


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors of one length), once for each length; a null vector has length 0."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        yield at, flat.reshape(len(at), size) if size else np.zeros((len(at), 0))


def packed(rows: DataFrame, ident: str, vec: str, by: str | None = None, size: int | None = None) -> DataFrame:
    """(grp, block, ids, dim, data): up to ``size`` vectors of one length (and one ``by``) a row, as doubles of 64 bits.

    Blocks are cut from the rows as they lie in their partitions: nothing is shuffled.
    """
    group = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    size = size or ROWS
    asked = rows.select(group.alias("grp"), F.col(ident).alias("id"), F.col(vec).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for grp in batch.column(0).unique().to_pylist():
                own = batch if grp is None and by is None else batch.filter(pc.equal(batch.column(0), grp) if grp is not None else pc.is_null(batch.column(0)))
                for at, matrix in _matrices(own.column(2)):
                    for i in range(0, len(at), size):
                        ids = own.column(1).take(pa.array(at[i : i + size]))
                        part = matrix[i : i + size]
                        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                        cols = [pa.array([grp], pa.string()), pa.array([base + n], pa.int64()), lists, pa.array([part.shape[1]], pa.int32()), pa.array([part.tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["grp", "block", "ids", "dim", "data"])
                        n += 1

    fields = [("grp", T.StringType()), ("block", T.LongType()), ("ids", T.ArrayType(asked.schema["id"].dataType)), ("dim", T.IntegerType()), ("data", T.BinaryType())]
    return asked.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in fields]))


def unit(data: bytes, dim: int, n: int) -> np.ndarray:
    """A block's vectors by their lengths; a vector without length, or that holds what is not a number, is all zeros."""
    m = np.frombuffer(data, np.float64).reshape(n, dim).copy()
    norm = np.sqrt((m * m).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    m[~ok] = 0.0
    m[ok] /= norm[ok][:, None]
    return m


def tiled(a: DataFrame, b: DataFrame, on: str, a_key: str, b_key: str) -> DataFrame:
    """Every row of ``a`` with every row of ``b`` of equal ``on``, over a grid of tasks: a side travels as often as the
    grid is wide, the square root of the number of partitions, whatever one value of ``on`` holds."""
    side = math.isqrt(max(1, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1)) + 1
    cells = F.sequence(F.lit(0), F.lit(side - 1))
    left = a.withColumn("_r", F.pmod(F.xxhash64(a_key), F.lit(side)).cast("int")).withColumn("_c", F.explode(cells))
    right = b.withColumn("_c", F.pmod(F.xxhash64(b_key), F.lit(side)).cast("int")).withColumn("_r", F.explode(cells))
    # few bytes may be long work: the cells stay dealt to tasks, also where Spark broadcasts a side or would join tasks
    left = left.repartition(side * side, on, "_r", "_c")
    return left.join(right, [on, "_r", "_c"]).drop("_r", "_c")


def _first(row: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ``k`` best of each row by score, ties by id, in order."""
    place = np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place, -score, row))
    row = row[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[few], score[order[few]], ids.take(pa.array(order[few]))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, ident: str, vec: str, query: str = "query_id", qvec: str = "qvec", other: bool = False, same: tuple[str, str] | None = None, many: bool = False) -> DataFrame:
    """(query_id, id, score): at least the ``k`` best of each query by cosine to six places, ties by id.

    With ``other`` a query does not find the row of its own id; with ``same`` (a column of the vectors, one of the
    queries) only rows of an equal value, not null: these are blocks of their own. Blocks of vectors meet blocks of queries;
    while a task's meetings are of one block of queries, ``k`` rows a query are held, and no more are shuffled.
    Queries are packed once and lie as a table, so that Spark sees their size and broadcasts them where its own bound allows
    it; no task packs them again for each part of the vectors. ``many`` queries, whose number grows with the vectors, meet
    them over a grid of tasks instead, each block of queries with all vectors of a cell one after the other.
    """
    by, qby = same or (None, None)
    v = packed(vectors, ident, vec, by).select("grp", F.col("block").alias("x"), "ids", "dim", "data")
    q = packed(queries, query, qvec, qby, 1024).select("grp", F.col("block").alias("y"), F.col("ids").alias("qids"), F.col("dim").alias("qdim"), F.col("data").alias("qdata"))
    q = written(q, "asked")
    if many:
        v, q = (x if same else x.withColumn("grp", F.lit("")) for x in (v, q))
        met = tiled(q, v, "grp", "y", "x")
    else:
        met = v.crossJoin(q.drop("grp")) if same is None else tiled(v, q, "grp", "x", "y")
    met = met.select("y", "ids", "dim", "data", "qids", "qdim", "qdata")
    fields = [T.StructField("query_id", queries.schema[query].dataType), T.StructField("id", vectors.schema[ident].dataType), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = qids = right = row = score = found = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([qids.take(pa.array(row)), found, pa.array(score)], ["query_id", "id", "score"])

        for batch in batches:
            cols = {n: batch.column(n) for n in ("y", "ids", "dim", "data", "qids", "qdim", "qdata")}
            for i in range(batch.num_rows):
                ids = cols["ids"][i].values
                if held != cols["y"][i].as_py():
                    if held is not None:
                        yield out()
                    held, qids = cols["y"][i].as_py(), cols["qids"][i].values
                    right = unit(cols["qdata"][i].as_py(), cols["qdim"][i].as_py(), len(qids))
                    row, score, found = np.zeros(0, np.int64), np.zeros(0), ids[:0]
                if cols["dim"][i] == cols["qdim"][i]:
                    scores = right @ unit(cols["data"][i].as_py(), cols["dim"][i].as_py(), len(ids)).T
                else:
                    scores = np.zeros((len(qids), len(ids)))
                if other:
                    scores[qids.to_numpy(zero_copy_only=False)[:, None] == ids.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                # what a query must reach to be among its best, to less than what rounding moves
                count = np.bincount(row, minlength=len(qids))
                full, least = count == k, np.full(len(qids), -np.inf)
                least[full] = score[np.cumsum(count)[full] - 1] - 1e-6
                if len(ids) > k and not full.all():
                    least[~full] = np.partition(scores[~full], len(ids) - k, axis=1)[:, len(ids) - k] - 1e-6
                r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf) if other else scores >= least[:, None])
                if len(r):
                    added = np.round(scores[r, c], 6) + 0.0
                    row, score, found = _first(np.concatenate([row, r]), np.concatenate([score, added]), pa.concat_arrays([found, ids.take(pa.array(c))]), k)
        if held is not None:
            yield out()

    return met.mapInArrow(run, T.StructType(fields))


def close_pairs(rows: DataFrame, least: dict[str, float], other: float, ident: str = "o", vec: str = "vec", by: str = "kind") -> DataFrame:
    """(i, j, cos) with i > j: pairs of one ``by`` whose cosine reaches ``least`` of that value, or ``other``."""
    blocks = packed(rows, ident, vec, by, 1024)
    a = blocks.select("grp", F.col("block").alias("x"), "ids", "dim", "data")
    b = blocks.select("grp", F.col("block").alias("y"), F.col("ids").alias("qids"), F.col("dim").alias("qdim"), F.col("data").alias("qdata"))
    met = tiled(a, b, "grp", "x", "y").where("x <= y and dim = qdim and dim > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            for i in range(batch.num_rows):
                left = unit(cols["data"][i], cols["dim"][i], len(cols["ids"][i]))
                right = unit(cols["qdata"][i], cols["qdim"][i], len(cols["qids"][i]))
                scores = left @ right.T
                r, c = np.nonzero(scores >= least.get(cols["grp"][i], other) - 1e-9)
                u, v = np.array(cols["ids"][i], np.int64)[r], np.array(cols["qids"][i], np.int64)[c]
                keep = (u > v) if cols["x"][i] == cols["y"][i] else u != v
                u, v, s = u[keep], v[keep], scores[r, c][keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.array(s)], ["i", "j", "cos"])

    return met.mapInArrow(run, "i long, j long, cos double")
