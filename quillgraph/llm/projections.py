"""Approximate nearest neighbours by low-dimensional stable projections.

Largest inner products become nearest neighbours: a vector gets one more component that brings it to the largest norm,
and a query is scaled to that norm. Gaussian (2-stable) projections to ``DIMS`` dimensions keep distances in law: squared
projected over squared true distance is chi-squared with ``DIMS`` degrees of freedom.

The index is a kd-tree over projections, whose splits are fitted on at most ``SAMPLE`` rows; every row is then put into
its leaf, and leaves get the exact bounds of all their rows. A query first searches its own leaf. Then it visits leaves
as long as the stopping test does not hold: with d the distance of its k-th neighbour so far and p the projected distance
of a leaf (or of a point in it), it stops where the chi-squared law says that a point nearer than d would lie within p
with probability of at least ``SURE``. Within a leaf, neighbours come by projected distance in increments (``FIRST``, then
twice as many each time); each increment is verified with true inner products, and the test is asked again after it.

Queries go to the leaves they visit, so a leaf meets its own queries only; a task keeps the best of at most about
``HELD`` queries and gives those alone. Leaves beyond ``LEAF`` rows (when the number of leaves is at its bound) are dealt to blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors
of another length than most; candidates of a query are all rows with another id; equal scores go by smaller id; fewer
candidates than k give all of them; no rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, partitions
from quillgraph.llm.vectors import matrix, most_common_size, pair_dots, runs, sound

DIMS, LEAF, LEAVES, SAMPLE, SURE = 8, 2048, 4096, 65536, 0.97
FIRST, HELD = 64, 65536  # neighbours of a leaf's first increment; queries whose best a task holds


def chi_square_cdf(x: float, k: int) -> float:
    """P(X <= x) for an even number k of degrees of freedom."""
    h, term, total = x / 2.0, 1.0, 1.0
    for i in range(1, k // 2):
        term *= h / i
        total += term
    return 1.0 - math.exp(-h) * total


def chi_square_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_cdf(hi, k) < p:
        hi *= 2.0
    for _ in range(80):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if chi_square_cdf(mid, k) < p else (lo, mid)
    return hi


class KdTree:
    """Splits by the median of the widest side, kept as arrays: (dimension, value) of inner nodes, breadth first."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.dim = np.zeros((1 << self.depth) - 1, np.int64)
        self.at = np.zeros((1 << self.depth) - 1)
        groups = [np.arange(len(points))]
        for level in range(self.depth):
            below = []
            for k, g in enumerate(groups):
                node = (1 << level) - 1 + k
                if len(g):
                    p = points[g]
                    d = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                    self.dim[node], self.at[node] = d, np.median(p[:, d])
                    left = p[:, d] < self.at[node]
                    below += [g[left], g[~left]]
                else:
                    below += [g, g]
            groups = below

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.dim[node]] >= self.at[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def _directions(d: int) -> np.ndarray:
    return np.random.default_rng(20240501).standard_normal((d + 1, DIMS))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(met: DataFrame, k: int, top: float, directions: np.ndarray, quantile: float, parts: int) -> DataFrame:
    """(query_id, vec_id, score): each query's best of a task, from rows (spot, query_id null for points, id, v, p, bound)."""

    def verified(q, norm, px, pid, gap, name, held, bound):
        """The best ``k`` of ``held`` and this leaf: neighbours by projected distance, in increments that double, until the
        stopping test holds. None if nothing is nearer."""
        some_ids, some = held if held is not None else (np.zeros(0, np.int64), np.zeros(0))

        def state() -> tuple[float, float]:
            """The k-th score so far, and the projected distance (squared) beyond which the test holds."""
            worst = max(bound, some[-1] if len(some) == k else -math.inf)
            return worst, math.inf if worst == -math.inf else quantile * max(0.0, 2.0 * top * top - 2.0 * top / norm * worst) + 1e-9

        (worst, limit), at, step, changed = state(), 0, FIRST, False
        order = np.flatnonzero((gap <= limit) & (pid != name))
        order = order[np.argsort(gap[order], kind="stable")]
        while at < len(order) and gap[order[at]] <= limit:
            part = order[at : at + step]
            part = part[px[part] @ q >= worst - 1e-9]  # with room for rounding
            if len(part):
                all_ids = np.concatenate([some_ids, pid[part]])
                scores = np.concatenate([some, pair_dots(np.broadcast_to(q, (len(part), len(q))), px[part])])
                chosen = _best(all_ids, scores, k)
                some_ids, some, changed = all_ids[chosen], scores[chosen], True
                worst, limit = state()
            at, step = at + step, 2 * step
        return (some_ids, some) if changed else None

    def given(best: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        n = [len(v[0]) for v in best.values()]
        cols = [np.repeat(np.array(list(best), np.int64), n), np.concatenate([v[0] for v in best.values()]), np.concatenate([v[1] for v in best.values()])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for group in runs(batches, "spot"):
            is_query = group.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ids, x, bound = group.column(2).to_numpy(), matrix(group.column(3)), group.column(4).to_numpy()
            points, queries = np.flatnonzero(~is_query), np.flatnonzero(is_query)
            if not len(points) or not len(queries):
                continue
            px = x[points]
            short = np.sum(px * px, axis=1)
            lifted = np.concatenate([px, np.sqrt(np.maximum(0.0, top * top - short))[:, None]], axis=1)
            pp, pid = lifted @ directions, ids[points]
            for start in range(0, len(queries), 256):
                some = queries[start : start + 256]
                q = x[some]
                norm = np.sqrt(np.sum(q * q, axis=1))
                qp = (np.concatenate([q, np.zeros((len(q), 1))], axis=1) * (top / norm)[:, None]) @ directions
                gap = np.sum(qp * qp, axis=1)[:, None] + np.sum(pp * pp, axis=1)[None, :] - 2.0 * (qp @ pp.T)
                for i, row in enumerate(some.tolist()):
                    name = int(ids[row])
                    got = verified(q[i], norm[i], px, pid, gap[i], name, best.get(name), bound[row])
                    if got is not None:
                        best[name] = got
            if len(best) >= HELD:  # a query's best of several batches are put together later
                yield given(best)
                best = {}
        if best:
            yield given(best)

    dealt = met.repartition(parts, "spot").sortWithinPartitions("spot").select("spot", "is_query", "id", "v", "bound")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sure: float = SURE
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found; ``queries`` is a condition on vec_id."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = vectors.where(sound(vector_col) & F.col(id_col).isNotNull())
    rows = usable.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(rows, "ann-rows")
    d = most_common_size(rows, "v")
    if d is None:
        return empty
    rows = rows.where(F.size("v") == d)
    squares = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    info = rows.agg(F.max(F.sqrt(squares)).alias("top"), F.count("*").alias("n")).first()
    top, n = info["top"] * (1 + 1e-12), info["n"]
    directions = _directions(d)

    def lift(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, top * top - np.sum(x * x, axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1) @ directions

    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    leaves = min(LEAVES, -(-n // LEAF))
    tree = KdTree(lift(matrix(fitted)), leaves)
    quantile = chi_square_quantile(sure, DIMS)
    held = spark.sparkContext.broadcast((tree.depth, tree.dim, tree.at))

    def leaf_of(p: np.ndarray) -> np.ndarray:
        t = KdTree(np.zeros((0, DIMS)), 1)
        t.depth, t.dim, t.at = held.value
        return t.leaf(p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = lift(matrix(batch.column(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, DIMS), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf_of(p)), flat], ["vec_id", "v", "leaf", "p"])

    placed = materialize(rows.mapInArrow(place, "vec_id long, v array<double>, leaf long, p array<double>"), "ann-leaves")
    sides = [f(F.get("p", F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(DIMS)]
    boxes = placed.groupBy("leaf").agg(F.count("*").alias("n"), *sides).orderBy("leaf").collect()  # at most LEAVES rows
    blocks = {r["leaf"]: -(-r["n"] // (4 * LEAF)) for r in boxes}
    low = np.array([[r[f"lo{i}"] for i in range(DIMS)] for r in boxes])
    high = np.array([[r[f"hi{i}"] for i in range(DIMS)] for r in boxes])
    names = np.array([r["leaf"] for r in boxes])
    spots = F.broadcast(spark.createDataFrame([(int(a), b) for a, b in blocks.items()], "leaf long, blocks int"))
    points = placed.join(spots, "leaf")
    spot = lambda salt: F.xxhash64("leaf", salt)
    points = points.select(spot(F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).alias("spot"), F.lit(False).alias("is_query"), F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("bound"))
    asked = rows.where(F.expr(queries)).select("vec_id", "v")

    def visits(home: bool):
        """Leaves of each query: its own, or those where the stopping test does not hold with its bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, x, bound = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
                for start in range(0, len(ids), 512):
                    q = x[start : start + 512]
                    norm = np.sqrt(np.sum(q * q, axis=1))
                    p = (np.concatenate([q, np.zeros((len(q), 1))], axis=1) * (top / norm)[:, None]) @ directions
                    gap = np.zeros((len(q), len(names)))
                    for i in range(DIMS):
                        side = np.maximum(np.maximum(low[None, :, i] - p[:, i : i + 1], p[:, i : i + 1] - high[None, :, i]), 0.0)
                        gap += side * side
                    own = gap.argmin(axis=1)
                    b = bound[start : start + 512]
                    reach = np.where(np.isneginf(b), np.inf, quantile * np.maximum(0.0, 2.0 * top * top - 2.0 * top / norm * b))
                    ok = gap <= reach[:, None] + 1e-9
                    first = np.zeros_like(ok)
                    first[np.arange(len(q)), own] = True
                    ok = first if home else ok & ~first
                    i, j = np.nonzero(ok)
                    if len(i):
                        at = pa.array(i + start)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(names[j])], ["vec_id", "v", "bound", "leaf"])

        return run

    def met(wanted: DataFrame, home: bool) -> DataFrame:
        to = wanted.select("vec_id", "v", "bound").mapInArrow(visits(home), "vec_id long, v array<double>, bound double, leaf long")
        to = to.join(spots, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        to = to.select(spot(F.col("salt").cast("long")).alias("spot"), F.lit(True).alias("is_query"), F.col("vec_id").alias("id"), "v", "bound")
        return _search(points.unionByName(to), k, top, directions, quantile, parts)

    first = materialize(_ranked(met(asked.withColumn("bound", F.lit(float("-inf"))), True), k).drop("rank"), "ann-first")
    worst = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("c"), F.min("score").alias("low"))
    bound = F.when(F.col("c") >= k, F.col("low")).otherwise(F.lit(float("-inf")))
    rest = asked.join(worst, "vec_id", "left").withColumn("bound", bound).select("vec_id", "v", "bound")
    found = first.unionByName(met(rest, False))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
