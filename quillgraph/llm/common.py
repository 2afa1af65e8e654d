"""What the training-data operators share: materialising, connected components, stable hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of edges that a task holds before it compresses them.
HELD = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: ``spark.checkpoint.dir``, or one of our own where a local session sets none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillgraph-")  # one machine: tests and trials
        spark.sparkContext.setCheckpointDir(base)
    return base


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as its result is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken, name, n = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def unit_hash(*cols, seed: str = "u") -> F.Column:
    """A double in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _forest(u: np.ndarray, v: np.ndarray, owned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges u > v that is not the smallest of its component.

    With ``owned``, a node of another task is left out where its edge to the root came in as it is: its own task got that
    edge as well and says what becomes of it, so each node is told once and what is new is told besides.
    """
    names, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    left, right = inverse[: len(u)].astype(np.int64), inverse[len(u) :].astype(np.int64)
    parent = list(range(len(names)))
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for i, p in enumerate(parent):  # parents come first
        parent[i] = parent[p]
    root = np.array(parent, np.int64)
    at = np.flatnonzero(root != np.arange(len(root)))
    if owned is not None:
        n = len(names)
        known = np.isin(at * n + root[at], left * n + right)
        at = at[np.isin(names[at], owned) | ~known]
    return names[at], names[root[at]]


def _told(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The forest of a task's edges (u, v) or (u, v, at); beyond ``most`` held rows, what is joined already is compressed."""
    us, vs, owned, held, compressed = [], [], None, 0, False
    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        if batch.num_columns > 2:
            mine = np.unique(batch.column(2).to_numpy())
            owned = mine if owned is None else np.union1d(owned, mine)
        held += batch.num_rows
        if held > most:  # what is joined already needs no more room than its nodes
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            us, vs, held, compressed = [u], [v], len(u), True
    if us:
        # after compression an edge to a root may be derived, and so unknown to the node's own task: all is told
        u, v = _forest(np.concatenate(us), np.concatenate(vs), None if compressed else owned)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node reachable, for every node that some edge names.

    A round deals every edge to the tasks of both its ends; a task joins all edges it got in a forest of its own and
    gives each node its root. So a node's neighbours meet at each round, and chains halve. A task holds its share of the
    edges, never a component. Rounds end when all trees are stars.
    """
    parts = partitions(edges.sparkSession)

    most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _told(batches, most)

    cur = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    # each task first joins the edges that it holds already, many to a task: a dense group then sends on a forest of its
    # members from each such task, not all its edges
    cur = cur.coalesce(max(8, parts // 16)).mapInArrow(run, "u long, v long")
    while True:
        ends = cur.withColumn("at", F.explode(F.array("u", "v")))
        cur = materialize(ends.repartition(parts, "at").select("u", "v", "at").mapInArrow(run, "u long, v long"), "cc")
        told = cur.distinct().select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("c")), F.struct(F.col("v").alias("n"), F.lit(0).alias("c")))).alias("x"))
        nodes = told.groupBy("x.n").agg(F.sum("x.c").alias("ups"), F.min("x.c").alias("low"))
        if nodes.where("ups > 1 or (ups = 1 and low = 0)").isEmpty():
            break
    stars = cur.distinct()
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
