"""Embedding near-dedup: all pairs of a label with cosine at or above a threshold, by dual traversal of cover trees.

On the unit sphere a cosine threshold is a distance threshold. Vectors of a label are first dealt to cells around pivots
(drawn from the label by hash, at most ``PIVOTS`` over all labels, so that list has a fixed bound); cells beyond ``BLOCK``
vectors are dealt to blocks. Two blocks meet only when their cells' covering radii and the threshold reach across the
distance of their pivots. A meeting builds a cover tree of each side: nested levels whose radii halve, each node with its
true covering radius. Equal vectors of a label are one vector with a weight all the way. Both trees are walked down together, level by level: a pair of nodes is dropped when its centres
are further apart than both radii and the threshold, and taken as a whole when they are so close that every pair of
members is linked, so a mass of copies costs one test. Pairs of points that are left are tested exactly.

A block never holds more than ``BLOCK`` vectors of the densest cell on average; links are counted where they are found
and never listed; what leaves a meeting is a count for each vector and a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label,
link with nothing and are their own component; vectors of other lengths link only among themselves; rows of one vec_id
are vectors of their own, each with its own links and component; a row of null vec_id links with nothing, its component
and kept are null; no rows give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import connected_components, materialize, partitions, unit_hash
from quillgraph.llm.vectors import matrix, pair_dots, runs, sound

PIVOTS, BLOCK = 2048, 2048
FEW, FINEST = 8, 1e-6  # members of a node that is not parted; the smallest radius
EPS = 1e-9


class CoverTree:
    """Levels of nodes over the rows of ``x`` (unit vectors): centre, covering radius, parent, and members in runs.

    Radii halve from level to level until every node is small or holds copies alone. Only distances to centres are taken,
    and only those of a node's own points, so near points cost few.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        n = len(x)
        self.levels = []
        far = self._apart(0, np.arange(n))
        self._level(np.zeros(n, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), far)
        radius = 1.0
        while radius > FINEST:
            last = self.levels[-1]
            wide = last["radius"][np.diff(last["start"]) > FEW]  # of the nodes that are to be parted
            if not len(wide) or wide.max() <= FINEST:
                break
            while radius >= wide.max():  # levels that would part nothing
                radius /= 2.0
            far = self._parted(radius, far)
            radius /= 2.0

    def _apart(self, at: int, rows: np.ndarray) -> np.ndarray:
        dots = (self.x @ self.x[at])[rows] if 2 * len(rows) > len(self.x) else self.x[rows] @ self.x[at]
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))

    def _parted(self, radius: float, far: np.ndarray) -> np.ndarray:
        """The next level; each point's distance to its centre there, from those of the level above."""
        level, last = len(self.levels) - 1, self.levels[-1]
        of, out = np.zeros(len(far), np.int64), np.zeros(len(far))
        centers, parents = [], []
        for k, at in enumerate(last["center"].tolist()):
            left = self.members(level, k)
            d = far[left]  # a node's own centre leads its children
            small = len(left) <= FEW or last["radius"][k] <= radius
            while len(left):
                near = np.ones(len(left), bool) if small else (d <= radius) | (left == at)
                of[left[near]], out[left[near]] = len(centers), d[near]
                centers.append(at)
                parents.append(k)
                left = left[~near]
                if len(left):
                    at = int(left[0])
                    d = self._apart(at, left)
        self._level(of, np.array(centers), np.array(parents), out)
        return out

    def _level(self, of: np.ndarray, center: np.ndarray, parent: np.ndarray, far: np.ndarray) -> None:
        radius = np.zeros(len(center))
        np.maximum.at(radius, of, far)
        order = np.argsort(of, kind="stable")
        start = np.searchsorted(of[order], np.arange(len(center) + 1))
        self.levels.append({"of": of, "center": center, "parent": parent, "radius": radius, "order": order, "start": start})

    def members(self, level: int, node: int) -> np.ndarray:
        at = self.levels[level]
        return at["order"][at["start"][node] : at["start"][node + 1]]


def _roots(n: int) -> np.ndarray:
    return np.arange(n)


def meet(a: CoverTree, b: CoverTree | None, cosine: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each vector of both sides (b after a), and a spanning forest over them. Without b, pairs within a.

    A vector counts as often as its ``weight`` says (once by default).
    """
    own = b is None
    b = a if own else b
    na = len(a.x)
    total = na if own else na + len(b.x)
    shift = 0 if own else na
    w = np.ones(total, np.int64) if weight is None else weight
    counts, root, forest = np.zeros(total, np.int64), _roots(total), []
    reach = np.sqrt(2.0 - 2.0 * cosine)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            forest.append((i, j))

    ia, ib = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(max(len(a.levels), len(b.levels))):
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        x, y = a.levels[la], b.levels[lb]
        alive = np.zeros((len(x["center"]), len(y["center"])), bool)
        if level == 0:
            alive[:] = True
        else:
            before = np.zeros((na_nodes, nb_nodes), bool)  # noqa: F821  of the level above
            before[ia, ib] = True
            pa_, pb_ = (x["parent"] if la == level else np.arange(len(x["center"]))), (y["parent"] if lb == level else np.arange(len(y["center"])))
            alive = before[pa_][:, pb_]
        na_nodes, nb_nodes = alive.shape
        if own:
            alive &= np.arange(nb_nodes)[None, :] >= np.arange(na_nodes)[:, None]
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return counts, forest
        dots = a.x[x["center"][rows]] @ b.x[y["center"][cols]].T
        dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))
        slack = x["radius"][rows][:, None] + y["radius"][cols][None, :]
        live = alive[np.ix_(rows, cols)] & (dist <= slack + reach + EPS)
        whole = live & (dist + slack <= reach - EPS)
        for i, j in zip(*np.nonzero(whole), strict=True):
            ma, mb = a.members(la, rows[i]), b.members(lb, cols[j]) + shift
            same = own and rows[i] == cols[j]
            counts[ma] += w[mb].sum() - (w[ma] if same else 0)
            if not same:
                counts[mb] += w[ma].sum()
            for k in ma.tolist():
                join(int(mb[0]), k)
            for k in mb.tolist():
                join(int(ma[0]), k)
        live &= ~whole
        i, j = np.nonzero(live)
        ia, ib = rows[i], cols[j]
        if not len(ia):
            return counts, forest
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    for start in range(0, len(ia), 20_000):
        left, right = [], []
        for i, j in zip(ia[start : start + 20_000].tolist(), ib[start : start + 20_000].tolist(), strict=True):
            ma, mb = a.members(la, i), b.members(lb, j)
            p, q = np.repeat(ma, len(mb)), np.tile(mb, len(ma))
            if own and i == j:
                p, q = p[p < q], q[p < q]
            left.append(p)
            right.append(q)
        p, q = np.concatenate(left), np.concatenate(right)
        close = pair_dots(a.x[p], b.x[q]) >= cosine
        p, q = p[close], q[close] + shift
        np.add.at(counts, p, w[q])
        np.add.at(counts, q, w[p])
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            join(i, j)
    return counts, forest


def _unit(rows: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    # 0.0 is added so that no component is a negative zero: equal vectors have equal hashes
    return rows.withColumn("norm", norm).withColumn("v", F.transform("v", lambda x: x / F.col("norm") + 0.0)).drop("norm")


def _meetings(tiles: DataFrame, cosine: float, parts: int) -> DataFrame:
    """(a, b, n): counts (b null) and links of the forest, from rows (tile, side, vec_id, v, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, "tile"):
            side = tile.column(1).to_numpy()
            order = np.argsort(side, kind="stable")
            ids, x, w = tile.column(2).to_numpy()[order], matrix(tile.column(3))[order], tile.column(4).to_numpy()[order]
            m = int(np.count_nonzero(side == 0))
            if side.max() == 0:
                counts, forest = meet(CoverTree(x), None, cosine, w)
            elif 0 < m < len(x):
                counts, forest = meet(CoverTree(x[:m]), CoverTree(x[m:]), cosine, w)
            else:
                continue
            some = np.flatnonzero(counts)
            a = np.concatenate([ids[some], ids[[i for i, _ in forest]]]) if len(forest) else ids[some]
            b = pa.array([None] * len(some) + [int(ids[j]) for _, j in forest], pa.int64())
            n = np.concatenate([counts[some], np.zeros(len(forest), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(n, pa.int64())], ["a", "b", "n"])

    dealt = tiles.repartition(parts, "tile").sortWithinPartitions("tile").select("tile", "side", "vec_id", "v", "w")
    return dealt.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    ident = F.col(id_col).cast("long").alias("vec_id")
    takes = sound(vector_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    grp = F.concat_ws(":", F.col(label_col).cast("string"), F.size(vector_col).cast("string"))
    rows = _unit(vectors.where(takes).select(ident, grp.alias("grp"), F.col(vector_col).cast("array<double>").alias("v")))
    same = ["h1", "h2"]  # two hashes of 64 bits: vectors of a label are copies when both are equal
    named = materialize(rows.withColumns({"h1": F.xxhash64(F.lit(1), "grp", "v"), "h2": F.xxhash64(F.lit("b"), "v", "grp")}), "cover-rows")
    # copies are one vector with a weight; tasks add up their own before the shuffle
    classes = named.groupBy(*same).agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.first("grp").alias("grp"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("vec_id", F.monotonically_increasing_id()), "cover-classes")
    rows = classes.select("vec_id", "grp", "v", "w")

    # pivots: every group has one; large groups more, in proportion, PIVOTS in all beyond the first ones
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > BLOCK).orderBy(F.desc("n"), "grp").limit(PIVOTS // 2).collect()
    budget = sum(r["n"] for r in large)
    wanted = [(r["grp"], k, (4.0 * k + 16.0) / r["n"]) for r in large for k in [max(1, min(r["n"] // BLOCK * 2, PIVOTS * r["n"] // budget))]]
    drawn = rows.join(F.broadcast(spark.createDataFrame(wanted, "grp string, k int, rate double")), "grp")
    drawn = drawn.withColumn("u", unit_hash("v", seed="pivot")).where(F.col("u") < F.col("rate"))  # some times as many as are wanted
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("grp").orderBy("u", "vec_id"))).where(F.col("at") <= F.col("k"))
    picked = drawn.select("grp", "v").toArrow() if wanted else None
    pivots: dict[str, np.ndarray] = {}
    if picked is not None and picked.num_rows:
        of = np.array(picked.column(0).to_pylist(), object)
        for g in sorted(set(of.tolist())):
            pivots[g] = matrix(picked.column(1).combine_chunks().take(pa.array(np.flatnonzero(of == g))))
    held = spark.sparkContext.broadcast(pivots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            cell, far = np.zeros(len(names), np.int32), np.full(len(names), 2.0)
            for g in set(names.tolist()) & set(known):
                at = np.flatnonzero(names == g)
                x = matrix(batch.column(2).take(pa.array(at)))
                d = 2.0 - 2.0 * (x @ known[g].T)
                cell[at] = d.argmin(axis=1)
                far[at] = np.sqrt(np.maximum(0.0, d.min(axis=1)))
            cols = [*batch.columns, pa.array(cell), pa.array(far)]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "grp", "v", "w", "cell", "far"])

    placed = rows.mapInArrow(cells, "vec_id long, grp string, v array<double>, w long, cell int, far double")
    placed = materialize(placed, "cover-cells")
    spots = placed.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    spots = spots.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    flat = [(g, i, p.tolist()) for g, x in pivots.items() for i, p in enumerate(x)]
    centers = spark.createDataFrame(flat, "grp string, cell int, c array<double>")
    spots = materialize(spots.join(centers, ["grp", "cell"], "left"), "cover-spots")
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    small = F.broadcast(spots.where("blocks > 1 or c is not null").select("grp", "cell", "blocks"))  # cells of large groups: bounded by PIVOTS
    placed = placed.join(small, ["grp", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", block).select("vec_id", "grp", "v", "w", "cell", "block")

    # which blocks meet
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    other = spots.select("grp", F.col("cell").alias("cell2"), F.col("radius").alias("radius2"), F.col("blocks").alias("blocks2"), F.col("c").alias("c2"))
    dots = F.aggregate(F.zip_with("c", "c2", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    apart = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dots)), F.lit(0.0))
    plan = spots.join(other, "grp").where((F.col("cell") <= F.col("cell2")) & (apart <= F.col("radius") + F.col("radius2") + reach + EPS))
    plan = plan.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    plan = plan.withColumn("block2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    plan = plan.where("cell < cell2 or block <= block2")
    tile = F.xxhash64("grp", "cell", "block", "cell2", "block2")
    plan = materialize(plan.select("grp", "cell", "block", "cell2", "block2", tile.alias("tile")), "cover-plan")
    key = ["grp", "cell", "block"]
    left = placed.join(plan.select(*key, "tile"), key).select("tile", F.lit(0).alias("side"), "vec_id", "v", "w")
    second = plan.where("cell <> cell2 or block <> block2").select("grp", F.col("cell2").alias("cell"), F.col("block2").alias("block"), "tile")
    right = placed.join(second, key).select("tile", F.lit(1).alias("side"), "vec_id", "v", "w")
    met = materialize(_meetings(left.unionByName(right), cosine, parts), "cover-met")

    counts = met.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    comps = connected_components(met.where("b is not null")).withColumnsRenamed({"node": "vec_id"})
    told = classes.select(*same, "w", "least", "vec_id").join(counts, "vec_id", "left").join(comps, "vec_id", "left")
    told = materialize(told.withColumn("component", F.coalesce("component", "vec_id")), "cover-told")
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(least, "component").select(*same, (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = named.select("vec_id", *same).join(told, same).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~takes).select(ident).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
