"""Sharding by the ``bytes`` law: minimax contiguous partition over ordered atomic groups (native).

Rows with equal texts form one group and stay together. Groups are ordered; the smallest capacity for which a greedy
pass fills at most the given number of shards is found by binary search, and the order is cut under it: a plain greedy
cut would leave all slack to the last shard, so each cut goes to the group end nearest an even share, as far as the
capacity allows on both sides.

Groups at least as large as an even share are a shard each, and lead the order: no capacity below theirs is feasible
wherever they stand, and cutting the rest for its own smallest capacity keeps the other shards as even as can be.

Nothing unbounded reaches the driver. The greedy check needs "the last group end not beyond x"; group ends are
summarised as (first, last) of at most ``KNOTS`` byte ranges. A capacity that is infeasible even when each doubtful
range is read in its favour, or feasible even against it, is decided; the ranges that leave doubt are summarised
again, more finely, until one capacity is left.

Defined results: a null or empty text has size 8 (null: no crc32); null texts form one group, apart from empty ones;
repeated rows are rows of their own and share a shard; rows of equal id take slots in order of their size and crc;
no rows give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, partitions

KNOTS = 16384


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, text.isNull()).alias("k1"),
        F.xxhash64(F.lit("second"), text, text.isNull()).alias("k2"),
    )


def _oversize(groups: DataFrame, total: int, shards: int) -> list[tuple[int, int, int]]:
    """Groups that get a shard of their own: (k1, k2, bytes), largest first; at most shards - 1 of them."""
    top = groups.orderBy(F.desc("bytes"), "gkey", "k1", "k2").limit(shards).collect()
    out, left = [], total
    for r in top:
        if len(out) == shards - 1 or r["bytes"] < left / (shards - len(out)) or left == r["bytes"]:
            break
        out.append((r["k1"], r["k2"], r["bytes"]))
        left -= r["bytes"]
    return out


class _Ends:
    """Group ends known by ranges: in each, the first and the last end; exact where they are equal or nothing lies between."""

    def __init__(self) -> None:
        self.known: list[tuple[int, int]] = []

    def put(self, ranges: list[tuple[int, int]]) -> None:
        self.known = sorted(ranges)
        self.first = [a for a, _ in self.known]

    def at_most(self, x: int) -> tuple[int, int, int]:
        """(lower bound, upper bound, range) of the last end that is <= x."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0, -1
        a, b = self.known[i]
        return (b, b, -1) if x >= b else (a, min(x, b), i)


def _smallest_capacity(ends: DataFrame, start: int, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity for ends in (start, total], and cuts under it."""
    known = _Ends()

    def summary(df: DataFrame, width: int, part=None) -> list[tuple[int, int]]:
        ranges = df.groupBy((F.lit(0) if part is None else part).alias("p"), F.expr(f"e div {width}").alias("b"))
        return [(r["a"], r["z"]) for r in ranges.agg(F.min("e").alias("a"), F.max("e").alias("z")).collect()]

    def greedy(cap: int, kind: int) -> tuple[bool, list[int], set[int]]:
        at, cuts, doubt = start, [], set()
        for _ in range(shards):
            got = known.at_most(at + cap)
            if got[2] >= 0:
                doubt.add(got[2])
            at = max(at, got[kind])
            cuts.append(at)
            if at >= total:
                return True, cuts, doubt
        return False, cuts, doubt

    def refine(i: int) -> None:
        a, b = known.known[i]
        fine = summary(ends.where(F.col("e").between(a, b)), max(1, -(-(b - a + 1) // KNOTS)))
        known.put(known.known[:i] + known.known[i + 1 :] + fine)

    def last_end(x: int) -> int:
        while (got := known.at_most(x))[2] >= 0:
            refine(got[2])
        return max(start, got[0])

    def first_end(x: int) -> int:
        while True:
            i = bisect_right(known.first, x - 1) - 1  # the last range that begins before x
            if i < 0 or known.known[i][1] < x:
                return known.known[i + 1][0] if i + 1 < len(known.known) else total
            if known.known[i][0] == known.known[i][1]:
                return known.known[i][0]
            refine(i)

    def evened(cap: int) -> list[int]:
        """Cuts under ``cap`` as near to even shares as it allows: no cut before what the rest needs, none beyond ``cap``."""
        earliest = [total]
        while len(earliest) < shards and earliest[0] - cap > start:
            earliest.insert(0, first_end(earliest[0] - cap))
        earliest = [start] * (shards - len(earliest)) + earliest
        cuts, at = [], start
        for k in range(1, shards):
            even, top = start + (total - start) * k // shards, at + cap
            below, above = last_end(min(even, top)), first_end(even)
            at = above if above <= top and above - even < even - below else below
            at = max(at, earliest[k - 1])
            cuts.append(at)
        return [*cuts, total]

    ends = ends.where(F.col("e") > start)
    known.put(summary(ends, max(1, -(-(total - start) // KNOTS))))
    low, high = max(largest, -(-(total - start) // shards)) - 1, total - start
    while True:
        a, b = low, high  # the largest capacity that fails for certain
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if not greedy(mid, 1)[0] else (a, mid)
        low = a
        a, b = low, high  # the smallest that holds for certain
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if not greedy(mid, 0)[0] else (a, mid)
        high = b
        ok, cuts, doubt = greedy(high, 0)
        if high - low == 1 and not doubt:
            return high, evened(high)
        under, over = greedy(low + 1, 0)[1], greedy(high, 1)[1]
        spans = [(known.known[i][0], known.known[i][1]) for i in doubt]
        for k, top in enumerate(over):
            spans.append((under[k] if k < len(under) else total, top))
        merged: list[list[int]] = []
        for s, e in sorted((min(s, e), max(s, e)) for s, e in spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        # whole ranges that meet a span are read again; a gap between two spans is a gap between groups of the summary
        again: list[tuple[int, int]] = []
        for lo, hi in merged:
            met = [(x, y) for x, y in known.known if x < y and lo <= y and x <= hi]
            if met:
                again.append((met[0][0], met[-1][1]))
        width = max(1, -(-sum(hi - lo + 1 for lo, hi in again) // KNOTS))
        inside, part = F.lit(False), F.lit(0)
        for lo, hi in again:
            inside = inside | F.col("e").between(lo, hi)
            part = part + (F.col("e") > F.lit(hi)).cast("int")
        fine = summary(ends.where(inside), width, part)
        kept = [(x, y) for x, y in known.known if not any(lo <= x and y <= hi for lo, hi in again)]
        known.put(kept + fine)


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, shard_bytes_before): every row of ``docs`` in one of ``shards`` shards."""
    spark = docs.sparkSession
    rows = materialize(_sized(docs, id_col, text_col), "shard-rows")
    groups = rows.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("gkey"), F.count("*").alias("n"), F.sum("size").alias("bytes")
    )
    groups = materialize(groups, "shard-groups")
    total, count = groups.agg(F.sum("bytes"), F.sum("n")).first()
    total, count = total or 0, count or 0
    over = _oversize(groups, total, shards) if total else []
    rank = F.lit(len(over))
    for i, (k1, k2, _) in reversed(list(enumerate(over))):
        rank = F.when((F.col("k1") == k1) & (F.col("k2") == k2), F.lit(i)).otherwise(rank)
    groups = groups.withColumn("lead", rank)

    # each row learns its group's place; the few groups that hold many rows (fewer than 2,048 by the threshold) go by broadcast
    many = max(256, count // 2048)
    place = groups.select("k1", "k2", "lead", "gkey", "n")
    hot = F.broadcast(place.where(F.col("n") > many).select("k1", "k2", F.col("lead").alias("hl"), F.col("gkey").alias("hg"), F.lit(True).alias("hot")))
    tried = rows.join(hot, ["k1", "k2"], "left")
    done = tried.where("hot").select("doc_id", "size", "text_crc32", "k1", "k2", F.col("hl").alias("lead"), F.col("hg").alias("gkey"))
    rest = tried.where("hot is null").drop("hl", "hg", "hot").join(place.where(F.col("n") <= many).drop("n"), ["k1", "k2"])
    placed = done.unionByName(rest.select(done.columns))

    # one order over all rows: blocks by range, then offsets from the blocks' sums
    order = ["lead", "gkey", "k1", "k2", "doc_id", "size", "text_crc32"]
    blocks = blocks or partitions(spark)
    ranged = placed.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "shard-order").withColumn("block", F.shiftright("at", 33))
    sums = {r[0]: (r[1], r[2]) for r in ranged.groupBy("block").agg(F.sum("size"), F.count("*")).collect()}
    ahead, by, rw = [], 0, 0
    for b in sorted(sums):
        ahead.append((b, by, rw))
        by, rw = by + sums[b][0], rw + sums[b][1]
    offsets = F.broadcast(spark.createDataFrame(ahead, "block long, bytes_ahead long, rows_ahead long"))
    here = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lined = (
        ranged.withColumn("upto", F.sum("size").over(here))
        .join(offsets, "block")
        .select(
            "doc_id", "size", "text_crc32", "k1", "k2", "lead",
            (F.col("bytes_ahead") + F.col("upto")).alias("end"),
            (F.col("rows_ahead") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("row"),
        )
    )
    lined = materialize(lined, "shard-lined")
    ends = lined.groupBy("k1", "k2").agg(F.max("end").alias("e"), F.max("lead").alias("lead"))
    ends = materialize(ends.select("k1", "k2", "e", "lead"), "shard-ends")

    lead_bytes = sum(x[2] for x in over)
    cuts: list[int] = []
    at = 0
    for x in over:
        at += x[2]
        cuts.append(at)
    if total > lead_bytes:
        largest = groups.where(F.col("lead") == len(over)).agg(F.max("bytes")).first()[0]
        cuts += _smallest_capacity(ends.select("e"), lead_bytes, total, largest, shards - len(over))[1]
    starts = sorted(set(cuts))[:-1] if cuts else []
    # the rows of a group lie between two cuts as a whole, so a row's own end decides like its group's
    shard = F.lit(0)
    for c in starts:
        shard = shard + (F.col("end") > F.lit(c)).cast("int")
    out = lined.withColumn("shard", shard)
    first = F.broadcast(out.groupBy("shard").agg(F.min("row").alias("first"), F.min(F.col("end") - F.col("size")).alias("ahead")))
    return out.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("row") - F.col("first")).alias("slot"),
        (F.col("end") - F.col("size") - F.col("ahead")).alias("shard_bytes_before"),
    )
