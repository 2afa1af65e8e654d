"""Fusion, diversification and selection of candidates. Every window is per query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.config import RetrievalParams, ScoringParams
from quillgraph.sources.state import written

R, S = RetrievalParams(), ScoringParams()


def min_max(score: str, group: str, flat: float) -> Column:
    """Score scaled to its group; ``flat`` where all are equal (0 in fusion and mode merge, 1 in diversification)."""
    w = Window.partitionBy(group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low > 1e-9, (F.col(score) - low) / (high - low)).otherwise(F.lit(flat))


def rrf(rows: DataFrame, first: str = "first_rank", second: str = "second_rank", k: int = R.rrf_k) -> Column:
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return part(first) + part(second)


def rrf_fuse(rows: DataFrame, a: str, b: str, k: int = R.rrf_k, query: str = "query_id", ident: str = "id") -> DataFrame:
    """Adds rank_a, rank_b by two scores (ties by id) and their reciprocal-rank sum."""
    by = lambda c: F.row_number().over(Window.partitionBy(query).orderBy(F.desc(c), ident))
    ranked = rows.withColumn("rank_a", by(a)).withColumn("rank_b", by(b))
    return ranked.withColumn("rrf", F.round(1.0 / (k + F.col("rank_a")) + 1.0 / (k + F.col("rank_b")), 6))


def alpha_fuse(rows: DataFrame, rerank: str, first: str, alpha: float, query: str = "query_id") -> DataFrame:
    fused = alpha * min_max(rerank, query, 0.0) + (1 - alpha) * min_max(first, query, 0.0)
    return rows.withColumn("fused", F.round(fused, 6))


def merge_modes(rows: DataFrame, cap: int = R.hybrid_cap) -> DataFrame:
    """(query_id, id, score, from_modes, rank) from (query_id, mode, id, score): scaled per mode, best score per block."""
    w = Window.partitionBy("query_id", "mode")
    span = F.max("score").over(w) - F.min("score").over(w)
    scaled = (F.col("score") - F.min("score").over(w)) / F.when(span > 1e-9, span).otherwise(F.lit(1.0))
    best = rows.withColumn("s", scaled).groupBy("query_id", "id").agg(F.round(F.max("s"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("from_modes"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def budgeted(rows: DataFrame, k: int, budget: int = S.token_budget, query: str = "query_id", rank: str = "rank", tokens: str = "tokens") -> DataFrame:
    """The ranked prefix whose tokens before each row stay below the budget, at most k rows: a row may overshoot."""
    w = Window.partitionBy(query).orderBy(rank)
    before = F.coalesce(F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("tokens_before", before).withColumn("_n", F.row_number().over(w))
    return marked.where((F.col("tokens_before") < budget) & (F.col("_n") <= k)).drop("_n")


def same_page_discount(rows: DataFrame, cap: int = S.same_page_cap, factor: float = S.same_page_discount, query: str = "query_id", page: str = "url") -> DataFrame:
    """Halves the score of a page's rows beyond the cap; the order stays."""
    n = F.row_number().over(Window.partitionBy(query, page).orderBy("rank"))
    return rows.withColumn("page_row", n).withColumn("score", F.when(F.col("page_row") > cap, F.col("score") * factor).otherwise(F.col("score")))


def quotas(rows: DataFrame, limit: int = S.entity_limit, query: str = "query_id") -> DataFrame:
    """Rows (query_id, id, kind seed|global|neighbor, weight): quotas of seeds and globals; neighbours fill the rest."""
    third = limit // 3
    w = Window.partitionBy(query, "kind").orderBy(F.desc("weight"), "id")
    ranked = rows.withColumn("k", F.row_number().over(w))
    fixed = ranked.where(((F.col("kind") == "seed") & (F.col("k") <= max(10, third))) | ((F.col("kind") == "global") & (F.col("k") <= max(5, third))))
    used = fixed.groupBy(query).agg(F.count("*").alias("used"))
    rest = ranked.where("kind = 'neighbor'").join(used, query, "left").where(F.col("k") <= limit - F.coalesce("used", F.lit(0))).drop("used")
    return fixed.unionByName(rest)


def mmr(rows: DataFrame, k: int, lam: float, url_weight: float = R.mmr_url_weight) -> DataFrame:
    """Greedy diversification of pools (query_id, id, score, url, tokens array): at most ``k`` rows a query, with their order.

    Pools are first-stage candidates, at most ``first_stage_top_k`` a query, so a group is small. Ties go to the smallest
    place in the pool.
    """

    def select(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        if lam <= 0 or len(pool) <= k:
            out = pool.head(k)
            return out.assign(mmr_rank=range(1, len(out) + 1))[["query_id", "id", "mmr_rank"]]
        span = pool.score.max() - pool.score.min()
        rel = (pool.score - pool.score.min()) / span if span > 1e-9 else pool.score * 0 + 1.0
        sets, urls = [set(t) for t in pool.tokens], pool.url.tolist()

        def sim(i: int, j: int) -> float:
            either = len(sets[i] | sets[j])
            return max(url_weight if urls[i] == urls[j] else 0.0, len(sets[i] & sets[j]) / either if either else 0.0)

        chosen, left, worst = [0], list(range(1, len(pool))), [0.0] * len(pool)
        while left and len(chosen) < k:
            for i in left:
                worst[i] = max(worst[i], sim(i, chosen[-1]))
            best = max(left, key=lambda i: (round(lam * rel[i] - (1 - lam) * worst[i], 12), -i))
            chosen.append(best)
            left.remove(best)
        out = pool.iloc[chosen]
        return out.assign(mmr_rank=range(1, len(out) + 1))[["query_id", "id", "mmr_rank"]]

    return rows.groupBy("query_id").applyInPandas(select, "query_id long, id long, mmr_rank int")


#: Items that a task packs at once.
CHUNK = 4096


def _starts(tokens: list[int], max_tokens: int, max_items: int) -> list[int]:
    """For each item, where the batch after the one that begins with it begins, as far as the items go."""
    out, end, used = [], 0, 0
    for i, own in enumerate(tokens):
        if end <= i:  # a batch holds one item at least, whatever its size
            end, used = i + 1, own
        while end < len(tokens) and end - i < max_items and used + tokens[end] <= max_tokens:
            used += tokens[end]
            end += 1
        out.append(end)
        used -= own
    return out


def _leads(max_tokens: int, max_items: int):
    """(_g, _chunk, entry, leave, n): for a batch that begins at place ``entry`` of a chunk, the place in the next chunk
    where the first batch there begins, and how many begin here. Rows of the next chunk's head look ahead."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        own = int(pdf["_own"].sum())
        after = _starts(pdf["tokens"].astype(int).tolist(), max_tokens, max_items)
        leave, n = [0] * own, [0] * own
        for i in range(own - 1, -1, -1):
            to = after[i]
            leave[i], n[i] = (to - own, 1) if to >= own else (leave[to], n[to] + 1)
        k = min(own, max_items)
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]] * k, "_chunk": [int(pdf["_at"].iloc[0])] * k, "entry": list(range(k)), "leave": leave[:k], "n": n[:k]})

    return run


def pack(rows: DataFrame, group: str = "grp", max_tokens: int = 8000, max_items: int = 64) -> DataFrame:
    """Batches in order: a new one when estimated tokens or items would run over (a running sum with resets).

    A group of any size is packed in chunks of ``CHUNK`` items, each by a task of its own: a chunk first tells, for every
    place where its first batch may begin, where the next chunk's does; these maps compose, by doubling, to where it does
    begin; then each chunk counts its batches from there. An item above ``max_tokens`` is a batch of its own; a null group
    is a group; null tokens count 0; ordinals are unique in a group.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("n")).alias("_g")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(key, *rows.columns).repartitionByRange(parts, "_g", "ordinal").withColumn("_pid", F.spark_partition_id())
    ranged = written(ranged, "pack")
    before = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_g", "_pid").agg(F.count("*").alias("c")).select("_g", "_pid", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_from"))
    local = F.row_number().over(Window.partitionBy("_g", "_pid").orderBy("ordinal")) - 1
    placed = written(ranged.withColumn("_n", local).join(offsets, ["_g", "_pid"]).withColumn("_pos", F.col("_from") + F.col("_n")).withColumn("_chunk", F.floor(F.col("_pos") / CHUNK)), "pack")
    size = F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")
    ahead = (F.col("_pos") % CHUNK < max_items) & (F.col("_chunk") > 0)
    at = F.explode(F.array_compact(F.array(F.col("_chunk"), F.when(ahead, F.col("_chunk") - 1)))).alias("_at")
    seen = placed.select("_g", "_chunk", "_pos", size, at).withColumn("_own", F.col("_at") == F.col("_chunk"))
    leads = written(seen.groupBy("_g", "_at").applyInPandas(_leads(max_tokens, max_items), "_g string, _chunk long, entry int, leave int, n long"), "pack")
    known = placed.where("_pos = 0").select("_g", F.lit(0).cast("long").alias("_chunk"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("batches"))
    jumps, reach = leads.withColumn("to", F.col("_chunk") + 1), 1
    chunks = (placed.agg(F.max("_chunk")).first()[0] or 0) + 1
    while reach < chunks:
        step = known.join(jumps, ["_g", "_chunk", "entry"]).select("_g", F.col("to").alias("_chunk"), F.col("leave").alias("entry"), (F.col("batches") + F.col("n")).alias("batches"))
        known = written(known.unionByName(step), "pack")
        then = jumps.select("_g", F.col("_chunk").alias("to"), F.col("entry").alias("leave"), F.col("to").alias("beyond"), F.col("leave").alias("left"), F.col("n").alias("more"))
        jumps = written(jumps.join(then, ["_g", "to", "leave"]).select("_g", "_chunk", "entry", F.col("left").alias("leave"), (F.col("n") + F.col("more")).alias("n"), F.col("beyond").alias("to")), "pack")
        reach *= 2

    columns = rows.columns

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        entry, batch = int(pdf["entry"].iloc[0]), int(pdf["batches"].iloc[0])
        after = _starts(pdf["tokens"].fillna(0).astype(int).tolist(), max_tokens, max_items)
        out, begins = [], entry
        for i in range(len(pdf)):
            if i == begins:
                batch, begins = batch + 1, after[i]
            out.append(batch - 1)
        return pdf.assign(batch=out)[[*columns, "batch"]]

    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    return placed.join(known, ["_g", "_chunk"]).groupBy("_g", "_chunk").applyInPandas(count, schema)
