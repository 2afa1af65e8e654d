"""Retrieval modes: batches of questions through composed operators. Every step is set-oriented over all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.config import RetrievalParams, ScoringParams
from quillgraph.functions import expr as E
from quillgraph.operators import bm25, graph, rank, search
from quillgraph.sources.state import written

R, S = RetrievalParams(), ScoringParams()


def direct(blocks: DataFrame, vectors: DataFrame, questions: DataFrame, p: RetrievalParams = R, budget: int = S.token_budget, index: bm25.Index | None = None) -> DataFrame:
    """Mode A: dense and sparse hits, fused by rank, cut by the token budget.

    ``questions`` has (query_id, text, qvec); ``blocks`` (doc_id, text, tokens); ``vectors`` (vec_id, embedding).
    Result: (query_id, id, rank, rrf, dense_rank, bm25_rank, tokens_before).
    """
    dense = search.knn(vectors, questions.select("query_id", "qvec"), p.first_stage_top_k).select("query_id", "id", F.col("rank").alias("dense_rank"))
    sparse = search.bm25(blocks, questions, p.bm25_top_k, query_id="query_id", index=index).select("query_id", F.col("doc_id").alias("id"), F.col("rank").alias("bm25_rank"))
    pool = dense.join(sparse, ["query_id", "id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (p.rrf_k + F.col(c)), F.lit(0.0))
    fused = pool.withColumn("rrf", F.round(part("dense_rank") + part("bm25_rank"), 6))
    # few rows, whose true size Spark sees: only their texts are counted, not all
    ranked = written(search.top_per(fused, "query_id", [F.desc("rrf"), "id"], p.first_stage_top_k), "ranked")
    sized = ranked.join(blocks.select(F.col("doc_id").alias("id"), "tokens"), "id")
    return rank.budgeted(sized, p.final_top_k, budget).select("query_id", "id", "rank", "rrf", "dense_rank", "bm25_rank", "tokens_before")


def navigation(pages: DataFrame, links: DataFrame, blocks: DataFrame, questions: DataFrame, p: RetrievalParams = R) -> DataFrame:
    """Mode B: pages by similarity, their links, then the best blocks of each page; (query_id, block_id, url, score, rank).

    A page without comparable blocks gives its first blocks at 0.5. ``pages`` (url, embedding), ``blocks`` (block_id, url,
    ordinal, embedding or null), ``questions`` (query_id, qvec).
    """
    found = search.knn(pages.select("url", "embedding"), questions, p.nav_pages, id_col="url").select("query_id", F.col("id").alias("url"))
    linked = found.join(links.select(F.col("from_url").alias("url"), "to_url"), "url").select("query_id", F.col("to_url").alias("url"))
    wide = found.unionByName(linked).distinct().join(questions, "query_id").join(blocks, "url")
    scored = wide.withColumn("score", F.when(F.col("embedding").isNull(), F.lit(0.5)).otherwise(F.round(E.cosine(F.col("qvec"), F.col("embedding")), 6)))
    per_page = search.top_per(scored.withColumn("_g", F.concat_ws("|", "query_id", "url")), "_g", [F.desc("score"), "ordinal", "block_id"], p.nav_blocks, "_n")
    first = per_page.groupBy("query_id", "block_id").agg(F.max(F.struct("score", "url")).alias("m"))
    rows = first.select("query_id", "block_id", F.col("m.url").alias("url"), F.col("m.score").alias("score"))
    return search.top_per(rows, "query_id", [F.desc("score"), "block_id"], p.first_stage_top_k)


def entities_for(edges: DataFrame, seeds: DataFrame, globals_: DataFrame, hops: int, m: int, limit: int = S.entity_limit) -> DataFrame:
    """(query_id, id, kind, weight): seeds and globals by quota, neighbours of the seeds to fill up."""
    near = graph.neighbors(edges, seeds.select(F.col("id").alias("seed")).distinct(), hops, m)
    by_query = seeds.select("query_id", F.col("id").alias("seed")).join(near, "seed").groupBy("query_id", F.col("nbr").alias("id")).agg(F.max("path_weight").alias("weight"))
    known = seeds.select("query_id", "id").unionByName(globals_.select("query_id", "id"))
    new = by_query.join(known, ["query_id", "id"], "left_anti").withColumn("kind", F.lit("neighbor"))
    own = seeds.select("query_id", "id", "weight").withColumn("kind", F.lit("seed"))
    rest = globals_.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "weight").withColumn("kind", F.lit("global"))
    return rank.quotas(own.unionByName(rest).unionByName(new.select(own.columns)), limit)


def _covering(chosen: DataFrame, mentions: DataFrame, s: ScoringParams, blocks: DataFrame | None = None) -> DataFrame:
    """(query_id, id, coverage, url, tokens, score, rank): blocks that mention chosen entities, by coverage and brevity.

    With ``blocks`` (doc_id, url, tokens) urls and sizes are those of the blocks that are covered, taken once these are known.
    """
    hit = chosen.join(mentions.withColumnRenamed("entity_id", "id"), "id")
    of_block = [F.count_distinct("id").alias("coverage"), F.max("cosine").alias("cosine")]
    if blocks is None:
        covered = hit.groupBy("query_id", "block_id").agg(*of_block, F.min("url").alias("url"), F.max("tokens").alias("tokens"))
    else:
        covered = written(hit.groupBy("query_id", "block_id").agg(*of_block), "covered")
        sized = covered.join(blocks.select(F.col("doc_id").alias("block_id"), "url", "tokens"), "block_id")
        covered = sized.groupBy("query_id", "block_id", "coverage", "cosine").agg(F.min("url").alias("url"), F.max("tokens").alias("tokens"))  # a repeated block is one
    scored = covered.withColumn("score", F.round(E.block_score(F.col("cosine"), F.col("coverage"), F.col("tokens"), s), 6)).withColumnRenamed("block_id", "id")
    return search.top_per(scored, "query_id", [F.desc("score"), "id"], R.first_stage_top_k)


def reasoning(edges: DataFrame, mentions: DataFrame, seeds: DataFrame, globals_: DataFrame, s: ScoringParams = S, k: int = R.final_top_k, hops: int = 2, m: int = 10, blocks: DataFrame | None = None) -> DataFrame:
    """Mode C: entities, their blocks by coverage and brevity, within the token budget.

    ``mentions`` (entity_id, block_id, url, tokens, cosine), without url and tokens where ``blocks`` (doc_id, url, tokens) has
    them. Result: (query_id, id, coverage, score, rank, page_row, tokens_before).
    """
    chosen = written(entities_for(edges, seeds, globals_, hops, m, s.entity_limit), "chosen")
    ranked = _covering(chosen, mentions, s, blocks)
    kept = rank.budgeted(ranked, k, s.token_budget)
    return rank.same_page_discount(kept).select("query_id", "id", "coverage", "score", "rank", "page_row", "tokens_before")


def subgraph(edges: DataFrame, seeds: DataFrame, s: ScoringParams = S, hops: int = 2, m: int = 8) -> DataFrame:
    """Mode D: (query_id, a, b, relation_type, weight): the edges among a question's seeds and their neighbours."""
    return _between(edges, entities_for(edges, seeds, seeds.limit(0), hops, m, s.subgraph_entities), s)


def _between(edges: DataFrame, chosen: DataFrame, s: ScoringParams) -> DataFrame:
    """The edges of :func:`subgraph` among the entities that are chosen for a question."""
    nodes = chosen.select("query_id", "id")
    e = edges.select("src", "dst", "relation_type", "weight")
    inside = e.join(nodes.withColumnRenamed("id", "src"), "src").join(nodes.withColumnRenamed("id", "dst"), ["dst", "query_id"])
    rows = inside.where("src <> dst").select("query_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation_type", "weight")
    return search.top_per(rows, "query_id", [F.desc("weight"), "a", "b", "relation_type"], s.subgraph_edges)


def subgraph_blocks(edges: DataFrame, mentions: DataFrame, seeds: DataFrame, s: ScoringParams = S, k: int = R.final_top_k, hops: int = 2, m: int = 8, edge_tokens: int = 20, blocks: DataFrame | None = None) -> DataFrame:
    """Mode D's blocks (query_id, id, coverage, score, rank, tokens_before): those of the subgraph's entities, within what
    its edges, at ``edge_tokens`` each, leave of the token budget; ``blocks`` as in :func:`reasoning`."""
    chosen = written(entities_for(edges, seeds, seeds.limit(0), hops, m, s.subgraph_entities), "chosen")
    told = _between(edges, chosen, s).groupBy("query_id").agg((F.count("*") * edge_tokens).alias("spent"))
    ranked = _covering(chosen, mentions, s, blocks)
    kept = rank.budgeted(ranked, k, s.token_budget).join(told, "query_id", "left")
    return kept.where(F.col("tokens_before") + F.coalesce("spent", F.lit(0)) < s.token_budget).select("query_id", "id", "coverage", "score", "rank", "tokens_before")
