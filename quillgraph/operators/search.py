"""Dense and sparse retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import expr as E
from quillgraph.operators import blocks
from quillgraph.operators import bm25 as sparse
from quillgraph.sources.state import written

EPSILON = sparse.EPSILON


def top_per(rows: DataFrame, group: str, order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; only ``k`` rows a group and task reach the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, len, term, tf) of a corpus."""
    tokens = docs.select(F.col(doc_id).alias("doc_id"), E.ascii_tokens(F.col(text)).alias("tokens"))
    rows = tokens.select("doc_id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return rows.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents and mean length."""
    n = F.size(E.ascii_tokens(F.col(text)))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(n).alias("avgdl"))


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): how many documents hold each term; tasks add up their own before the shuffle."""
    return docs.select(F.explode(F.array_distinct(E.ascii_tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf becomes a quarter of the mean over the vocabulary."""
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    floored = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", floored.alias("idf"))


def bm25(
    docs: DataFrame, queries: DataFrame, k: int, query_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", query_text: str = "text", index: sparse.Index | None = None
) -> DataFrame:
    """(query_id, doc_id, score, rank): Okapi scores, query words with their multiplicity; documents of score 0 fill up to k.

    ``index`` is the stored one of ``docs``; without it one is written for this batch alone.
    """
    return sparse.search(index or sparse.temporary(docs, doc_id, text), queries, k, query_id, query_text)


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", other: bool = False, same: tuple[str, str] | None = None, many: bool = False) -> DataFrame:
    """(query_id, id, score, rank): exact cosine search of (query_id, qvec), with ``other`` among the rows of other ids, with
    ``same`` among those whose column has the value of the query's; ``many`` says that the queries grow with the vectors.

    Vectors and queries meet as dense blocks (:mod:`quillgraph.operators.blocks`), whatever their numbers; a meeting
    leaves ``k`` rows a query. The hits lie as a table: the search runs once however often they are read, and what they are
    joined with need not be shuffled where they are few.
    """
    scored = blocks.nearest(vectors, queries, k, id_col, vec, other=other, same=same, many=many)
    return written(top_per(scored, "query_id", [F.desc("score"), "id"], k), "knn")


def union_pool(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(query_id, id, score, bm25_score, source): dense hits first; sparse newcomers get score 0."""
    new = sparse.join(dense.select("query_id", "id"), ["query_id", "id"], "left_anti")
    a = dense.select("query_id", "id", "score", F.lit(None).cast("double").alias("bm25_score"), F.lit("dense").alias("source"))
    b = new.select("query_id", "id", F.lit(0.0).alias("score"), F.col("score").alias("bm25_score"), F.lit("bm25").alias("source"))
    return a.unionByName(b)
