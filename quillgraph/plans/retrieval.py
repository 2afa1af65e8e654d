"""Retrieval, ranking and selection over documents, vectors and questions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.api import Engine
from quillgraph.functions import expr as E
from quillgraph.operators import bm25, modes, providers, rank, search
from quillgraph.plans import graphs
from quillgraph.sources.tables import table

# the stated query sets of searches: all benchmark items, and every vector whose id is divisible by this, against all rows
EVERY = 100


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", E.word_count(F.col("text")).alias("tokens"), F.col("source").alias("url"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return items.join(vecs, "query_id")


def _vectors_asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _vectors_asked(spark, d).where(F.col("query_id") % EVERY == 0)


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    terms = search.idf(search.vocabulary(docs), search.corpus_stats(docs))
    return search.corpus_stats(docs).select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(terms.agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df"), F.round(F.avg("idf"), 6).alias("avg_idf")))


def _index(spark: SparkSession, d: str) -> bm25.Index:
    """The stored sparse index of the documents below ``d``: built by the first query that needs it, then kept."""
    docs = table(spark, d, "documents")
    return bm25.stored(docs, bm25.kept_path(spark, hashlib.md5(d.encode()).hexdigest()), bm25.version(docs))


def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark items against the stored index."""
    return bm25.search(_index(spark, d), table(spark, d, "benchmark"), 20, query_id="item_id").select("query_id", "doc_id", "score", "rank")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    return search.bm25(table(spark, d, "documents"), items, 20).select("query_id", "doc_id", "score", "rank")


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(table(spark, d, "embeddings"), _asked(spark, d).drop("qlabel"), 10).select("query_id", "id", "score", "rank")


def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(table(spark, d, "embeddings"), _asked(spark, d), 10, other=True, same=("label", "qlabel")).select("query_id", "id", "score", "rank")


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(table(spark, d, "embeddings"), _asked(spark, d).drop("qlabel"), 3).select("query_id", "id", "score", "rank")


def vector_fetch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    want = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    hit = e.join(want, "vec_id", "left_semi")
    return hit.select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")), 5).alias("norm2"))


def _pool(spark: SparkSession, d: str) -> DataFrame:
    dense = search.knn(table(spark, d, "embeddings"), _asked(spark, d).drop("qlabel"), 50)
    items = table(spark, d, "benchmark")
    sparse = search.bm25(table(spark, d, "documents"), items, 20, index=_index(spark, d)).select("query_id", F.col("doc_id").alias("id"), "score")
    return search.union_pool(dense, sparse)


def dense_sparse_union(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by question with two scores: cosine, and overlap of the document's tokens with the question's."""
    q = _questions(spark, d)
    hits = search.knn(table(spark, d, "embeddings"), q.select("query_id", "qvec"), 50).withColumnRenamed("score", "first")
    rows = hits.join(_blocks(spark, d).withColumnRenamed("doc_id", "id"), "id").join(q.select("query_id", F.col("text").alias("q")), "query_id")
    return rows.withColumn("rerank", F.round(providers.OverlapReranker().score(F.col("q"), F.col("text")), 6))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rank.rrf_fuse(_pairs(spark, d), "rerank", "first").select("query_id", "id", "rank_a", "rank_b", "rrf")


def alpha_fusion(spark: SparkSession, d: str) -> DataFrame:
    return rank.alpha_fuse(_pairs(spark, d), "rerank", "first", 0.6).select("query_id", "id", "fused")


def _by_mode(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    a = p.select("query_id", F.lit("mode_a").alias("mode"), "id", F.col("first").alias("score"))
    b = p.where("id % 2 = 0").select("query_id", F.lit("mode_b").alias("mode"), "id", F.col("rerank").alias("score"))
    c = p.where("id % 3 = 0").select("query_id", F.lit("mode_c").alias("mode"), "id", (F.col("id") % 7).cast("double").alias("score"))
    return a.unionByName(b).unionByName(c)


def minmax_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_mode(spark, d).withColumn("g", F.concat_ws("|", "query_id", "mode"))
    return rows.select("query_id", "mode", "id", F.round(rank.min_max("score", "g", 0.0), 6).alias("flat_zero"), F.round(rank.min_max("score", "g", 1.0), 6).alias("flat_one"))


def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    return rank.merge_modes(_by_mode(spark, d))


def block_heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").join(_blocks(spark, d).withColumnRenamed("doc_id", "vec_id"), "vec_id")
    first = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("qvec"))
    rows = rows.crossJoin(F.broadcast(first))
    score = E.block_score(E.cosine(F.col("qvec"), F.col("embedding")), F.col("label"), F.col("tokens"))
    return rows.select("vec_id", F.round(score, 6).alias("score"))


def budgeted_selection(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("id"), "tokens")
    rows = search.top_per(b, "query_id", ["id"], 50)
    return rank.budgeted(rows, 10, 2000).select("query_id", "id", "rank", "tokens", "tokens_before")


def same_page_discount(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select((F.col("doc_id") % 5).alias("query_id"), F.col("doc_id").alias("id"), (1000.0 - F.col("doc_id") % 97).alias("score"), F.substring("url", 1, 4).alias("url"))
    rows = search.top_per(b, "query_id", [F.desc("score"), "id"], 50)
    return rank.same_page_discount(rows).select("query_id", "id", "rank", "page_row", "score")


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select("query_id", "id", F.col("first").alias("score"), "url", E.overlap_tokens(F.substring("text", 1, 1500)).alias("tokens"))
    return rank.mmr(p, 10, 0.5)


def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).select(F.col("url").alias("grp"), F.col("doc_id").alias("ordinal"), F.col("tokens").cast("long").alias("tokens"))
    return rank.pack(b, max_tokens=3000, max_items=8)


def relevance_hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Whether a vector's nearest others have its label, over all vectors."""
    asked = _vectors_asked(spark, d)
    hits = search.knn(table(spark, d, "embeddings"), asked.drop("qlabel"), 5, other=True, many=True)
    rows = hits.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").join(asked.select("query_id", "qlabel"), "query_id")
    alike = F.when(F.col("label") == F.col("qlabel"), 1).otherwise(0)
    per = rows.groupBy("query_id").agg(F.max(alike).alias("hit"), F.sum(alike).alias("relevant"))
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg("hit"), 6).alias("hit_at_5"), F.round(F.avg(F.col("relevant") / 5), 6).alias("precision_at_5"))


def overlap_nway(spark: SparkSession, d: str) -> DataFrame:
    """N-way overlap of the blocks that three systems return: shared by all over returned by any."""
    m = _by_mode(spark, d)
    per = m.groupBy("query_id", "id").agg(F.count_distinct("mode").alias("n"))
    return per.groupBy("query_id").agg(F.round(F.count_if(F.col("n") == 3) / F.count("*"), 6).alias("overlap"))


def group_by_page(spark: SparkSession, d: str) -> DataFrame:
    """Citations: pages in order of their first block, numbered from one."""
    from pyspark.sql import Window

    b = search.top_per(_blocks(spark, d).select((F.col("doc_id") % 5).alias("query_id"), F.col("doc_id").alias("id"), "url"), "query_id", ["id"], 30)
    pages = b.groupBy("query_id", "url").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n_blocks"))
    return pages.withColumn("citation", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")))


def mode_a(spark: SparkSession, d: str) -> DataFrame:
    return modes.direct(_blocks(spark, d), table(spark, d, "embeddings"), _questions(spark, d), index=_index(spark, d))


def prompt_and_answer(spark: SparkSession, d: str) -> DataFrame:
    picked = mode_a(spark, d).join(_blocks(spark, d).select(F.col("doc_id").alias("id"), F.substring("text", 1, 120).alias("content")), "id")
    rows = picked.join(_questions(spark, d).select("query_id", F.col("text").alias("query")), "query_id")
    return providers.ExtractiveGenerator().answer(rows)


def mode_b(spark: SparkSession, d: str) -> DataFrame:
    docs, vecs = table(spark, d, "documents"), table(spark, d, "embeddings")
    pages = vecs.select(F.concat(F.lit("u"), F.col("vec_id").cast("string")).alias("url"), "embedding")
    ids = vecs.select("vec_id")
    links = ids.select(F.concat(F.lit("u"), F.col("vec_id").cast("string")).alias("from_url"), F.concat(F.lit("u"), ((F.col("vec_id") * 3) % 500).cast("string")).alias("to_url"))
    home = F.concat(F.lit("u"), (F.col("doc_id") - F.col("doc_id") % 10).cast("string"))
    blocks = docs.join(vecs.where("vec_id % 7 <> 0").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").select(F.col("doc_id").alias("block_id"), home.alias("url"), F.col("doc_id").alias("ordinal"), "embedding")
    return modes.navigation(pages, links, blocks, _asked(spark, d).drop("qlabel"))


def _engine(spark: SparkSession, d: str) -> Engine:
    """Documents as blocks and pages, each linked to three times its number; parts as entities, with the vector of their
    number, mentioned by the documents of the numbers of their orders; the star schema as the graph."""
    vecs, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    url = lambda n: F.concat(F.lit("u"), n.cast("string"))
    blocks = docs.select("doc_id", "text", E.word_count(F.col("text")).alias("tokens"), url(F.col("doc_id")).alias("url"))
    last = vecs.agg((F.max("vec_id") + 1).alias("n"))
    links = vecs.crossJoin(F.broadcast(last)).select(url(F.col("vec_id")).alias("from_url"), url((F.col("vec_id") * 3) % F.col("n")).alias("to_url"))
    part = lambda n: F.concat(F.lit("P"), n.cast("string"))
    lines = table(spark, d, "lineitem").select(part(F.col("l_partkey")).alias("entity_id"), F.col("l_orderkey").alias("doc_id"))
    mentions = lines.select("entity_id", F.col("doc_id").alias("block_id"), F.lit(None).cast("double").alias("cosine"))  # urls and sizes are the blocks'
    entities = vecs.select(part(F.col("vec_id")).alias("id"), "embedding")
    tables = {"blocks": blocks, "vectors": vecs, "pages": vecs.select(url(F.col("vec_id")).alias("url"), "embedding"), "links": links,
              "edges": graphs.edges(spark, d), "mentions": mentions, "entities": entities}
    return Engine(tables, index=lambda: _index(spark, d))  # mode D reads no text by words


def query_api(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark questions, routed by rules and run."""
    return _engine(spark, d).query(_questions(spark, d))


def hybrid_query(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark questions in modes A, B and C, merged."""
    return _engine(spark, d).query(_questions(spark, d), mode="hybrid")


def query_mode_d(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark questions in mode D, asked for by name."""
    return _engine(spark, d).query(_questions(spark, d), mode="mode_d")


def query_trace(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).trace(_questions(spark, d), mode="hybrid")


QUERIES = {f.__name__: f for f in (
    query_api, hybrid_query, query_mode_d, query_trace, bm25_corpus_stats, bm25_topk, bm25_stored, knn_topk, knn_filtered, knn_batch, vector_fetch, dense_sparse_union, rrf_fusion, alpha_fusion,
    minmax_modes, hybrid_merge, block_heuristic_score, budgeted_selection, same_page_discount, mmr_select, pack_batches,
    relevance_hit_at_k, overlap_nway, group_by_page, mode_a, prompt_and_answer, mode_b,
)}

_TOK = "regexp_extract_all(lower({t}), '[a-z0-9]+')"
_WC = r"(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]')) + len(regexp_extract_all(text, '\S+')))"
_COS = "coalesce(list_dot_product(a.embedding::double[], b.embedding::double[]) / nullif(sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 0), 0.0)"
_BM25 = f"""
tk as (select doc_id, {_TOK.format(t='text')} as t from documents),
st as (select count(*) as n_docs, avg(len(t)) as avgdl from tk),
po as (select doc_id, term, count(*) as tf, any_value(l) as l from (select doc_id, unnest(t) as term, len(t) as l from tk) group by doc_id, term),
df as (select term, count(*) as df from po group by term),
raw as (select term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) as r from df, st),
idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw),
qt as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest({_TOK.format(t='text')}) as term from benchmark) group by 1, 2),
sc as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avgdl))), 6) as score from po join qt using (term) join idf using (term), st group by 1, 2),
al as (select item_id as query_id, d.doc_id, coalesce(score, 0.0) as score from (select item_id from benchmark) b cross join documents d left join sc on sc.query_id = b.item_id and sc.doc_id = d.doc_id),
bm as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from al qualify rank <= 20)"""


def _knn(name: str, k: int, where: str = "true", asked: str = "a.vec_id % 100 = 0") -> str:
    return f"""{name}_s as (select a.vec_id as query_id, b.vec_id as id, round({_COS}, 6) as score from embeddings a, embeddings b where {asked} and {where}),
{name} as (select query_id, id, score, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from {name}_s qualify rank <= {k})"""


_OT = "list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z0-9\\x{{4e00}}-\\x{{9fff}}]+'), lambda x: length(x) >= 2))"
_PAIRS = f"""{_knn('kn', 50, asked='a.vec_id in (select item_id from benchmark)')},
pairs as (select k.query_id, k.id, k.score as first, d.source as url, d.text,
  round(case when len({_OT.format(t='q.text')}) > 0 then len(list_intersect({_OT.format(t='q.text')}, {_OT.format(t='substr(d.text, 1, 1500)')})) / len({_OT.format(t='q.text')}) else 0.0 end, 6) as rerank
  from kn k join documents d on d.doc_id = k.id join benchmark q on q.item_id = k.query_id)"""
_MODES = f"""{_PAIRS},
modes as (select query_id, 'mode_a' as mode, id, first as score from pairs union all select query_id, 'mode_b', id, rerank from pairs where id % 2 = 0
  union all select query_id, 'mode_c', id, cast(id % 7 as double) from pairs where id % 3 = 0)"""
_MODE_A = f"""{_BM25}, {_knn('kn', 50, asked='a.vec_id in (select item_id from benchmark)')},
pool as (select coalesce(k.query_id, b.query_id) as query_id, coalesce(k.id, b.doc_id) as id, k.rank as dense_rank, b.rank as bm25_rank from kn k full join bm b on b.query_id = k.query_id and b.doc_id = k.id),
fu as (select *, round(coalesce(1.0 / (60 + dense_rank), 0.0) + coalesce(1.0 / (60 + bm25_rank), 0.0), 6) as rrf from pool),
ra as (select *, cast(row_number() over (partition by query_id order by rrf desc, id) as integer) as rank from fu qualify rank <= 50),
si as (select r.*, {_WC} as tokens from ra r join documents d on d.doc_id = r.id),
bu as (select *, coalesce(sum(tokens) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as tokens_before, row_number() over (partition by query_id order by rank) as n from si),
ma as (select query_id, id, rank, rrf, dense_rank, bm25_rank, cast(tokens_before as bigint) as tokens_before from bu where tokens_before < 4000 and n <= 10)"""

_B = f"""
b_s as (select a.vec_id as query_id, 'u' || b.vec_id as url, round({_COS}, 6) as score from embeddings a, embeddings b where a.vec_id in (select item_id from benchmark)),
b_f as (select query_id, url from b_s qualify row_number() over (partition by query_id order by score desc, url) <= 5),
b_l as (select 'u' || vec_id as from_url, 'u' || (vec_id * 3) % (select max(vec_id) + 1 from embeddings) as to_url from embeddings),
b_w as (select * from b_f union select query_id, to_url from b_f join b_l on from_url = url),
b_sc as (select w.query_id, d.doc_id as id, case when b.embedding is null then 0.5 else round({_COS}, 6) end as score from b_w w join documents d on 'u' || d.doc_id = w.url left join embeddings b on b.vec_id = d.doc_id join embeddings a on a.vec_id = w.query_id),
bb as (select query_id, id, score from b_sc qualify row_number() over (partition by query_id order by score desc, id) <= 50)"""


def _c(limit: int, seeds: int, m: int, name: str = "cc", spent: str = "") -> str:
    """Blocks of the ten nearest parts and their neighbours, as modes C and D choose them."""
    return f"""
c_s as (select a.vec_id as query_id, 'P' || b.vec_id as id, round({_COS}, 6) as weight from embeddings a, embeddings b where a.vec_id in (select item_id from benchmark)
  qualify row_number() over (partition by a.vec_id order by round({_COS}, 6) desc, 'P' || b.vec_id) <= 10),
{graphs.neighbors_sql('select distinct id as seed from c_s', m)},
c_nb as (select query_id, nbr as id, max(path_weight) as weight from c_s join near on near.seed = c_s.id group by 1, 2),
cand as (select query_id, id, weight::double as weight, 'seed' as kind from c_s union all select query_id, id, weight, 'neighbor' from c_nb where not exists (select 1 from c_s where c_s.query_id = c_nb.query_id and c_s.id = c_nb.id)),
{graphs.quota_sql(seeds, seeds, limit)},
c_m as (select 'P' || l_partkey as entity_id, d.doc_id as block_id, {_WC} as tokens from lineitem join documents d on d.doc_id = l_orderkey),
c_cov as (select query_id, block_id as id, count(distinct p.id) as coverage, max(tokens) as tokens from picked p join c_m on c_m.entity_id = p.id group by 1, 2),
c_sc as (select *, round(0.35 * (least(coverage, 5) / 5.0) + 0.15 * greatest(0.0, 1.0 - tokens / 300.0), 6) as score from c_cov),
c_ra as (select *, row_number() over (partition by query_id order by score desc, id) as rank from c_sc qualify rank <= 50),
c_bu as (select *, coalesce(sum(tokens) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as tokens_before from c_ra),
{spent}{name} as (select query_id, id, score, rank from c_bu {'left join c_sp using (query_id)' if spent else ''} where tokens_before {'+ coalesce(spent, 0)' if spent else ''} < 4000 and rank <= 10)"""


_MERGED = """
m as (select *, min(score) over w as a0, max(score) over w as a1 from modes window w as (partition by query_id, mode)),
g as (select query_id, id::varchar as id, round(max((score - a0) / case when a1 - a0 > 1e-9 then a1 - a0 else 1.0 end), 6) as score, string_agg(distinct mode, ',' order by mode) as from_modes from m group by 1, 2),
h as (select query_id, id, score, from_modes, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from g qualify rank <= 15)"""
_SPENT = """c_e as (select x.query_id, least(src, dst) as a, greatest(src, dst) as b from sub join picked x on x.id = src join picked y on y.id = dst and y.query_id = x.query_id where src <> dst),
c_sp as (select query_id, least(count(*), 40) * 20 as spent from c_e group by 1),
"""
_HYBRID = f"""with {_MODE_A}, {_B}, {graphs.ALL_SQL}, {_c(30, 10, 10)},
modes as (select query_id, 'mode_a' as mode, id, rrf::double as score from ma union all select query_id, 'mode_b', id, score from bb union all select query_id, 'mode_c', id, score from cc), {_MERGED}"""

ORACLE_SQL = {
    "hybrid_query": f"{_HYBRID} select * from h",
    "query_trace": f"""{_HYBRID} select 1 as step, 'routing' as label, 3 * count(*) as n from benchmark b where item_id in (select vec_id from embeddings) union all select 2, 'mode_a', (select count(*) from ma)
  union all select 3, 'mode_b', (select count(*) from bb) union all select 4, 'mode_c', (select count(*) from cc) union all select 5, 'merge', (select count(*) from h)""",
    "query_mode_d": f"with {graphs.ALL_SQL}, {_c(25, 10, 8, 'dd', _SPENT)}, modes as (select query_id, 'mode_d' as mode, id, score from dd), {_MERGED} select * from h",
    "bm25_corpus_stats": f"with {_BM25} select n_docs, round(avgdl, 6) as avgdl, (select count(*) from idf) as n_terms, (select max(df) from idf) as max_df, (select round(avg(idf), 6) from idf) as avg_idf from st",
    "bm25_topk": f"with {_BM25} select query_id, doc_id, score, rank from bm",
    "bm25_stored": f"with {_BM25} select query_id, doc_id, score, rank from bm",
    "knn_topk": f"with {_knn('kn', 10)} select * from kn",
    "knn_filtered": f"with {_knn('kn', 10, 'a.label = b.label and a.vec_id <> b.vec_id')} select * from kn",
    "knn_batch": f"with {_knn('kn', 3)} select * from kn",
    "vector_fetch": "select vec_id, len(embedding) as dim, round(list_dot_product(embedding::double[], embedding::double[]), 5) as norm2 from embeddings where vec_id in (select doc_id from documents)",
    "dense_sparse_union": f"""with {_BM25}, {_knn('kn', 50)} select query_id, id, score, cast(null as double) as bm25_score, 'dense' as source from kn
  union all select query_id, doc_id, 0.0, score, 'bm25' from bm where not exists (select 1 from kn where kn.query_id = bm.query_id and kn.id = bm.doc_id)""",
    "rrf_fusion": f"""with {_PAIRS}, r as (select query_id, id, cast(row_number() over (partition by query_id order by rerank desc, id) as integer) as rank_a, cast(row_number() over (partition by query_id order by first desc, id) as integer) as rank_b from pairs)
  select *, round(1.0 / (60 + rank_a) + 1.0 / (60 + rank_b), 6) as rrf from r""",
    "alpha_fusion": f"""with {_PAIRS}, m as (select *, min(rerank) over w as a0, max(rerank) over w as a1, min(first) over w as b0, max(first) over w as b1 from pairs window w as (partition by query_id))
  select query_id, id, round(0.6 * case when a1 - a0 > 1e-9 then (rerank - a0) / (a1 - a0) else 0.0 end + 0.4 * case when b1 - b0 > 1e-9 then (first - b0) / (b1 - b0) else 0.0 end, 6) as fused from m""",
    "minmax_modes": f"""with {_MODES}, m as (select *, min(score) over w as a0, max(score) over w as a1 from modes window w as (partition by query_id, mode))
  select query_id, mode, id, round(case when a1 - a0 > 1e-9 then (score - a0) / (a1 - a0) else 0.0 end, 6) as flat_zero, round(case when a1 - a0 > 1e-9 then (score - a0) / (a1 - a0) else 1.0 end, 6) as flat_one from m""",
    "hybrid_merge": f"""with {_MODES}, m as (select *, min(score) over w as a0, max(score) over w as a1 from modes window w as (partition by query_id, mode)),
  g as (select query_id, id, round(max((score - a0) / case when a1 - a0 > 1e-9 then a1 - a0 else 1.0 end), 6) as score, string_agg(distinct mode, ',' order by mode) as from_modes from m group by 1, 2)
  select query_id, id, score, from_modes, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from g qualify rank <= 15""",
    "block_heuristic_score": f"""select b.vec_id, round(0.5 * {_COS} + 0.35 * (least(b.label, 5) / 5.0) + 0.15 * greatest(0.0, 1.0 - {_WC} / 300.0), 6) as score
  from embeddings b join documents d on d.doc_id = b.vec_id, (select embedding from embeddings where vec_id = 0) a""",
    "budgeted_selection": f"""with b as (select doc_id % 20 as query_id, doc_id as id, {_WC} as tokens, cast(row_number() over (partition by doc_id % 20 order by doc_id) as integer) as rank from documents qualify rank <= 50),
  w as (select *, coalesce(sum(tokens) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as tokens_before from b)
  select query_id, id, rank, tokens, cast(tokens_before as bigint) as tokens_before from w where tokens_before < 2000 and rank <= 10""",
    "same_page_discount": """with b as (select doc_id % 5 as query_id, doc_id as id, cast(1000.0 - doc_id % 97 as double) as score, substr(source, 1, 4) as url from documents),
  r as (select *, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from b qualify rank <= 50),
  p as (select *, cast(row_number() over (partition by query_id, url order by rank) as integer) as page_row from r)
  select query_id, id, rank, page_row, case when page_row > 5 then score * 0.5 else score end as score from p""",
    "pack_batches": f"""with recursive b as (select source as grp, doc_id as ordinal, {_WC}::bigint as tokens, row_number() over (partition by source order by doc_id) as i from documents),
  r as (select grp, ordinal, tokens, i, 0 as batch, tokens as used, 1 as items from b where i = 1 union all
    select b.grp, b.ordinal, b.tokens, b.i, batch + (used + b.tokens > 3000 or items >= 8)::int, case when used + b.tokens > 3000 or items >= 8 then b.tokens else used + b.tokens end, case when used + b.tokens > 3000 or items >= 8 then 1 else items + 1 end
    from r join b on b.grp = r.grp and b.i = r.i + 1)
  select grp, ordinal, tokens, batch from r""",
    "relevance_hit_at_k": f"""with {_knn('kn', 5, 'a.vec_id <> b.vec_id', 'true')}, r as (select k.query_id, max(case when x.label = y.label then 1 else 0 end) as hit, sum(case when x.label = y.label then 1 else 0 end) as relevant
  from kn k join embeddings x on x.vec_id = k.query_id join embeddings y on y.vec_id = k.id group by 1)
  select count(*) as n_queries, round(avg(hit), 6) as hit_at_5, round(avg(relevant / 5), 6) as precision_at_5 from r""",
    "overlap_nway": f"with {_MODES}, p as (select query_id, id, count(distinct mode) as n from modes group by 1, 2) select query_id, round(count(*) filter (n = 3) / count(*), 6) as overlap from p group by 1",
    "group_by_page": """with b as (select doc_id % 5 as query_id, doc_id as id, source as url, cast(row_number() over (partition by doc_id % 5 order by doc_id) as integer) as rank from documents qualify rank <= 30),
  p as (select query_id, url, min(rank) as first_rank, count(*) as n_blocks from b group by 1, 2)
  select *, cast(row_number() over (partition by query_id order by first_rank) as integer) as citation from p""",
    "mode_a": f"with {_MODE_A} select * from ma",
    "prompt_and_answer": f"""with {_MODE_A}, c as (select m.query_id, m.rank, substr(d.text, 1, 120) as content, q.text as query from ma m join documents d on d.doc_id = m.id join benchmark q on q.item_id = m.query_id)
  select query_id, 'Answer from the numbered passages only.' || chr(10) || chr(10) || 'Question: ' || any_value(query) || chr(10) || chr(10) || string_agg('[' || rank || '] ' || content, chr(10) order by rank) as prompt,
  string_agg(regexp_extract(content, '^[^.!?]*[.!?]?') || ' [' || rank || ']', ' ' order by rank) as answer from c group by query_id""",
    "mode_b": f"""with p as (select 'u' || vec_id as url, embedding from embeddings),
  ps as (select a.vec_id as query_id, b.url, round({_COS}, 6) as score from embeddings a, p b where a.vec_id % 100 = 0),
  pf as (select query_id, url from (select *, row_number() over (partition by query_id order by score desc, url) as rk from ps) where rk <= 5),
  l as (select 'u' || vec_id as from_url, 'u' || (vec_id * 3) % 500 as to_url from embeddings),
  w as (select * from pf union select query_id, to_url from pf join l on from_url = url),
  bl as (select doc_id as block_id, 'u' || (doc_id - doc_id % 10) as url, doc_id as ordinal, e.embedding from documents d left join (select * from embeddings where vec_id % 7 <> 0) e on e.vec_id = d.doc_id),
  sc as (select w.query_id, w.url, b.block_id, b.ordinal, case when b.embedding is null then 0.5 else round({_COS}, 6) end as score from w join bl b on b.url = w.url join embeddings a on a.vec_id = w.query_id),
  pp as (select *, row_number() over (partition by query_id, url order by score desc, ordinal, block_id) as n from sc qualify n <= 10),
  f as (select query_id, block_id, max({{'s': score, 'u': url}}) as m from pp group by 1, 2)
  select query_id, block_id, m.u as url, m.s as score, cast(row_number() over (partition by query_id order by m.s desc, block_id) as integer) as rank from f qualify rank <= 50""",
    "mmr_select": f"""with recursive {_PAIRS},
  po as materialized (select query_id, id, url, {_OT.format(t='substr(text, 1, 1500)')} as toks, row_number() over (partition by query_id order by first desc, id) as i,
    case when max(first) over w - min(first) over w > 1e-9 then (first - min(first) over w) / (max(first) over w - min(first) over w) else 1.0 end as rel from pairs window w as (partition by query_id)),
  pr as materialized (select a.query_id, a.i, b.i as j, a.url = b.url as same, len(a.toks) + len(b.toks) as n, case when a.url = b.url then 0 else len(list_intersect(a.toks, b.toks)) end as shared
    from po a join po b on a.query_id = b.query_id and a.i < b.i),
  sm as materialized (select query_id, i, j, case when same then 1.0::double when n = shared then 0.0::double else shared::double / (n - shared) end as sim from pr),
  si as materialized (select m.*, rel from (select * from sm union all select query_id, j, i, sim from sm) m join po using (query_id, i)),
  run as (select query_id, 1 as k, [1::bigint] as chosen from po where i = 1 union all
    select query_id, k + 1, list_append(chosen, max({{'v': v, 'n': -i}}).n * -1) from (select r.query_id, r.k, r.chosen, s.i, round(0.5 * s.rel - 0.5 * max(s.sim), 12) as v
      from run r join si s on s.query_id = r.query_id and list_contains(r.chosen, s.j) where r.k < 10 and not list_contains(r.chosen, s.i) group by r.query_id, r.k, r.chosen, s.i, s.rel) group by query_id, k, chosen)
  select query_id, id, cast(list_position(chosen, po.i) as integer) as mmr_rank from (select query_id, max_by(chosen, k) as chosen from run group by 1) join po using (query_id) where list_contains(chosen, po.i)""",
}
