"""Queries over lookups, points, cached results and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.config import RouterParams
from quillgraph.operators import kg, lookup, router
from quillgraph.plans.graphs import nodes
from quillgraph.sources.tables import table


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), F.col("l_partkey").alias("block_id"), F.col("l_suppkey").alias("entity_id"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("block_id"))


def page_of_block(spark: SparkSession, d: str) -> DataFrame:
    """Parts as blocks on orders as pages; the own url of an even part is its last order, that of an odd one no page."""
    own = F.when(F.col("block_id") % 2 == 0, F.max("url")).otherwise(-1).alias("url")
    asked = _contains(spark, d).join(_blocks(spark, d), "block_id", "left_semi").groupBy("block_id").agg(own)
    return lookup.page_of_block(_contains(spark, d), asked)


def block_entities(spark: SparkSession, d: str) -> DataFrame:
    return lookup.entities_of_blocks(_contains(spark, d), _blocks(spark, d))


def block_parents(spark: SparkSession, d: str) -> DataFrame:
    """Customers as blocks, their nations as parents."""
    parents = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("block_id"), F.col("c_nationkey").alias("parent_id"))
    return lookup.parent_of_block(parents, table(spark, d, "orders").select(F.col("o_custkey").alias("block_id")))


def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    ids = table(spark, d, "documents").select(F.explode(F.array(*[F.concat(F.lit(p), n) for p in "RNCSP"])).alias("id"))
    return lookup.nodes_by_id(nodes(spark, d), ids)


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    old, new = e.where("id % 3 <> 0"), e.where("id % 2 = 0").withColumn("at", F.explode(F.array(F.lit(2), F.lit(1))))
    return lookup.upsert_points(old, new.withColumn("label", F.col("label") + F.col("at") * 100), 64, order="at").select("id", "label", F.size("embedding").alias("dim"))


def point_delete(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return lookup.delete_points(e, e.where("label = 3"))


def cache_store(spark: SparkSession, d: str) -> DataFrame:
    """Results keyed by stage and user, a later write in place of an earlier one."""
    e = table(spark, d, "events").select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("value").alias("response"), F.struct("ts", "event_id").alias("created_at"))
    half = F.date_format("created_at.ts", "yyyyMMdd") <= "20240115"
    return lookup.stored_results(e.where(half), e.where(~half)).select("key", "response")


def rerank_order(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source: some without text, and one source in seven whose reranker failed."""
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        F.col("source").alias("query_id"), n.alias("id"), F.when(n % 5 == 0, F.lit(" ")).otherwise(F.col("text")).alias("content"),
        (1000.0 - n % 97).alias("first_score"), ((n % 13) / 13.0).alias("rerank"),
        F.when(n % 8 > 0, 10_000 - n % 1000).alias("first_rank"),
    )
    out = lookup.reranked(rows, F.length("query_id") == 4)
    return out.select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def sort_missing_last(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("query_id"), n.alias("id"), F.when(n % 3 > 0, n % 7).alias("a"), F.when(n % 4 > 0, F.col("p_size")).alias("b"), (-n).alias("first_rank"))
    return lookup.missing_last(rows, "query_id", ["a", "b"], "id", "first_rank").select("query_id", "id", "rank")


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", lookup.estimated_tokens(F.col("text")).alias("tokens"))


def properties_merge(spark: SparkSession, d: str) -> DataFrame:
    a = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))
    b = F.create_map(F.lit("kind"), F.upper("p_type"), F.concat(F.lit("size"), (F.col("p_size") % 2).cast("string")), F.col("p_size").cast("string"))
    m = lookup.merged_properties(a, b)
    listed = F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return table(spark, d, "part").select("p_partkey", listed.alias("properties"))


def merge_report(spark: SparkSession, d: str) -> DataFrame:
    """A score for each part, its class, and operations by class."""
    score = (0.85 + (F.col("p_partkey") % 15) / 100.0).alias("score")
    log = table(spark, d, "part").select(score).select(kg.score_class(F.col("score")).alias("action"))
    return lookup.merge_report(log)


def citations(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn").cast("string")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), n, F.lit("] and ["), (F.col("turn") + 2).cast("string"), F.lit("]."))
    rows = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), n).alias("query_id"), F.regexp_replace(said, r"\[(?!\d+\])", "(").alias("answer"))
    return lookup.cited(rows)


def router_gates(spark: SparkSession, d: str) -> DataFrame:
    """A model's raw decisions: checked, then the gates for hybrid search and for rewriting."""
    n, p = F.col("doc_id"), RouterParams(disable_hybrid=False)
    raw = table(spark, d, "documents").select(
        "doc_id", F.when(n % 5 == 0, "mode_x").when(n % 5 == 1, "mode_b").when(n % 5 == 2, "mode_c").otherwise("mode_a").alias("mode"),
        F.when(n % 11 > 0, (n % 16) / 10.0 - 0.2).alias("confidence"), F.when(n % 3 == 0, "mode_c").when(n % 3 == 1, "mode_z").alias("alt_mode"),
    )
    out = router.validated(raw, p=p)
    forced = F.when(n % 17 == 0, "hybrid").when(n % 17 == 1, "mode_a")
    return out.select(
        "doc_id", "mode", F.round("confidence", 6).alias("confidence"), "alt_mode",
        router.is_hybrid(forced, F.col("mode"), F.col("alt_mode"), F.col("confidence"), p).alias("hybrid"),
        router.skip_rewrite(F.col("confidence"), 0.7).alias("skips_rewrite"),
    )


QUERIES = {f.__name__: f for f in (
    page_of_block, block_entities, block_parents, node_lookup, vector_upsert, point_delete, cache_store, rerank_order, sort_missing_last,
    token_estimates, properties_merge, merge_report, citations, router_gates,
)}

_P = RouterParams(disable_hybrid=False)
_ASKED = "(select p_partkey from part where p_size < 25)"

ORACLE_SQL = {
    "page_of_block": f"select l_partkey as block_id, case when l_partkey % 2 = 0 then max(l_orderkey) else min(l_orderkey) end as url from lineitem where l_partkey in {_ASKED} group by 1",
    "block_entities": f"select distinct l_partkey as block_id, l_suppkey as entity_id from lineitem where l_partkey in {_ASKED}",
    "block_parents": "select distinct o_custkey as block_id, c_nationkey as parent_id from orders left join (select * from customer where c_acctbal > 0) on c_custkey = o_custkey",
    "node_lookup": """with n as (select 'R' || r_regionkey as id, 'region' as type, r_name as name, r_regionkey as k from region union all select 'N' || n_nationkey, 'nation', n_name, n_nationkey from nation
  union all select 'C' || c_custkey, 'customer', c_name, c_custkey from customer union all select 'S' || s_suppkey, 'supplier', s_name, s_suppkey from supplier union all select 'P' || p_partkey, 'part', p_name, p_partkey from part)
  select id, type, name from n where k in (select doc_id from documents)""",
    "vector_upsert": "select vec_id as id, case when vec_id % 2 = 0 then label + 200 else label end as label, len(embedding) as dim from embeddings where vec_id % 2 = 0 or vec_id % 3 <> 0",
    "point_delete": "select vec_id as id, label from embeddings where vec_id not in (select vec_id from embeddings where label = 3)",
    "cache_store": "select event_type || '|' || user_id as key, max({'t': ts, 'i': event_id, 'v': value}).v as response from events group by 1",
    "rerank_order": """with r as (select source as query_id, doc_id as id, length(source) = 4 as failed, (doc_id % 5 = 0 or trim(coalesce(text, '')) = '') as empty, cast(1000.0 - doc_id % 97 as double) as f, (doc_id % 13) / 13.0 as s, case when doc_id % 8 > 0 then 10000 - doc_id % 1000 end as fr from documents),
  t as (select *, case when failed then null when empty then 0.0 else s end as rs from r)
  select query_id, id, round(rs, 6) as rerank_score, cast(row_number() over (partition by query_id order by case when failed then 0 else cast(empty as integer) end, case when failed then f else rs end desc, fr nulls last, id) as integer) as rank from t""",
    "sort_missing_last": """with r as (select p_brand as query_id, p_partkey as id, case when p_partkey % 3 > 0 then p_partkey % 7 end as a, case when p_partkey % 4 > 0 then p_size end as b from part)
  select query_id, id, cast(row_number() over (partition by query_id order by a desc nulls last, b desc nulls last, -id) as integer) as rank from r""",
    "token_estimates": r"select doc_id, case when coalesce(text, '') = '' then 0 else cast(floor(greatest(len(regexp_extract_all(text, '\S+')), 1) * 1.3) as integer) end as tokens from documents",
    "properties_merge": "select p_partkey, array_to_string(list_sort(['brand=' || p_brand, 'kind=' || upper(p_type), 'size' || (p_size % 2) || '=' || p_size]), ';') as properties from part",
    "merge_report": """with c as (select case when s >= 0.92 then 'auto_merge' when s >= 0.9 then 'review' else 'new_entity' end as action from (select 0.85::double + (p_partkey % 15) / 100.0::double as s from part))
  select action, count(*) as n from c group by 1 union all select 'total', count(*) from c""",
    "citations": r"""with a as (select conv_id || '-' || turn as query_id, regexp_extract_all(coalesce(text, '') || ' [' || turn || '] and [' || (turn + 2) || '].', '\[(\d+)\]', 1) as c from conversations)
  select query_id, cast(g - 1 as integer) as n, cast(c[g] as integer) as citation from (select query_id, c, unnest(range(1, len(c) + 1)) as g from a)""",
    "router_gates": f"""with r as (select doc_id, case doc_id % 5 when 0 then 'mode_a' when 1 then 'mode_b' when 2 then 'mode_c' else 'mode_a' end as mode,
    greatest(0.0, least(1.0, coalesce(case when doc_id % 11 > 0 then (doc_id % 16) / 10.0 - 0.2 end, {_P.default_confidence}))) as confidence, case doc_id % 3 when 0 then 'mode_c' when 1 then 'mode_z' end as raw, doc_id % 17 as f from documents),
  v as (select *, coalesce(case when raw in ('mode_a', 'mode_b', 'mode_c') and raw <> mode then raw end, case when confidence >= {_P.auto_alt_floor} and confidence < {_P.hybrid_threshold} then case mode when 'mode_b' then 'mode_c' else 'mode_b' end end) as alt_mode from r)
  select doc_id, mode, round(confidence, 6) as confidence, alt_mode, (f = 0 or coalesce(f > 1 and alt_mode is not null and confidence < {_P.hybrid_threshold} and mode <> alt_mode, false)) as hybrid, confidence >= 0.7 as skips_rewrite from v""",
}
