"""Store maintenance, builds, caches and usage over the events table: a day is a build, a user an object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import store
from quillgraph.sources.state import folder
from quillgraph.sources.tables import table
from quillgraph.streaming import incremental


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("build", F.date_format("ts", "yyyyMMdd"))


def _latest(rows: DataFrame) -> DataFrame:
    """(user_id, status, value): each user's last event."""
    last = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("m"))
    return last.select("user_id", F.col("m.event_type").alias("status"), F.col("m.value").alias("value"))


def _stamped(spark: SparkSession, d: str, upto: str) -> DataFrame:
    """Objects as of a build: (user_id, status, value, created_build, last_seen_build)."""
    rows = _events(spark, d).where(F.col("build") <= upto)
    seen = rows.groupBy("user_id").agg(F.min("build").alias("created_build"), F.max("build").alias("last_seen_build"))
    return _latest(rows).join(seen, "user_id")


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    old = _stamped(spark, d, "20240104")
    new = _latest(_events(spark, d).where("build = '20240105'"))
    return store.upsert(old, new, ["user_id"], "20240105")


def touch_unchanged(spark: SparkSession, d: str) -> DataFrame:
    old = _stamped(spark, d, "20240104")
    seen = _events(spark, d).where("build = '20240105' and event_type = 'view'")
    out = store.touch(old, "user_id", seen, "20240105")
    return out.groupBy("last_seen_build").agg(F.count("*").alias("n_objects"), F.count_distinct("status").alias("n_status"))


def orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return store.orphan_report(_stamped(spark, d, "20240103"), "status", "user_id", "20240103")


def _objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _stamped(spark, d, "20240103").select(F.col("user_id").alias("id"), "last_seen_build")
    rows = _events(spark, d).where("build <= '20240103'")
    edges = rows.select(F.col("user_id").alias("src"), (F.col("user_id") * 7 % 150).alias("dst"), "build").groupBy("src", "dst").agg(F.max("build").alias("last_seen_build"))
    return nodes, edges


def orphan_delete(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = store.delete_orphans(*_objects(spark, d), "20240103")
    a = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"))
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


def progress_ledger(spark: SparkSession, d: str) -> DataFrame:
    out = store.ledger(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
    return out.groupBy("status").agg(F.count("*").alias("n_keys"), F.min("user_id").alias("first_key"))


def build_ring(spark: SparkSession, d: str) -> DataFrame:
    return store.build_ring(_events(spark, d))


def cache_hits_misses(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    split = store.cache_split(e.where("build = '20240116'"), e.where("build <= '20240103'"), ["user_id", "event_type"])
    return split.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text's value, computed for those that the cache lacks."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("key"), "doc_id")
    cache = docs.where("doc_id % 2 = 0").groupBy("key").agg(F.lit("cached").alias("value"))
    return store.cached(docs, cache, "key", lambda missing: missing.select("key", F.lit("computed").alias("value")))


def relation_accumulate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    rows = t.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("B"), (F.col("l_partkey") % 25).cast("string")).alias("dst"), F.lit("supplies").alias("relation_type"),
                    F.col("l_quantity").alias("weight"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("source_id"), F.repeat("l_returnflag", F.col("l_linenumber")).alias("description"))
    out = store.relations_accumulated(rows)
    return out.select("src", "dst", "relation_type", F.round("weight", 2).alias("weight"), F.array_join("source_ids", ",").alias("source_ids"), "description")


def relation_replace(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    of = lambda rows: rows.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 20).alias("dst"), F.lit("supplies").alias("relation_type")).agg(F.round(F.sum("l_quantity"), 2).alias("weight"))
    return store.relations_replaced(of(t.where("l_orderkey % 2 = 0")), of(t.where("l_orderkey % 5 = 0")))


def contains_after_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    old = t.select(F.col("l_orderkey").alias("url"), F.col("l_partkey").alias("block_id"), F.lit(1).alias("depth"))
    extra = t.where("l_linenumber > 1").select((F.col("l_orderkey") + 1).alias("url"), F.col("l_partkey").alias("block_id"), F.when(F.col("l_partkey") % 2 == 0, F.lit(3)).alias("depth"))
    return store.contains_after_dedup(old, extra)


def reachable_ids(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    contains = t.select(F.col("l_orderkey").alias("url"), F.col("l_partkey").alias("block_id"))
    mentions = t.select(F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("block_id"))
    pages = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("url"))
    return store.reachable(pages, contains, mentions)


def incident_relations(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("relation_type"))
    return store.incident(rel, table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id")))


def edges_with_ends(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    left = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    right = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return store.existing_ends(e, left, right, "l_suppkey", "l_partkey")


def store_consistency(spark: SparkSession, d: str) -> DataFrame:
    return store.consistency(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("doc_id")), "doc_id")


def usage_by_stage(spark: SparkSession, d: str) -> DataFrame:
    """Calls and tokens by stage at two moments, and what came between."""
    e = _events(spark, d)
    total = lambda rows, s: rows.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias(f"calls{s}"), F.round(F.sum("value"), 2).alias(f"tokens{s}"))
    a, b = total(e.where("build <= '20240110'"), "_before"), total(e.where("build <= '20240120'"), "_after")
    j = b.join(a, "stage", "left")
    return j.select("stage", (F.col("calls_after") - F.coalesce("calls_before", F.lit(0))).alias("calls"), F.round(F.col("tokens_after") - F.coalesce("tokens_before", F.lit(0.0)), 2).alias("tokens"))


def frontier_pending(spark: SparkSession, d: str) -> DataFrame:
    from quillgraph.operators import web

    u = table(spark, d, "pages")
    return web.pending(u.select("url"), u.where("page_id % 3 = 0").select("url"), u.where("page_id % 5 = 0").select("url"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by type: the batch form of the streaming window."""
    w = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.date_format("w.start", "yyyyMMdd").alias("day"), "event_type", "n")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)  # a stream reads a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def streaming_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger by micro-batches: the rows of the batch form."""
    out = incremental.drained(incremental.ledger(_event_stream(spark, d), "user_id", "event_type", "ts"), "ledger")
    return out.select("user_id", "status")


def streaming_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts from the stream, late rows within the watermark included."""
    out = incremental.drained(incremental.windowed_counts(_event_stream(spark, d), "ts", "event_type"), "windows")
    return out.select(F.date_format("window.start", "yyyyMMdd").alias("day"), "event_type", "n")


def dual_store_write(spark: SparkSession, d: str) -> DataFrame:
    """Two builds of documents with their vectors: all of them, then every third again, twice in its batch, and every
    ninth blank. What the two stores hold for each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("block_id"), F.col("text").alias("content"))
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("block_id"), "embedding")
    first = docs.join(vecs, "block_id", "left").withColumn("ordinal", F.lit(0))
    third = first.where("block_id % 3 = 0").withColumn("ordinal", F.explode(F.array(F.lit(1), F.lit(2))))
    text = F.when((F.col("block_id") % 9 == 0) & (F.col("ordinal") == 2), " ").otherwise(F.concat("content", F.lit(" again")))
    path = folder(spark, "dual")
    sink = incremental.dual_sink(spark, path, lambda n: f"b{n:06d}")
    sink(first, 0)
    sink(third.withColumn("content", text), 1)
    graph, vectors = incremental.dual_store(spark, path)
    rows = graph.join(vectors.select("block_id", F.size("embedding").alias("dim")), "block_id", "left")
    return rows.select("block_id", "build", F.length("content").alias("n_chars"), "dim")


QUERIES = {f.__name__: f for f in (
    upsert_merge, touch_unchanged, orphan_report, orphan_delete, progress_ledger, build_ring, cache_hits_misses, embedding_cache,
    relation_accumulate, relation_replace, contains_after_dedup, reachable_ids, incident_relations, edges_with_ends, store_consistency,
    usage_by_stage, frontier_pending, event_windows, dual_store_write, streaming_ledger, streaming_windows,
)}

_EV = "ev as (select *, strftime(ts, '%Y%m%d') as build from events)"


def _st(upto: str) -> str:
    return f"""{_EV}, st as (select user_id, max({{'t': ts, 'i': event_id, 's': event_type, 'v': value}}).s as status, max({{'t': ts, 'i': event_id, 's': event_type, 'v': value}}).v as value,
  min(build) as created_build, max(build) as last_seen_build from ev where build <= '{upto}' group by user_id)"""


ORACLE_SQL = {
    "dual_store_write": """select doc_id as block_id, case when doc_id % 3 = 0 then 'b000001' else 'b000000' end as build,
  case when doc_id % 9 = 0 then 1 when doc_id % 3 = 0 then length(text) + 6 else length(text) end as n_chars, case when doc_id % 9 <> 0 and trim(text) <> '' then len(embedding) end as dim from documents left join embeddings on vec_id = doc_id""",
    "upsert_merge": f"""with {_st('20240104')}, nw as (select user_id, max({{'t': ts, 'i': event_id, 's': event_type, 'v': value}}) as m from ev where build = '20240105' group by 1)
  select coalesce(o.user_id, n.user_id) as user_id, case when n.user_id is not null then n.m.s else o.status end as status, case when n.user_id is not null then n.m.v else o.value end as value,
  coalesce(created_build, '20240105') as created_build, case when n.user_id is not null then '20240105' else last_seen_build end as last_seen_build from st o full join nw n on n.user_id = o.user_id""",
    "touch_unchanged": f"""with {_st('20240104')}, s as (select distinct user_id from ev where build = '20240105' and event_type = 'view'), t as (select status, case when s.user_id is not null then '20240105' else last_seen_build end as last_seen_build from st left join s on s.user_id = st.user_id)
  select last_seen_build, count(*) as n_objects, count(distinct status) as n_status from t group by 1""",
    "orphan_report": f"""with {_st('20240103')}, o as (select *, row_number() over (partition by status order by user_id) as k from st where last_seen_build <> '20240103')
  select status, count(*) as n_orphans, string_agg(cast(user_id as varchar), ',' order by cast(user_id as varchar)) filter (k <= 3) as sample from o group by 1""",
    "orphan_delete": f"""with {_st('20240103')}, k as (select user_id as id from st where last_seen_build = '20240103'),
  e as (select user_id as src, user_id * 7 % 150 as dst, max(build) as b from ev where build <= '20240103' group by 1, 2)
  select 'node' as kind, id as a, id as b from k union all select 'edge', src, dst from e where b = '20240103' and src in (select id from k) and dst in (select id from k)""",
    "progress_ledger": "with l as (select user_id, max({'t': ts, 'i': event_id, 's': event_type}).s as status from events group by 1) select status, count(*) as n_keys, min(user_id) as first_key from l group by 1",
    "build_ring": f"with {_EV}, b as (select distinct build from ev), r as (select build, row_number() over (order by build desc) as n from b) select build, case when n = 1 then 'current' else 'previous' end as role from r where n <= 6",
    "cache_hits_misses": f"""with {_EV}, c as (select distinct user_id, event_type from ev where build <= '20240103'), r as (select e.event_type, c.user_id is not null as hit from ev e left join c on c.user_id = e.user_id and c.event_type = e.event_type where build = '20240116')
  select event_type, count(*) filter (hit) as hits, count(*) filter (not hit) as misses from r group by 1""",
    "embedding_cache": "select sha256(text) as key, case when bool_or(doc_id % 2 = 0) then 'cached' else 'computed' end as value from documents group by 1",
    "relation_accumulate": """with r as (select 'S' || l_suppkey as src, 'B' || (l_partkey % 25) as dst, 'supplies' as relation_type, l_quantity as weight, l_orderkey || '-' || l_linenumber as source_id, repeat(l_returnflag, l_linenumber) as description from lineitem)
  select src, dst, relation_type, round(sum(weight), 2) as weight, string_agg(source_id, ',' order by source_id) as source_ids, max({'l': length(description), 'd': description}).d as description from r group by 1, 2, 3""",
    "relation_replace": """with o as (select l_suppkey as src, l_partkey % 20 as dst, 'supplies' as relation_type, round(sum(l_quantity), 2) as weight from lineitem where l_orderkey % 2 = 0 group by 1, 2),
  n as (select l_suppkey as src, l_partkey % 20 as dst, 'supplies' as relation_type, round(sum(l_quantity), 2) as weight from lineitem where l_orderkey % 5 = 0 group by 1, 2)
  select * from n union all select * from o where not exists (select 1 from n where n.src = o.src and n.dst = o.dst)""",
    "contains_after_dedup": """with t as (select * from lineitem), o as (select distinct l_orderkey as url, l_partkey as block_id from t),
  x as (select distinct l_orderkey + 1 as url, l_partkey as block_id, case when l_partkey % 2 = 0 then 3 else 0 end as depth from t where l_linenumber > 1)
  select url, block_id, 1 as depth, false as via_dedup from o union all select url, block_id, depth, true from x where not exists (select 1 from o where o.url = x.url and o.block_id = x.block_id)""",
    "reachable_ids": """with b as (select distinct l_partkey as id from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F'))
  select 'block' as kind, id from b union all select distinct 'entity', l_suppkey from lineitem where l_partkey in (select id from b)""",
    "incident_relations": "select distinct l_suppkey as src, l_partkey as dst, l_returnflag as relation_type from lineitem where l_suppkey in (select p_partkey from part where p_size < 10) or l_partkey in (select p_partkey from part where p_size < 10)",
    "edges_with_ends": "select distinct l_suppkey, l_partkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000) and l_partkey in (select p_partkey from part where p_size < 10)",
    "store_consistency": """select (select count(distinct doc_id) from documents where doc_id not in (select vec_id * 3 from embeddings)) as only_left, (select count(distinct vec_id) from embeddings where vec_id * 3 not in (select doc_id from documents)) as only_right""",
    "usage_by_stage": f"""with {_EV}, a as (select event_type as stage, count(*) as c, round(sum(value), 2) as t from ev where build <= '20240110' group by 1), b as (select event_type as stage, count(*) as c, round(sum(value), 2) as t from ev where build <= '20240120' group by 1)
  select b.stage, b.c - coalesce(a.c, 0) as calls, round(b.t - coalesce(a.t, 0.0), 2) as tokens from b left join a on a.stage = b.stage""",
    "frontier_pending": "select distinct url from pages where page_id % 3 <> 0 and page_id % 5 <> 0 and url not in (select url from pages where page_id % 3 = 0 or page_id % 5 = 0)",
    "streaming_ledger": "select user_id, max({'t': ts, 's': event_type}).s as status from events group by 1",
    "streaming_windows": "select strftime(ts, '%Y%m%d') as day, event_type, count(*) as n from events group by 1, 2",
    "event_windows": "select strftime(ts, '%Y%m%d') as day, event_type, count(*) as n from events group by 1, 2",
}
