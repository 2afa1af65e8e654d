"""Graph queries over the star schema as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.api import Engine
from quillgraph.operators import graph, modes, rank
from quillgraph.sources.tables import table


def _id(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    parts = [
        t("region").select(_id("R", "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("name")),
        t("nation").select(_id("N", "n_nationkey").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("name")),
        t("customer").select(_id("C", "c_custkey").alias("id"), F.lit("customer").alias("type"), F.col("c_name").alias("name")),
        t("supplier").select(_id("S", "s_suppkey").alias("id"), F.lit("supplier").alias("type"), F.col("s_name").alias("name")),
        t("part").select(_id("P", "p_partkey").alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """located_in, part_of, and supplies where a supplier and a part share two lines or more."""
    t = lambda n: table(spark, d, n)
    one = F.lit(1).cast("long").alias("weight")
    made = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight")).where("weight >= 2")
    return (
        t("customer").select(_id("C", "c_custkey").alias("src"), _id("N", "c_nationkey").alias("dst"), F.lit("located_in").alias("relation_type"), one)
        .unionByName(t("supplier").select(_id("S", "s_suppkey").alias("src"), _id("N", "s_nationkey").alias("dst"), F.lit("located_in").alias("relation_type"), one))
        .unionByName(t("nation").select(_id("N", "n_nationkey").alias("src"), _id("R", "n_regionkey").alias("dst"), F.lit("part_of").alias("relation_type"), one))
        .unionByName(made.select(_id("S", "l_suppkey").alias("src"), _id("P", "l_partkey").alias("dst"), F.lit("supplies").alias("relation_type"), "weight"))
    )


def _seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("S1",), ("S2",), ("P7",)], "seed string")


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(nodes(spark, d), edges(spark, d))


def kg_neighbors_k2(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours over all types of edges, of every supplier whose key 20 divides and of all nations, which are hubs."""
    s = table(spark, d, "supplier").where("s_suppkey % 20 = 0").select(_id("S", "s_suppkey").alias("seed"))
    return graph.neighbors(edges(spark, d), s.unionByName(table(spark, d, "nation").select(_id("N", "n_nationkey").alias("seed"))), 2, 10)


def kg_neighbor_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbor_edges(edges(spark, d).where("relation_type = 'supplies'"), "P7", 2, 40)


def kg_induced_edges(spark: SparkSession, d: str) -> DataFrame:
    ids = nodes(spark, d).where("type <> 'customer'")
    anchors = ids.where("type = 'supplier' and cast(substr(id, 2) as int) < 10 or id in ('N1', 'N2', 'N3')")
    return graph.induced(edges(spark, d), ids, anchors, 60)


def kg_ego_network(spark: SparkSession, d: str) -> DataFrame:
    return graph.ego(edges(spark, d), nodes(spark, d), "nation_7")


def kg_edge_sample(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_sample(edges(spark, d), 50).select("src", "dst", "relation_type", "edge_id")


def kg_neighborhood(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighborhood(edges(spark, d), "S3", 2, 80)


def kg_shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_lengths(edges(spark, d), "P7", 4)


def kg_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(edges(spark, d), "P7", "C11", 6)


def graph_nodes_view(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_rows(nodes(spark, d), 12)


def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    mine = e.where("relation_type <> 'supplies'").select("src", "dst", F.lit("first").alias("relation_type"))
    other = e.where("relation_type <> 'supplies' or weight >= 3").select("src", "dst", "relation_type")
    return graph.merge(mine, other).groupBy("relation_type").agg(F.count("*").alias("n_edges"))


def slice_summary(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    layer = lambda c: F.when(F.substring(c, 1, 1).isin("C", "S", "P"), "entity").otherwise("place")
    return e.groupBy("relation_type").agg(F.count_if(layer("src") == layer("dst")).alias("same_layer"), F.count_if(layer("src") != layer("dst")).alias("cross_layer"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages, lines as blocks, parts as the entities they mention."""
    t = table(spark, d, "lineitem")
    block = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return t.select(_id("P", "l_partkey").alias("entity_id"), block.alias("block_id"), F.concat(F.lit("o"), (F.col("l_orderkey") % 100).cast("string")).alias("url"),
                    F.col("l_quantity").cast("int").alias("tokens"), (F.col("l_discount") * 5).alias("cosine"))


def entity_home_page(spark: SparkSession, d: str) -> DataFrame:
    return graph.home_page(_mentions(spark, d), "P7")


def kg_layered_slice(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(_id("P", "p_partkey").alias("entity_id"), F.explode(F.split("p_name", " ")).alias("keyword"))
    out = graph.budgeted_entities(_mentions(spark, d), words, "o42", 80)
    return out.select("entity_id", "hits", F.array_join("topics", ",").alias("topics"), "cost", "spent")


#: A page by its url, one that is not there, a name within many, an alias in another case, an id, and nothing at all.
_ANCHORS = ["https://orders.example.org/5", "https://orders.example.org/none", "bolt", "BRAND#13 ECONOMY", "S3", "no such thing"]


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as pages, their lines as blocks, parts and suppliers as entities."""
    t = lambda n: table(spark, d, n)
    url = lambda c: F.concat(F.lit("https://orders.example.org/"), F.col(c).cast("string"))
    pages = t("orders").select(url("o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("title"))
    block = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    lines = t("lineitem").select("*", block.alias("block_id"), url("l_orderkey").alias("url"))
    content = F.when(F.col("l_linenumber") % 3 == 0, F.lit(" ")).when(F.col("l_linenumber") % 3 == 1, F.concat_ws(" ", F.lit("Line"), F.col("block_id")))
    heading = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws(" > ", F.lit("Lines"), "l_returnflag"))
    blocks = lines.select("block_id", "url", content.alias("content"), heading.alias("heading_context"))
    mentions = lines.select(F.explode(F.array(_id("P", "l_partkey"), _id("S", "l_suppkey"))).alias("entity_id"), "block_id", "url")
    part = t("part").select(_id("P", "p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_brand", "p_type")).alias("aliases"))
    entities = part.unionByName(t("supplier").select(_id("S", "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases")))
    topics = t("part").select(_id("P", "p_partkey").alias("entity_id"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("keyword"))
    return {"pages": pages, "blocks": blocks, "entities": entities, "mentions": mentions, "topics": topics, "edges": edges(spark, d)}


def layered_slice(spark: SparkSession, d: str) -> DataFrame:
    """A budget of 20 nodes cuts pages of many lines."""
    return Engine(_tables(spark, d)).layered_slice(_ANCHORS, 20)


def ego_view(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d)
    return graph.ego_view(_ANCHORS, *[t[n] for n in ("entities", "blocks", "mentions", "topics", "edges")])


def entity_quota_prune(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    kind = F.when(n % 3 == 0, "seed").when(n % 3 == 1, "global").otherwise("neighbor")
    rows = table(spark, d, "part").select((n % 4).alias("query_id"), _id("P", "p_partkey").alias("id"), kind.alias("kind"), F.col("p_retailprice").alias("weight"))
    small = rows.where("kind <> 'seed' or substr(id, 2, 1) = '1'")
    return rank.quotas(small).select("query_id", "id", "kind", "k")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "S1", 0.9), (0, "S2", 0.8), (1, "S3", 0.7)], "query_id long, id string, weight double")


def mode_c(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    more = spark.createDataFrame([(0, "P5", 0.5), (1, "P6", 0.4)], "query_id long, id string, weight double")
    return modes.reasoning(e, _mentions(spark, d), _asked(spark), more)


def mode_d(spark: SparkSession, d: str) -> DataFrame:
    """A question for each region, whose seeds are the region and its nations."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("query_id"), _id("N", "n_nationkey").alias("id"), (1.0 - F.col("n_nationkey") / 100.0).alias("weight"))
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), _id("R", "r_regionkey").alias("id"), F.lit(2.0).alias("weight"))
    return modes.subgraph(edges(spark, d), n.unionByName(r))


QUERIES = {f.__name__: f for f in (
    graph_stats, kg_neighbors_k2, kg_neighbor_edges, kg_induced_edges, kg_ego_network, kg_edge_sample, kg_neighborhood, kg_shortest_path_len,
    kg_shortest_path, graph_nodes_view, graph_merge, slice_summary, entity_home_page, kg_layered_slice, layered_slice, ego_view, entity_quota_prune, mode_c, mode_d,
)}

_NODES = """
nodes as (select 'R' || r_regionkey as id, 'region' as type, r_name as name from region union all select 'N' || n_nationkey, 'nation', n_name from nation
  union all select 'C' || c_custkey, 'customer', c_name from customer union all select 'S' || s_suppkey, 'supplier', s_name from supplier union all select 'P' || p_partkey, 'part', p_name from part)"""
_EDGES = """
edges as (select 'C' || c_custkey as src, 'N' || c_nationkey as dst, 'located_in' as relation_type, 1::bigint as weight from customer
  union all select 'S' || s_suppkey, 'N' || s_nationkey, 'located_in', 1 from supplier union all select 'N' || n_nationkey, 'R' || n_regionkey, 'part_of', 1 from nation
  union all select 'S' || l_suppkey, 'P' || l_partkey, 'supplies', count(*) from lineitem group by l_suppkey, l_partkey having count(*) >= 2)"""
_UND = """
und as (select src as a, dst as b, src || '|' || dst || '|' || relation_type as edge_id, relation_type, weight from sub
  union all select dst, src, src || '|' || dst || '|' || relation_type, relation_type, weight from sub)"""
_SUP = f"{_EDGES}, sub as (select * from edges where relation_type = 'supplies'), {_UND}"
_ALL = f"{_EDGES}, sub as (select * from edges), {_UND}"
_MENTIONS = """
mentions as (select 'P' || l_partkey as entity_id, l_orderkey || '-' || l_linenumber as block_id, 'o' || (l_orderkey % 100) as url, cast(trunc(l_quantity) as integer) as tokens, l_discount * 5 as cosine from lineitem)"""


def _neighbors(seeds: str, m: int) -> str:
    return f"""seeds as ({seeds}),
p1 as (select seed, b as nbr, relation_type, weight::double as w, [edge_id] as trail from seeds join und on a = seed),
p2 as (select seed, u.b as nbr, p1.relation_type, w + u.weight as w, list_append(trail, u.edge_id) as trail from p1 join und u on u.a = p1.nbr where u.edge_id <> p1.trail[1]),
pk as (select *, row_number() over (partition by seed order by w desc, nbr, len(trail), array_to_string(trail, '>')) as k from (select * from p1 union all select * from p2) qualify k <= {m}),
near as (select seed, nbr, min_by(relation_type, k) as relation_type, min_by(w, k) as path_weight from pk group by 1, 2)"""


_QUOTA = """
used as (select query_id, count(*) as used from (select *, row_number() over (partition by query_id, kind order by weight desc, id) as k from cand) where (kind = 'seed' and k <= {s}) or (kind = 'global' and k <= {g}) group by 1),
picked as (select c.query_id, id, kind, weight, cast(k as integer) as k from (select *, row_number() over (partition by query_id, kind order by weight desc, id) as k from cand) c left join used u on u.query_id = c.query_id
  where (kind = 'seed' and k <= {s}) or (kind = 'global' and k <= {g}) or (kind = 'neighbor' and k <= {n} - coalesce(used, 0)))"""

# for queries elsewhere that choose entities in the same way
ALL_SQL, neighbors_sql = _ALL, _neighbors


def quota_sql(seeds: int, globals_: int, limit: int) -> str:
    return _QUOTA.format(s=seeds, g=globals_, n=limit)

_SLICE = f"""{_EDGES},
  ln as (select *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as block_id, 'https://orders.example.org/' || l_orderkey as url from lineitem),
  pg as (select 'https://orders.example.org/' || o_orderkey as url, case when o_orderkey % 2 = 0 then o_orderpriority end as title from orders),
  men as (select distinct * from (select 'P' || l_partkey as entity_id, block_id, url from ln union all select 'S' || l_suppkey, block_id, url from ln)),
  ent as (select 'P' || p_partkey as entity_id, p_name as name, lower(p_name || chr(10) || p_brand || ' ' || p_type) as said from part union all select 'S' || s_suppkey, s_name, lower(s_name) from supplier),
  an as (select unnest([{", ".join("'" + a + "'" for a in _ANCHORS)}]) as anchor),
  pick as (select anchor, min(entity_id) as entity_id from an, ent where not starts_with(anchor, 'http') and (contains(said, lower(anchor)) or entity_id = anchor) group by 1),
  tk as (select * from (select 'P' || p_partkey as entity_id, unnest(string_split(p_name || ' ' || p_type, ' ')) as k from part) where k <> '')"""

ORACLE_SQL = {
    "graph_stats": f"with {_NODES}, {_EDGES} select 'node' as kind, type as name, count(*) as n from nodes group by 2 union all select 'edge', relation_type, count(*) from edges group by 2",
    "kg_neighbors_k2": f"with {_ALL}, {_neighbors('''select 'S' || s_suppkey as seed from supplier where s_suppkey % 20 = 0 union all select 'N' || n_nationkey from nation''', 10)} select * from near",
    "kg_neighbor_edges": f"""with {_SUP}, p1 as (select b as nbr, edge_id as e1, null as e2 from und where a = 'P7'), p2 as (select u.b as nbr, e1, u.edge_id as e2 from p1 join und u on u.a = p1.nbr where u.edge_id <> e1),
  e as (select nbr, e1 as edge_id from p1 union select nbr, e1 from p2 union select nbr, e2 from p2)
  select nbr, e.edge_id, u.relation_type, u.weight from e join (select distinct edge_id, relation_type, weight from und) u on u.edge_id = e.edge_id order by weight desc, nbr, edge_id limit 40""",
    "kg_induced_edges": f"""with {_NODES}, {_EDGES}, v as (select id, type from nodes where type <> 'customer'),
  an as (select id from v where (type = 'supplier' and cast(substr(id, 2) as integer) < 10) or id in ('N1', 'N2', 'N3')),
  r as (select least(src, dst) as a, greatest(src, dst) as b, relation_type, weight, (src in (select id from an) and dst in (select id from an)) as anchored from edges where src in (select id from v) and dst in (select id from v) and src <> dst)
  select a, b, relation_type, weight, anchored from r order by anchored desc, weight desc, a, b, relation_type limit 60""",
    "kg_ego_network": f"with {_NODES}, {_ALL}, c as (select id as center from nodes where contains(lower(name), 'nation_7') order by id limit 1) select center, b as nbr, relation_type, weight from c left join und on a = center",
    "kg_edge_sample": f"with {_EDGES} select src, dst, relation_type, src || '|' || dst || '|' || relation_type as edge_id from edges order by edge_id limit 50",
    "kg_neighborhood": f"""with {_ALL.replace("und as (", "und as materialized (").replace("sub as (", "sub as materialized (")}, p1 as materialized (select b, edge_id as e1 from und where a = 'S3'),
  few as materialized (select b, e1 from p1 where (select count(*) from p1) < 80),
  p2 as materialized (select few.e1, u.edge_id as e2 from few join und u on u.a = few.b where u.edge_id <> few.e1),
  k as materialized (select * from (select e1, null::varchar as e2, 1 as n, e1 as trail from p1 union all select e1, e2, 2, e1 || '>' || e2 from p2) order by n, trail limit 80),
  i as (select e1 as edge_id from k union select e2 from k where e2 is not null)
  select src, dst, edge_id from (select src, dst, src || '|' || dst || '|' || relation_type as edge_id from sub) join i using (edge_id)""",
    "kg_shortest_path_len": f"with recursive {_ALL}, walk as (select 'P7' as id, 0 as hops union select u.b, hops + 1 from walk join und u on u.a = walk.id where hops < 4) select id, min(hops) as hops from walk group by id",
    "graph_nodes_view": f"with {_NODES} select id, case when length(name) > 12 then left(name, 12) || '...' else name end as label, type from nodes",
    "graph_merge": f"""with {_EDGES}, f as (select src, dst, 'first' as relation_type from edges where relation_type <> 'supplies'), s as (select src, dst, relation_type from edges where relation_type <> 'supplies' or weight >= 3)
  select relation_type, count(*) as n_edges from (select * from f union all select * from s where not exists (select 1 from f where f.src = s.src and f.dst = s.dst)) group by 1""",
    "slice_summary": f"""with {_EDGES}, l as (select relation_type, left(src, 1) in ('C', 'S', 'P') as a, left(dst, 1) in ('C', 'S', 'P') as b from edges)
  select relation_type, count(*) filter (a = b) as same_layer, count(*) filter (a <> b) as cross_layer from l group by 1""",
    "entity_home_page": f"with {_MENTIONS} select entity_id, url, count(*) as n from mentions where entity_id = 'P7' group by 1, 2 order by n desc, url limit 1",
    "kg_layered_slice": f"""with {_MENTIONS}, h as (select entity_id, count(*) as hits from mentions where url = 'o42' group by 1),
  t as (select 'P' || p_partkey as entity_id, list_sort(list_distinct(string_split(p_name, ' ')))[1:2] as topics from part),
  r as (select entity_id, hits, coalesce(array_to_string(topics, ','), '') as topics, 1 + coalesce(len(topics), 0) as cost from h left join t using (entity_id)),
  s as (select *, sum(cost) over (order by hits desc, entity_id rows between unbounded preceding and current row) as spent from r)
  select entity_id, hits, topics, cost, cast(spent as bigint) as spent from s where spent <= 80""",
    "ego_view": f"""with {_SLICE},
  und as (select distinct * from (select src as a, dst as b, relation_type from edges union all select dst, src, relation_type from edges) where a <> b),
  nb as (select anchor, p.entity_id, b as nbr, relation_type, name from pick p join und on a = p.entity_id join ent e on e.entity_id = b),
  ob as (select distinct anchor, entity_id, block_id, heading from pick join men using (entity_id) join (select block_id, min(case when l_linenumber % 2 = 0 then 'Lines > ' || l_returnflag end) as heading from ln group by 1) using (block_id)
    qualify row_number() over (partition by anchor order by block_id) <= 5),
  kw as (select distinct anchor, entity_id, k as keyword from pick join tk using (entity_id))
  select anchor, 'node' as kind, entity_id as id, null as dst, 'Entity' as type, name as label from pick join ent using (entity_id)
  union all select distinct anchor, 'node', nbr, null, 'Entity', name from nb union all select anchor, 'node', block_id, null, 'Block', left(coalesce(heading, 'Block'), 50) from ob
  union all select anchor, 'node', keyword, null, 'TopicKeyword', keyword from kw union all select anchor, 'edge', entity_id, nbr, relation_type, null from nb
  union all select anchor, 'edge', entity_id, block_id, 'EXTRACTED_FROM', null from ob union all select anchor, 'edge', entity_id, keyword, 'HAS_TOPIC', null from kw""",
    "kg_shortest_path": f"""with recursive {_ALL}, nx as materialized (select distinct a, b from und where a <> b),
  walk as (select 'P7' as id, 0 as hops union select b, hops + 1 from walk join nx on a = walk.id where hops < 6), lv as materialized (select id, min(hops) as hops from walk group by id),
  led as materialized (select b as id, a, hops + 1 as hops from nx join lv on lv.id = a),
  par as materialized (select id, min(a) as parent from led join lv using (id, hops) group by 1),
  back as (select id, hops from lv where id = 'C11' union all select parent, hops - 1 from back join par using (id))
  select hops as step, id from back""",
    "layered_slice": f"""with {_SLICE},
  dense as (select anchor, url, row_number() over (partition by anchor order by count(distinct block_id) desc, url) as k from pick join men using (entity_id) group by anchor, url),
  site as (select anchor, url from an join pg on url = anchor union all select anchor, url from dense where k = 1 and url in (select url from pg)),
  own as (select distinct anchor, url, block_id, l_linenumber as n, l_returnflag as f from site join ln using (url)),
  hit as (select anchor, entity_id, block_id from site join men using (url)),
  tp as (select entity_id, list_sort(list_distinct(list(k)))[1:2] as topics from tk group by 1),
  run as (select h.anchor, entity_id, topics, 1 + (select count(*) from own where own.anchor = h.anchor) + sum(1 + coalesce(len(topics), 0)) over (partition by h.anchor order by hits desc, entity_id) as spent
    from (select anchor, entity_id, count(*) as hits from hit group by 1, 2) h left join tp using (entity_id)),
  kept as (select * from run where spent <= 20), kw as (select anchor, entity_id, unnest(topics) as keyword from kept)
  select anchor, 'node' as kind, 'page' as layer, url as id, null as dst, 'WebPage' as type, coalesce(title, url) as label from site join pg using (url)
  union all select anchor, 'node', 'block', block_id, null, 'Block', left(case when n % 3 = 1 then 'Line ' || block_id when n % 2 = 0 then f else 'Block' end, 60) from own
  union all select anchor, 'node', 'entity', entity_id, null, 'Entity', name from kept join ent using (entity_id)
  union all select distinct anchor, 'node', 'topic', keyword, null, 'TopicKeyword', keyword from kw
  union all select anchor, 'edge', null, url, block_id, 'CONTAINS', null from own
  union all select anchor, 'edge', null, entity_id, block_id, 'EXTRACTED_FROM', null from hit semi join kept using (anchor, entity_id)
  union all select anchor, 'edge', null, entity_id, keyword, 'HAS_TOPIC', null from kw
  union all select x.anchor, 'edge', null, src, dst, relation_type, null from edges join kept x on x.entity_id = src join kept y on y.entity_id = dst and y.anchor = x.anchor""",
    "entity_quota_prune": f"""with cand as (select p_partkey % 4 as query_id, 'P' || p_partkey as id, case p_partkey % 3 when 0 then 'seed' when 1 then 'global' else 'neighbor' end as kind, p_retailprice as weight from part
  where p_partkey % 3 <> 0 or substr('P' || p_partkey, 2, 1) = '1'), {_QUOTA.format(s=10, g=10, n=30)} select query_id, id, kind, k from picked""",
    "mode_c": f"""with {_ALL}, {_MENTIONS}, sd as (select * from (values (0, 'S1', 0.9), (0, 'S2', 0.8), (1, 'S3', 0.7)) v(query_id, id, weight)), gl as (select * from (values (0, 'P5', 0.5), (1, 'P6', 0.4)) v(query_id, id, weight)),
  {_neighbors('select distinct id as seed from sd', 10)},
  nb as (select query_id, nbr as id, max(path_weight) as weight from sd join near on near.seed = sd.id group by 1, 2),
  cand as (select query_id, id, weight::double as weight, 'seed' as kind from sd union all select query_id, id, weight::double, 'global' from gl
    union all select query_id, id, weight, 'neighbor' from nb where not exists (select 1 from sd where sd.query_id = nb.query_id and sd.id = nb.id) and not exists (select 1 from gl where gl.query_id = nb.query_id and gl.id = nb.id)), {_QUOTA.format(s=10, g=10, n=30)},
  cov as (select query_id, block_id as id, count(distinct p.id) as coverage, min(url) as url, max(tokens) as tokens, max(cosine) as cosine from picked p join mentions m on m.entity_id = p.id group by 1, 2),
  sc as (select *, round(0.5 * coalesce(cosine, 0.0) + 0.35 * (least(coverage, 5) / 5.0) + 0.15 * greatest(0.0, 1.0 - coalesce(tokens, 100) / 300.0), 6) as score from cov),
  ra as (select *, cast(row_number() over (partition by query_id order by score desc, id) as integer) as rank from sc qualify rank <= 50),
  bu as (select *, cast(coalesce(sum(tokens) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as bigint) as tokens_before from ra),
  pg as (select *, cast(row_number() over (partition by query_id, url order by rank) as integer) as page_row from bu where tokens_before < 4000 and rank <= 10)
  select query_id, id, coverage, case when page_row > 5 then score * 0.5 else score end as score, rank, page_row, tokens_before from pg""",
    "mode_d": f"""with {_ALL}, sd as (select n_regionkey::bigint as query_id, 'N' || n_nationkey as id, 1.0::double - n_nationkey / 100.0::double as weight from nation union all select r_regionkey, 'R' || r_regionkey, 2.0 from region), {_neighbors('select distinct id as seed from sd', 8)},
  nb as (select query_id, nbr as id, max(path_weight) as weight from sd join near on near.seed = sd.id group by 1, 2),
  cand as (select query_id, id, weight::double as weight, 'seed' as kind from sd union all select query_id, id, weight, 'neighbor' from nb where not exists (select 1 from sd where sd.query_id = nb.query_id and sd.id = nb.id)), {_QUOTA.format(s=10, g=8, n=25)},
  r as (select x.query_id, least(src, dst) as a, greatest(src, dst) as b, relation_type, e.weight from sub e join picked x on x.id = src join picked y on y.id = dst and y.query_id = x.query_id where src <> dst)
  select *, cast(row_number() over (partition by query_id order by weight desc, a, b, relation_type) as integer) as rank from r qualify rank <= 40""",
}
