"""The property graph as node and edge tables: nodes (id, type, name), edges (src, dst, relation_type, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.sources.state import cut


def with_edge_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", F.concat_ws("|", "src", "dst", "relation_type"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, edge_id, relation_type, weight): every edge from both of its ends."""
    e = with_edge_ids(edges)
    cols = ["edge_id", "relation_type", "weight"]
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), *cols).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), *cols))


def _best(rows: DataFrame, group: list[str], order: list, m: int) -> DataFrame:
    """The first ``m`` rows of each group; tasks leave ``m`` of a group before the shuffle, however large a hub is."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("k") <= m)


def neighbors(edges: DataFrame, seeds: DataFrame, hops: int, m: int) -> DataFrame:
    """(seed, nbr, relation_type, path_weight): neighbours within ``hops`` of (seed).

    Paths repeat no edge; a path weighs the sum of its edges; the m heaviest *paths* of a seed are kept, and of these the
    best for each neighbour. The type is that of the first edge. Work starts at the seeds, so hubs elsewhere cost nothing.

    For two hops no list of paths is made: a first step counts only if it is one of the m + 1 best from its seed to its
    node, and a second step only if it is one of the m + 1 best of its node. One more than m, as a path may not go back by
    the edge it came by; any other path has m that are better.
    """
    u = undirected(edges).withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)))
    path = seeds.select("seed", F.col("seed").alias("at")).join(u.withColumnRenamed("a", "at"), "at")
    order = [F.desc("path_weight"), "nbr", "steps", "trail"]
    columns = ["seed", "nbr", "relation_type", "path_weight", "steps", "trail"]
    first = path.select("seed", F.col("b").alias("nbr"), "relation_type", F.col("weight").alias("path_weight"), F.lit(1).alias("steps"), F.col("edge_id").alias("trail"))
    paths = _best(first, ["seed"], order, m).select(*columns)
    if hops == 2:
        begun = _best(first, ["seed", "nbr"], [F.desc("path_weight"), F.concat("trail", F.lit(">"))], m + 1).drop("k")
        steps = u.join(begun.select(F.col("nbr").alias("a")).distinct(), "a", "left_semi")
        steps = _best(steps, ["a"], [F.desc("weight"), "b", "edge_id"], m + 1).select(F.col("a").alias("nbr"), "b", F.col("edge_id").alias("e"), F.col("weight").alias("w"))
        second = begun.join(steps, "nbr").where("trail <> e")
        paths = paths.unionByName(second.select("seed", F.col("b").alias("nbr"), "relation_type", (F.col("path_weight") + F.col("w")).alias("path_weight"), F.lit(2).alias("steps"), F.concat_ws(">", "trail", "e").alias("trail")))
    elif hops > 2:
        last = first.withColumn("met", F.array("trail"))
        for n in range(2, hops + 1):
            step = u.select(F.col("a").alias("nbr"), F.col("b").alias("next"), F.col("edge_id").alias("e"), F.col("weight").alias("w"))
            last = last.join(step, "nbr").where(~F.array_contains("met", F.col("e")))
            last = last.select("seed", F.col("next").alias("nbr"), "relation_type", (F.col("path_weight") + F.col("w")).alias("path_weight"), F.lit(n).alias("steps"), F.concat_ws(">", "trail", "e").alias("trail"), F.concat("met", F.array("e")).alias("met"))
            paths = paths.unionByName(_best(last, ["seed"], order, m).select(*columns))
    top = _best(paths, ["seed"], order, m)
    return top.groupBy("seed", "nbr").agg(F.min_by("relation_type", "k").alias("relation_type"), F.min_by("path_weight", "k").alias("path_weight"))


def neighbor_edges(edges: DataFrame, seed: str, hops: int, limit: int) -> DataFrame:
    """(nbr, edge_id, relation_type, weight): one row for each edge on a path, heaviest edges first."""
    u = undirected(edges)
    first = u.where(F.col("a") == seed).select(F.col("b").alias("nbr"), F.array(F.struct("edge_id", "relation_type", "weight")).alias("trail"))
    paths, last = first, first
    for _ in range(1, hops):
        step = u.select(F.col("a").alias("nbr"), F.col("b").alias("next"), F.struct("edge_id", "relation_type", "weight").alias("e"))
        last = last.join(step, "nbr").where(~F.exists("trail", lambda t: t["edge_id"] == F.col("e.edge_id")))
        last = last.select(F.col("next").alias("nbr"), F.concat("trail", F.array("e")).alias("trail"))
        paths = paths.unionByName(last)
    rows = paths.select("nbr", F.explode("trail").alias("e")).select("nbr", "e.edge_id", "e.relation_type", "e.weight").distinct()
    return rows.orderBy(F.desc("weight"), "nbr", "edge_id").limit(limit)


def induced(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """(a, b, relation_type, weight): edges with both ends in ``nodes``, those between anchors first, then by weight."""
    ids, anchor = nodes.select("id"), anchors.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    flag = anchor.withColumn("is_anchor", F.lit(1))
    marked = inside.join(flag.withColumnsRenamed({"id": "src", "is_anchor": "s"}), "src", "left").join(flag.withColumnsRenamed({"id": "dst", "is_anchor": "d"}), "dst", "left")
    pair = F.coalesce(F.col("s") + F.col("d"), F.lit(0))
    rows = marked.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation_type", "weight", (pair == 2).alias("anchored"))
    return rows.orderBy(F.desc("anchored"), F.desc("weight"), "a", "b", "relation_type").limit(limit)


def ego(edges: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(center, nbr, relation_type, weight): the first node, by id, whose name holds ``text``, and its neighbours."""
    center = nodes.where(F.contains(F.lower("name"), F.lit(text.lower())) | (F.col("id") == text)).orderBy("id").limit(1).select(F.col("id").alias("center"))
    u = undirected(edges)
    return center.join(u, F.col("center") == F.col("a"), "left").select("center", F.col("b").alias("nbr"), "relation_type", "weight")


def edge_sample(edges: DataFrame, n: int) -> DataFrame:
    """The first ``n`` edges in the order of their ids."""
    return with_edge_ids(edges).orderBy("edge_id").limit(n)


def neighborhood(edges: DataFrame, node: str, hops: int, limit: int) -> DataFrame:
    """(a, b, edge_id): edges of the first ``limit`` paths of up to ``hops`` steps from ``node``, each once."""
    u = undirected(edges)
    path = u.where(F.col("a") == node).select("b", F.array("edge_id").alias("trail"))
    paths, last = path, path
    for _ in range(1, hops):
        if len(paths.select(F.lit(1)).take(limit)) == limit:  # shorter paths fill the limit: a hub is not gone through
            break
        step = u.select(F.col("a").alias("b"), F.col("b").alias("next"), F.col("edge_id").alias("e"))
        last = last.join(step, "b").where(~F.array_contains("trail", F.col("e"))).select(F.col("next").alias("b"), F.concat("trail", F.array("e")).alias("trail"))
        paths = paths.unionByName(last)
    kept = paths.orderBy(F.size("trail"), F.array_join("trail", ">")).limit(limit)
    ids = kept.select(F.explode("trail").alias("edge_id")).distinct()
    return with_edge_ids(edges).join(ids, "edge_id", "left_semi").select("src", "dst", "edge_id")


def path_lengths(edges: DataFrame, source: str, max_depth: int) -> DataFrame:
    """(id, hops): least number of edges from ``source``, any direction. One level a join; visited nodes are not met again."""
    spark = edges.sparkSession
    u = cut(undirected(edges).select("a", "b").distinct())
    seen = spark.createDataFrame([(source, 0)], "id string, hops int")
    level = seen.select("id")
    for d in range(1, max_depth + 1):
        found = level.join(u, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        level = cut(found.join(seen.select("id"), "id", "left_anti"))
        seen = seen.unionByName(level.withColumn("hops", F.lit(d)))
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int) -> DataFrame:
    """(step, id): a shortest path, of several the smallest by node ids; empty when there is none."""
    if source == target:
        raise ValueError("source and target are the same node")
    spark = edges.sparkSession
    u = cut(undirected(edges).select("a", "b").distinct())
    seen = spark.createDataFrame([(source, None, 0)], "id string, parent string, hops int")
    level, d = seen.select("id"), 0
    while d < max_depth and seen.where(F.col("id") == target).isEmpty():
        d += 1
        found = level.join(u, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        new = cut(found.join(seen.select("id"), "id", "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new.withColumn("hops", F.lit(d)))
        level = new.select("id")
    steps, at = [], target
    while True:  # at most max_depth lookups of one row
        row = seen.where(F.col("id") == at).select("parent", "hops").first()
        if row is None:
            steps = []
            break
        steps.append((row["hops"], at))
        if row["parent"] is None:
            break
        at = row["parent"]
    return spark.createDataFrame(sorted(steps), "step int, id string")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by type and edges by relation."""
    a = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    b = edges.groupBy(F.col("relation_type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return a.unionByName(b).select("kind", "name", "n")


def home_page(mentions: DataFrame, entity: str) -> DataFrame:
    """(entity_id, url, n): the page with most mentions of an entity."""
    one = mentions.where(F.col("entity_id") == entity).groupBy("entity_id", "url").agg(F.count("*").alias("n"))
    return one.orderBy(F.desc("n"), "url").limit(1)


def budgeted_entities(mentions: DataFrame, topics: DataFrame, url: str, budget: int, per_entity: int = 2) -> DataFrame:
    """(entity_id, hits, topics, cost, spent): a page's entities by hits until one costs more than is left.

    An entity costs one, and one for each of its first topics. A page's entities are few; the window holds one page.
    """
    hits = mentions.where(F.col("url") == url).groupBy("entity_id").agg(F.count("*").alias("hits"))
    named = topics.join(hits.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.slice(F.array_sort(F.collect_set("keyword")), 1, per_entity).alias("topics"))
    rows = hits.join(named, "entity_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    w = Window.orderBy(F.desc("hits"), "entity_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = rows.withColumn("cost", 1 + F.size("topics")).withColumn("spent", F.sum("cost").over(w))
    return spent.where(F.col("spent") <= budget)


def anchored(entities: DataFrame, anchors: list[str]) -> DataFrame:
    """(anchor, entity_id): for each anchor the first entity, by id, whose name or an alias holds it in any case, or whose id it is.

    ``entities`` has (entity_id, name, aliases). The anchors are a list that the caller gives; each row meets it in place,
    so nothing is joined and each task leaves one id an anchor.
    """
    text = F.lower(F.concat_ws("\n", "name", F.coalesce("aliases", F.array().cast("array<string>"))))
    met = F.filter(F.array(*[F.lit(a) for a in anchors]), lambda a: F.contains(text, F.lower(a)) | (F.col("entity_id") == a))
    return entities.select(F.explode(met).alias("anchor"), "entity_id").groupBy("anchor").agg(F.min("entity_id").alias("entity_id"))


def anchor_pages(anchors: list[str], pages: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(anchor, url): a url is its own page, if there is one; any other anchor is an entity, whose page is the one with most
    of its blocks, of several the smallest url. Anchors without a page have no row."""
    urls = [a for a in anchors if a.startswith(("http://", "https://"))]
    names = [a for a in anchors if a not in urls]
    direct = pages.where(F.col("url").isin(urls)).select(F.col("url").alias("anchor"), "url").distinct()
    hits = mentions.join(F.broadcast(anchored(entities, names)), "entity_id").groupBy("anchor", "url").agg(F.count_distinct("block_id").alias("n"))
    dense = hits.groupBy("anchor").agg(F.min_by("url", F.struct(-F.col("n"), F.col("url"))).alias("url"))
    return direct.unionByName(dense.join(pages.select("url"), "url", "left_semi").select("anchor", "url"))


def layered_slice(
    anchors: list[str], pages: DataFrame, blocks: DataFrame, entities: DataFrame, mentions: DataFrame, topics: DataFrame, edges: DataFrame,
    max_nodes: int = 80, per_entity: int = 2,
) -> DataFrame:
    """(anchor, kind, layer, id, dst, type, label): a page, its blocks, the entities they mention and their first topics.

    ``pages`` (url, title), ``blocks`` (block_id, url, content, heading_context), ``entities`` (entity_id, name, aliases),
    ``mentions`` (entity_id, block_id, url), ``topics`` (entity_id, keyword), ``edges`` (src, dst, relation_type).

    One budget of ``max_nodes`` runs over the layers: the page costs one, all blocks stay, then come entities by their
    blocks on the page, each with its topics, up to the first that costs more than is left. Edges are CONTAINS,
    EXTRACTED_FROM, HAS_TOPIC, and every relation between two entities that stay. A topic of two entities is one node but
    costs twice. Null or blank content is labelled by the last heading, else ``Block``; repeated rows count once.

    Everything after the choice of pages is bounded by anchors times the rows of a page; only semi-joins and joins from
    that side meet the large tables.
    """
    at = cut(anchor_pages(anchors, pages, entities, mentions))
    page = F.broadcast(at)
    own = blocks.join(page, "url").where("block_id is not null").dropDuplicates(["anchor", "block_id"])
    hits = mentions.join(page, "url").select("anchor", "url", "entity_id", "block_id").distinct()
    hits = cut(hits.join(own.select("anchor", "block_id"), ["anchor", "block_id"], "left_semi"))
    named = topics.join(hits.select("entity_id").distinct(), "entity_id", "left_semi").where("keyword <> ''")
    named = named.groupBy("entity_id").agg(F.slice(F.array_sort(F.collect_set("keyword")), 1, per_entity).alias("topics"))
    size = own.groupBy("anchor").agg(F.count("*").alias("n_blocks"))
    rows = hits.groupBy("anchor", "entity_id").agg(F.count("*").alias("hits")).join(named, "entity_id", "left").join(F.broadcast(size), "anchor")
    rows = rows.withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    w = Window.partitionBy("anchor").orderBy(F.desc("hits"), "entity_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = rows.withColumn("spent", 1 + F.col("n_blocks") + F.sum(1 + F.size("topics")).over(w))
    kept = cut(spent.where(F.col("spent") <= max_nodes).select("anchor", "entity_id", "topics"))

    none = F.lit(None).cast("string")

    def node(rows: DataFrame, layer: str, ident: str, kind: str, label) -> DataFrame:
        return rows.select("anchor", F.lit("node").alias("kind"), F.lit(layer).alias("layer"), F.col(ident).alias("id"), none.alias("dst"), F.lit(kind).alias("type"), label.alias("label"))

    def edge(rows: DataFrame, src: str, dst: str, kind) -> DataFrame:
        return rows.select("anchor", F.lit("edge").alias("kind"), none.alias("layer"), F.col(src).alias("id"), F.col(dst).alias("dst"), kind.alias("type"), none.alias("label"))

    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    heading = F.element_at(F.split("heading_context", " > "), -1)
    words = kept.select("anchor", "entity_id", F.explode("topics").alias("keyword"))
    end = kept.select("anchor", "entity_id")
    related = edges.join(end.withColumnRenamed("entity_id", "src"), "src").join(end.withColumnRenamed("entity_id", "dst"), ["anchor", "dst"])
    parts = [
        node(pages.join(page, "url").dropDuplicates(["anchor", "url"]), "page", "url", "WebPage", F.coalesce(full("title"), F.col("url"))),
        node(own, "block", "block_id", "Block", F.left(F.coalesce(full("content"), full(heading), F.lit("Block")), F.lit(60))),
        node(kept.join(entities.select("entity_id", "name"), "entity_id").dropDuplicates(["anchor", "entity_id"]), "entity", "entity_id", "Entity", F.coalesce("name", "entity_id")),
        node(words.select("anchor", "keyword").distinct(), "topic", "keyword", "TopicKeyword", F.col("keyword")),
        edge(own, "url", "block_id", F.lit("CONTAINS")),
        edge(hits.join(end, ["anchor", "entity_id"]), "entity_id", "block_id", F.lit("EXTRACTED_FROM")),
        edge(words, "entity_id", "keyword", F.lit("HAS_TOPIC")),
        edge(related, "src", "dst", F.col("relation_type")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ego_view(
    anchors: list[str], entities: DataFrame, blocks: DataFrame, mentions: DataFrame, topics: DataFrame, edges: DataFrame, max_blocks: int = 5,
) -> DataFrame:
    """(anchor, kind, id, dst, type, label): the entity of each anchor (:func:`anchored`), its neighbours over all relations in
    either direction, its first ``max_blocks`` blocks by id, and its topics, as nodes and edges that leave it.

    Tables as for :func:`layered_slice`. Neighbours without a row of their own are left out with their edges; a block
    without a heading is labelled ``Block``; repeated rows count once. Anchors that name no entity have no row.
    """
    center = F.broadcast(cut(anchored(entities, anchors)))
    none = F.lit(None).cast("string")
    node = lambda rows, ident, kind, label: rows.select("anchor", F.lit("node").alias("kind"), F.col(ident).alias("id"), none.alias("dst"), F.lit(kind).alias("type"), label.alias("label")).distinct()
    edge = lambda rows, dst, kind: rows.select("anchor", F.lit("edge").alias("kind"), F.col("entity_id").alias("id"), F.col(dst).alias("dst"), kind.alias("type"), none.alias("label"))
    named = entities.select("entity_id", "name")
    near = undirected(edges).join(center, F.col("a") == F.col("entity_id")).where("a <> b").select("anchor", "entity_id", F.col("b").alias("nbr"), "edge_id", "relation_type").distinct()
    near = near.join(named.withColumnsRenamed({"entity_id": "nbr", "name": "nbr_name"}), "nbr")
    own = mentions.join(center, "entity_id").select("anchor", "entity_id", "block_id").distinct()
    held = blocks.groupBy("block_id").agg(F.min("heading_context").alias("heading"))
    own = _best(own.join(held, "block_id"), ["anchor"], ["block_id"], max_blocks)
    words = topics.where("keyword <> ''").join(center, "entity_id").select("anchor", "entity_id", "keyword").distinct()
    parts = [
        node(named.join(center, "entity_id"), "entity_id", "Entity", F.coalesce("name", "entity_id")),
        node(near, "nbr", "Entity", F.coalesce("nbr_name", "nbr")),
        node(own, "block_id", "Block", F.left(F.coalesce("heading", F.lit("Block")), F.lit(50))),
        node(words, "keyword", "TopicKeyword", F.col("keyword")),
        edge(near, "nbr", F.col("relation_type")), edge(own, "block_id", F.lit("EXTRACTED_FROM")), edge(words, "keyword", F.lit("HAS_TOPIC")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def node_rows(nodes: DataFrame, label_chars: int = 80) -> DataFrame:
    """(id, label, type): nodes as the graph view shows them."""
    label = F.when(F.length("name") > label_chars, F.concat(F.left("name", F.lit(label_chars)), F.lit("..."))).otherwise(F.col("name"))
    return nodes.select("id", label.alias("label"), "type")


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges of both, the first one's where (src, dst) is in both."""
    return first.unionByName(second.join(first.select("src", "dst"), ["src", "dst"], "left_anti"))
