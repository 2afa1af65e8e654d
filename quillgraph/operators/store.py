"""Upserts, builds, orphans, caches and ledgers over plain tables.

An upsert returns the new state; writing it to a new version folder and switching a pointer makes it atomic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Edges that a task sorts, at least and at most, about; buckets in which their pairs are counted.
ROWS, MOST, BUCKETS = 250_000, 4_000_000, 65_536


def upsert(old: DataFrame, new: DataFrame, key: list[str], build: str) -> DataFrame:
    """New values win; created_build stays that of the first build, last_seen_build becomes ``build`` for new rows."""
    values = [c for c in new.columns if c not in key]
    n = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    joined = old.join(n, key, "full_outer")
    here = F.coalesce("_hit", F.lit(False))
    cols = [F.when(here, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return joined.select(
        *key, *cols, F.coalesce("created_build", F.lit(build)).alias("created_build"),
        F.when(here, F.lit(build)).otherwise(F.col("last_seen_build")).alias("last_seen_build"),
    )


def relations_replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bulk form: a new relation replaces weight, sources, keywords and description."""
    key = ["src", "dst", "relation_type"]
    return old.join(new.select(*key), key, "left_anti").unionByName(new.select(old.columns))


def relations_accumulated(rows: DataFrame) -> DataFrame:
    """Single-row form, as an aggregate: weights add up, source ids join in order, the longest description wins."""
    return rows.groupBy("src", "dst", "relation_type").agg(
        F.sum("weight").alias("weight"),
        F.array_sort(F.collect_list("source_id")).alias("source_ids"),
        F.max_by("description", F.struct(F.length("description"), "description")).alias("description"),
    )


def existing_ends(edges: DataFrame, left: DataFrame, right: DataFrame, lcol: str, rcol: str) -> DataFrame:
    """Edges whose two ends are both known."""
    return edges.join(left.select(lcol), lcol, "left_semi").join(right.select(rcol), rcol, "left_semi").distinct()


def contains_after_dedup(contains: DataFrame, extra: DataFrame) -> DataFrame:
    """Page-block edges with those that dedup adds, each once: originals win; new ones are marked and take depth 0 where unknown.

    Of several originals, or several new ones, the smallest known depth counts. A new edge without page or block equals no original.
    One pass counts the edges first: they go to the session's partitions, to fewer where these got under ``ROWS`` edges each,
    to more where they got over ``MOST``. Pairs that come more often than a task's share are reduced before they travel.
    """
    old = contains.select("url", "block_id", "depth", F.lit(False).alias("via_dedup"))
    new = extra.select("url", "block_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.lit(True).alias("via_dedup"))
    edges = old.unionByName(new)
    bucket = F.pmod(F.xxhash64("url", "block_id"), F.lit(BUCKETS))
    sizes = edges.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    n, full = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(F.when(F.col("n") > ROWS, F.struct("b", "n")))).first()
    parts = max(1, min(n // ROWS, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n // MOST)
    large = [x["b"] for x in full if x["n"] > n / parts]
    if large:
        few = edges.where(bucket.isin(large)).groupBy("url", "block_id", "via_dedup").agg(F.min("depth").alias("depth"))
        edges = edges.where(~bucket.isin(large)).unionByName(few)
    apart = F.col("via_dedup") & (F.isnull("url") | F.isnull("block_id"))
    first = F.row_number().over(Window.partitionBy("url", "block_id", apart).orderBy("via_dedup", F.asc_nulls_last("depth")))
    dealt = edges.repartition(parts, "url", "block_id")
    return dealt.withColumn("k", first).where(F.col("k") == 1).drop("k")


def touch(table: DataFrame, key: str, seen: DataFrame, build: str) -> DataFrame:
    """last_seen_build of the rows named in ``seen`` becomes ``build``."""
    hit = seen.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = table.join(hit, key, "left")
    return joined.withColumn("last_seen_build", F.when(F.col("_hit"), F.lit(build)).otherwise(F.col("last_seen_build"))).drop("_hit")


def reachable(pages: DataFrame, contains: DataFrame, mentions: DataFrame) -> DataFrame:
    """(kind, id): blocks on the pages and entities mentioned there, each once."""
    blocks = contains.join(pages.select("url"), "url", "left_semi").select("block_id").distinct()
    entities = mentions.join(blocks, "block_id", "left_semi").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).distinct()
    return blocks.select(F.lit("block").alias("kind"), F.col("block_id").alias("id")).unionByName(entities)


def incident(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Keys of relations with an end in ``entities``, each once."""
    ids = entities.select("id")
    a = relations.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    b = relations.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return a.select("src", "dst", "relation_type").unionByName(b.select("src", "dst", "relation_type")).distinct()


def is_orphan(current: str, null_counts: bool = False):
    """Not seen in the current build. A row that was never stamped counts only with ``null_counts``."""
    seen = F.col("last_seen_build")
    return ~seen.eqNullSafe(current) if null_counts else seen.isNotNull() & (seen != current)


def orphan_report(table: DataFrame, kind: str, ident: str, current: str, samples: int = 3) -> DataFrame:
    """(kind, n_orphans, sample): counts and the smallest ids of each kind. Samples are picked before they are gathered."""
    rows = table.where(is_orphan(current))
    w = Window.partitionBy(kind).orderBy(ident)
    few = rows.select(kind, ident).withColumn("k", F.row_number().over(w)).where(F.col("k") <= samples)
    named = few.groupBy(kind).agg(F.array_join(F.array_sort(F.collect_list(F.col(ident).cast("string"))), ",").alias("sample"))
    return rows.groupBy(kind).agg(F.count("*").alias("n_orphans")).join(named, kind)


def delete_orphans(nodes: DataFrame, edges: DataFrame, current: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that stay: no orphan edge, no orphan node, no edge without both of its nodes."""
    kept = nodes.where(~is_orphan(current))
    ids = kept.select("id")
    alive = edges.where(~is_orphan(current)) if "last_seen_build" in edges.columns else edges
    alive = alive.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, alive


def consistency(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right): how many keys one store has and the other lacks."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").agg(F.count("*").alias("only_left"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").agg(F.count("*").alias("only_right"))
    return left.crossJoin(right)


def ledger(log: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The last status of each key."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"))


def build_ring(builds: DataFrame, build: str = "build", keep: int = 5) -> DataFrame:
    """(build, role): the latest build and the ``keep`` before it."""
    latest = builds.select(build).distinct().orderBy(F.desc(build)).limit(keep + 1)
    n = F.row_number().over(Window.orderBy(F.desc(build)))  # over keep + 1 rows
    return latest.withColumn("n", n).select(build, F.when(F.col("n") == 1, "current").otherwise("previous").alias("role"))


def cache_split(requests: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """``requests`` with ``hit``: whether the cache has their key."""
    known = cache.select(*key).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, key, "left").withColumn("hit", F.coalesce("_known", F.lit(False))).drop("_known")


def cached(requests: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """(key, value): every distinct key once, from the cache or from ``compute`` (a function of the missing keys)."""
    want = requests.select(key).distinct()
    have = cache.join(want, key, "left_semi").select(key, "value")
    return have.unionByName(compute(want.join(cache.select(key), key, "left_anti")))
