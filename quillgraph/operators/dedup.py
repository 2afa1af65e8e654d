"""Dedup of pages, blocks and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import DedupParams
from quillgraph.functions import expr as E
from quillgraph.sources.state import cut


def pick_canonical(rows: DataFrame, group: str, main_host: str, url: str = "url") -> DataFrame:
    """(group, canonical_url): the best url of each group. An aggregate, so copies combine before the shuffle."""
    return rows.groupBy(group).agg(F.min(E.canonical_key(F.col(url), main_host)).alias("k")).select(group, F.col("k.u").alias("canonical_url"))


def page_actions(pages: DataFrame, main_host: str, p: DedupParams = DedupParams()) -> DataFrame:
    """(url, content_hash, action, canonical_url) from (url, content_hash, n_blocks): keep, mirror or drop, in that rule order."""
    rows = pages.where("coalesce(url, '') <> '' and coalesce(content_hash, '') <> ''")
    groups = rows.groupBy("content_hash").agg(
        F.count("*").alias("size"), F.max("n_blocks").alias("most"), F.min(E.canonical_key(F.col("url"), main_host)).alias("k")
    )
    joined = rows.join(groups, "content_hash")
    empty = F.col("content_hash").startswith(p.empty_hash) | (F.col("most") == 0)
    canonical = F.col("k.u")
    action = (
        F.when(empty | (F.col("size") >= p.max_group_size), "drop")
        .when((F.col("size") == 1) | (F.col("url") == canonical), "keep")
        .otherwise("mirror")
    )
    return joined.select("url", "content_hash", action.alias("action"), F.when(action != "drop", canonical).alias("canonical_url"))


def mirror_remap(blocks: DataFrame, actions: DataFrame) -> DataFrame:
    """(old_id, new_id): a mirror page's blocks to equal blocks of its canonical page, the first by position."""
    mirrors = actions.where("action = 'mirror'").select("url", "canonical_url")
    theirs = blocks.select(F.col("url").alias("canonical_url"), F.xxhash64("content").alias("h"), "content", F.struct("child_index", "block_id").alias("at"))
    theirs = theirs.groupBy("canonical_url", "h", "content").agg(F.min("at").getField("block_id").alias("new_id"))
    mine = blocks.join(mirrors, "url").withColumn("h", F.xxhash64("content"))
    return mine.join(theirs, ["canonical_url", "h", "content"]).select(F.col("block_id").alias("old_id"), "new_id")


def block_remap(blocks: DataFrame, main_host: str, p: DedupParams = DedupParams()) -> DataFrame:
    """(old_id, new_id) from (url, html_tag_path, block_id, content): equal content on two urls or more has one block."""
    rows = blocks.withColumn("h", E.content_hash(F.col("content")))
    key = F.struct(E.canonical_key(F.col("url"), main_host).alias("k"), F.col("html_tag_path").alias("p"), F.col("block_id").alias("b"))
    best = rows.groupBy("h").agg(F.min(key).getField("b").alias("new_id"), F.count_distinct("url").alias("urls")).where(F.col("urls") >= p.min_group_size)
    return rows.join(best, "h").where("block_id <> new_id").select(F.col("block_id").alias("old_id"), "new_id")


def compose_remaps(remaps: list[DataFrame], max_steps: int = 16) -> DataFrame:
    """(old_id, new_id): later maps override, chains are followed to their end, identities go.

    Each step joins the map with itself, so paths double in length; ``max_steps`` doublings end every chain that fits in
    the data, and stop a cycle.
    """
    tagged = [r.select("old_id", "new_id", F.lit(i).alias("rank")) for i, r in enumerate(remaps)]
    all_rows = tagged[0]
    for t in tagged[1:]:
        all_rows = all_rows.unionByName(t)
    cur = all_rows.groupBy("old_id").agg(F.max_by("new_id", F.struct("rank", "new_id")).alias("new_id")).where("old_id <> new_id")
    for _ in range(max_steps):
        step = cur.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("next"))
        joined = cut(cur.join(step, "new_id", "left"))
        if joined.where("next is not null and next <> old_id").isEmpty():
            break
        cur = joined.select("old_id", F.coalesce("next", "new_id").alias("new_id")).where("old_id <> new_id")
    return cur


def rewrite_links(links: DataFrame, actions: DataFrame) -> DataFrame:
    """Links after page dedup: none from dropped or mirror pages, none to dropped ones, mirrors replaced, no self loops."""
    act = actions.select("url", "action", "canonical_url")
    src = act.where("action <> 'keep'").select(F.col("url").alias("from_url"))
    dst = act.select(F.col("url").alias("to_url"), F.col("action").alias("a"), F.col("canonical_url").alias("c"))
    rows = links.join(src, "from_url", "left_anti").join(dst, "to_url", "left").where("a is null or a <> 'drop'")
    to = F.when(F.col("a") == "mirror", F.col("c")).otherwise(F.col("to_url"))
    out = rows.select("from_url", to.alias("to_url"), F.coalesce("link_type", F.lit("hyperlink")).alias("link_type"), "anchor_text")
    return out.where("from_url <> to_url").groupBy("from_url", "to_url", "link_type").agg(F.min("anchor_text").alias("anchor_text"))
