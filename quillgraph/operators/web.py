"""Pages, links and crawling as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import PRIORITY_PATTERNS, UrlRules
from quillgraph.functions import expr as E
from quillgraph.sources.state import cut


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.col(url)
    return pages.withColumns({"scheme": E.url_scheme(u), "host": E.url_host(u), "path": E.normalized_path(E.url_path(u))})


def filter_urls(urls: DataFrame, rules: UrlRules, url: str = "url") -> DataFrame:
    """Urls that no rule drops."""
    return urls.where(E.drop_reason(F.col(url), rules).isNull())


def drop_histogram(urls: DataFrame, rules: UrlRules, url: str = "url") -> DataFrame:
    reason = F.coalesce(E.drop_reason(F.col(url), rules), F.lit("keep"))
    return urls.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_urls"))


def discover(urls: DataFrame, rules: UrlRules, limit: int, url: str = "url", ordinal: str = "ordinal") -> DataFrame:
    """Map discovery: first-seen unique urls that pass the rules, up to ``limit`` in order of discovery."""
    first = urls.groupBy(url).agg(F.min(ordinal).alias(ordinal))
    return filter_urls(first, rules, url).orderBy(ordinal, url).limit(limit)


def page_meta(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title and meta description by pattern; the DOM form is in :mod:`quillgraph.operators.html`."""
    title = F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    about = F.regexp_extract(html, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1)
    return pages.withColumns({"title": title, "meta_description": about})


def raw_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, ordinal, href): hrefs of anchors in document order, first-seen unique; fragments and scripts skipped."""
    found = F.regexp_extract_all(html, F.lit('(?i)<a[^>]*?href="([^"]*)"'), F.lit(1))
    rows = pages.select(F.col(url).alias("from_url"), F.posexplode(found).alias("ordinal", "href"))
    skip = (F.col("href") == "") | F.col("href").startswith("#") | F.lower("href").startswith("mailto:") | F.lower("href").startswith("javascript:")
    return rows.where(~skip).groupBy("from_url", "href").agg(F.min("ordinal").alias("ordinal"))


def absolute(base: str, href: str):
    """``href`` resolved against ``base`` for the forms that occur in pages, without fragment and query."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.regexp_replace(E.url_path(F.col(base)), "[^/]*$", ""))
    h = F.col(href)
    full = (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*://"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h))
        .otherwise(F.concat(F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder), h))
    )
    return E.strip_query(full)


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url, link_type): resolved links, unique."""
    rows = raw_links(pages, url, html).withColumn("to_url", absolute("from_url", "href"))
    return rows.select("from_url", "to_url", F.lit("hyperlink").alias("link_type")).distinct()


def stub_pages(links_: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that links name and no page has: empty title, type other."""
    known = pages.select(F.col("url").alias("to_url"))
    missing = links_.select("to_url").distinct().join(known, "to_url", "left_anti")
    return missing.select(F.col("to_url").alias("url"), F.lit("").alias("title"), F.lit("other").alias("page_type"))


def backfill(links_: DataFrame, crawled: DataFrame, patterns: tuple[str, ...] = PRIORITY_PATTERNS) -> DataFrame:
    """Priority urls that links name and the crawl lacks."""
    wanted = links_.where(F.col("to_url").rlike("|".join(f"(?:{p})" for p in patterns))).select(F.col("to_url").alias("url")).distinct()
    return wanted.join(crawled.select("url"), "url", "left_anti")


def pending(frontier: DataFrame, on_disk: DataFrame, ledger: DataFrame) -> DataFrame:
    """Frontier urls neither stored nor in the ledger."""
    f = frontier.select("url").where("url is not null").distinct()
    return f.join(on_disk.select("url"), "url", "left_anti").join(ledger.select("url"), "url", "left_anti")


def crawl_levels(seeds: DataFrame, links_: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): breadth-first levels from ``seeds``; each url at its least depth. One join and one anti-join a level."""
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    level = seen
    edges = links_.select(F.col("from_url").alias("url"), "to_url").distinct()
    for depth in range(1, max_depth + 1):
        found = level.join(edges, "url").select(F.col("to_url").alias("url")).distinct()
        level = cut(found.join(seen.select("url"), "url", "left_anti")).withColumn("depth", F.lit(depth))
        seen = seen.unionByName(level)
    return seen


def crawl_budget(fetched: DataFrame, limit: int, per_seed: int) -> DataFrame:
    """Rows (seed_no, position, ..) within a per-seed limit and what is left of the whole budget; filtered pages count too."""
    w = Window.partitionBy("seed_no").orderBy("position")
    mine = fetched.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_seed)
    used = mine.groupBy("seed_no").agg(F.count("*").alias("n"))  # one row a seed
    before = Window.orderBy("seed_no").rowsBetween(Window.unboundedPreceding, -1)
    left = used.select("seed_no", (F.lit(limit) - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("left"))
    return mine.join(left, "seed_no").where(F.col("k") <= F.col("left")).drop("k", "left")


def related_links(sources: DataFrame, links_: DataFrame, cap: int = 15) -> DataFrame:
    """(query_id, to_url, anchor_text): out-links of a query's source pages, with an anchor, to other pages, unique."""
    out = sources.select("query_id", F.col("url").alias("from_url")).join(links_, "from_url").where("anchor_text <> ''")
    named = sources.select("query_id", F.col("url").alias("to_url"))
    new = out.join(named, ["query_id", "to_url"], "left_anti").groupBy("query_id", "to_url").agg(F.min("anchor_text").alias("anchor_text"))
    w = Window.partitionBy("query_id").orderBy("to_url")
    return new.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).drop("k")
