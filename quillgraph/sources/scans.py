"""Scans of crawl files, frontiers and configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.expr import department, page_type, strip_query

PAGE_JSON = (
    "url string, title string, meta_description string, department string, page_type string, crawled_at string, "
    "markdown string, outgoing_links array<struct<url string, anchor_text string>>, html_path string"
)


def page_store(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a page; files that are not JSON are skipped."""
    return spark.read.schema(PAGE_JSON).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def existing_urls(spark: SparkSession, path: str) -> DataFrame:
    return page_store(spark, path).select(strip_query(F.col("url")).alias("url")).where("url is not null").distinct()


def frontier(spark: SparkSession, path: str) -> DataFrame:
    """Urls of a JSON-lines file; bad lines and lines without a url are skipped."""
    return spark.read.schema("url string").json(path).where("url is not null")


def config(path: str) -> dict:
    """A YAML file as a dict; a missing file is empty."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    except FileNotFoundError:
        return {}


def fetched_documents(docs: DataFrame, crawled_at: str) -> DataFrame:
    """Fetched documents (url, source_url, title, og_title, description, og_description, markdown, html) as page rows."""
    url = F.coalesce(F.col("url"), F.col("source_url"))
    return docs.select(
        url.alias("url"), F.coalesce(F.nullif("title", F.lit("")), "og_title", F.lit("")).alias("title"),
        F.coalesce(F.nullif("description", F.lit("")), "og_description", F.lit("")).alias("meta_description"),
        department(url).alias("department"), page_type(url).alias("page_type"), F.lit(crawled_at).alias("crawled_at"), "markdown", "html",
    )


def retry_class(status: str = "status"):
    """What to do with a fetch by its HTTP status: keep, retry (5xx, 408, 429) or give up."""
    s = F.col(status)
    return F.when(s.between(200, 299), "ok").when((s >= 500) | s.isin(408, 429), "retry").otherwise("terminal")
