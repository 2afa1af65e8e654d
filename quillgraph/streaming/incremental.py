"""Incremental forms: a ledger of last statuses, url dedup, and upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import store
from quillgraph.sources.state import folder


def first_seen(stream: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark: state is bounded by the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def ledger(stream: DataFrame, key: str, status: str, event_time: str) -> DataFrame:
    """The last status of each key, in update mode; equals the batch ledger over the same rows."""
    return stream.groupBy(key).agg(F.max_by(status, event_time).alias("status"), F.max(event_time).alias("at"))


def windowed_counts(stream: DataFrame, event_time: str, key: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by event-time window; late rows beyond the delay are left out."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, size), key).agg(F.count("*").alias("n"))


def upsert_sink(spark, path: str, key: list[str], build_of, schema: str):
    """A ``foreachBatch`` function that merges each batch into versioned parquet below ``path``.

    A batch writes ``v=<batch>`` from ``v=<batch before>``; running a batch again writes the same version, so a restart
    after a failure neither loses nor doubles rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.createDataFrame([], schema) if number == 0 else spark.read.schema(schema).parquet(f"{path}/v={number - 1}")
        store.upsert(old, batch, key, build_of(number)).write.mode("overwrite").parquet(f"{path}/v={number}")

    return merge


def dual_sink(spark, path: str, build_of, key: str = "block_id", content: str = "content", vec: str = "embedding", order: str = "ordinal", between=lambda: None):
    """A ``foreachBatch`` function that writes each batch to two stores below ``path``: ``graph``, then ``vectors``.

    A batch is a build. Of several rows of a key the last by ``order`` is written, once. Vector rows are read back from
    the graph rows of the build, so both stores have the same; blank content and null vectors have no vector row. A build
    counts once its mark in ``done`` is there, so a stop between the two writes shows nothing, and the batch that runs
    again writes the same places. ``between`` is called between the two writes (tests stop there).
    """

    def write(batch: DataFrame, number: int) -> None:
        build = build_of(number)
        rest = [c for c in batch.columns if c != key]
        one = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])
        one.write.mode("overwrite").parquet(f"{path}/graph/build={build}")
        between()
        kept = spark.read.schema(one.schema).parquet(f"{path}/graph/build={build}")
        told = kept.where((F.trim(F.coalesce(content, F.lit(""))) != "") & F.col(vec).isNotNull()).select(key, vec)
        told.write.mode("overwrite").parquet(f"{path}/vectors/build={build}")
        spark.createDataFrame([(build,)], "build string").coalesce(1).write.mode("overwrite").parquet(f"{path}/done/of={build}")

    return write


def dual_store(spark, path: str, key: str = "block_id") -> tuple[DataFrame, DataFrame]:
    """(graph rows, vector rows) of the finished builds: of each key the row of its latest build, and its vector if that
    build wrote one (content that became blank has none left)."""
    done = spark.read.parquet(f"{path}/done").select("build")
    graph = spark.read.option("basePath", f"{path}/graph").parquet(f"{path}/graph").withColumn("build", F.col("build").cast("string"))
    graph = graph.join(done, "build", "left_semi")
    rest = [c for c in graph.columns if c != key]
    last = graph.groupBy(key).agg(F.max_by(F.struct(*rest), "build").alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])
    vectors = spark.read.option("basePath", f"{path}/vectors").parquet(f"{path}/vectors").withColumn("build", F.col("build").cast("string"))
    return last, vectors.join(last.select(key, "build"), [key, "build"], "left_semi")


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that ``stream`` gives until its source is read, as a table of the last batch (complete mode) or of all."""
    spark = stream.sparkSession
    place = folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that runs again writes the same place
        batch.write.mode("overwrite").parquet(f"{place}/out" if mode == "complete" else f"{place}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def server_sent_events(rows: DataFrame) -> DataFrame:
    """(seq, payload): rows (seq, event, data struct) as server-sent events."""
    return rows.select("seq", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.to_json("data"), F.lit("\n\n")).alias("payload"))


def parse_events(raw: DataFrame, text: str = "text") -> DataFrame:
    """(n, event, data) of a server-sent event text."""
    chunk = raw.select(F.posexplode(F.filter(F.split(text, "\n\n"), lambda x: F.trim(x) != "")).alias("n", "chunk"))
    return chunk.select("n", F.regexp_extract("chunk", "(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract("chunk", "(?m)^data: ?(.*)$", 1).alias("data"))
