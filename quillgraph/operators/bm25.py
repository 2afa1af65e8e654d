"""A stored sparse index: gains by term and group of documents, and top-k that skips groups which cannot reach it.

Documents are dealt to groups of about ``GROUP`` by their id. Of a term the index keeps, for each group, its documents'
places and gains (the part of an Okapi score that is the document's own), and the largest of them; of the corpus, a term's
idf. A batch of questions reads no text: its terms' largest gains bound from above what a group can give to a question, and
the k-th best gain of one term alone, read from the terms that are asked for, bounds from below what a question's k-th
document has; groups between the two are scored, each in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import expr as E
from quillgraph.sources.state import base, folder, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents in a group, about; the largest k of a search that can skip groups.
GROUP, BEST = 1024, 64

_GROUPS = "term string, grp long, most double, docs array<long>, gains array<double>"
_SCORED = "query_id long, doc_id long, score double"


@dataclass(frozen=True)
class Index:
    """What lies in the folder: ``groups`` (term, grp, most, docs, gains), ``terms`` (term, df, idf),
    ``members`` (grp, ids) and ``facts`` (version, n_docs, avgdl)."""

    groups: DataFrame
    terms: DataFrame
    members: DataFrame
    facts: DataFrame


def _read(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{part}") for part in ("groups", "terms", "members", "facts")])


def _inverted(avgdl: float):
    """A group's documents (doc_id, len, words parted by blanks) as its postings, by term."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, size = rows.column("doc_id").to_numpy(), pc.fill_null(rows.column("len"), 0).to_numpy()
        docs, doc = np.unique(np.stack([ids, size], axis=1), axis=0, return_inverse=True)
        lists = pc.split_pattern(rows.column("words").combine_chunks(), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        by_word = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[by_word] = np.arange(len(words))
        at = rank[coded.indices.to_numpy()] * len(docs) + doc.reshape(-1)[pc.list_parent_indices(lists).to_numpy()]
        keys, tf = np.unique(at, return_counts=True)
        words = words.take(pa.array(by_word))
        if len(words) and words[0].as_py() == "":  # a document without words
            tf, keys = tf[keys >= len(docs)], keys[keys >= len(docs)]
        word, held = keys // max(1, len(docs)), keys % max(1, len(docs))
        gains = tf * (K1 + 1) / (tf + K1 * (1 - B + B * docs[held, 1] / avgdl))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        cuts = pa.array(np.append(starts, len(word)), pa.int32())
        most = np.maximum.reduceat(gains, starts) if len(starts) else np.zeros(0)
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (docs[held, 0], gains)]
        grp = pa.array(np.full(len(starts), key[0].as_py()), pa.int64())
        return pa.table([words.take(pa.array(word[starts])), grp, pa.array(most), *lists], ["term", "grp", "most", "docs", "gains"])

    return run


def build(docs: DataFrame, path: str, version: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of ``docs`` to ``path``; every text is read and cut into tokens once.

    A null text counts as a document without tokens that the mean length leaves out. Texts travel once, as words, to the
    task of their group, which inverts them; no posting is a row of its own. Facts come last: a folder without them is no
    index.
    """
    spark = docs.sparkSession
    cut = docs.select(F.col(doc_id).cast("long").alias("doc_id"), E.ascii_tokens(F.col(text)).alias("t"))
    rows = cut.select("doc_id", F.when(F.col("t").isNotNull(), F.size("t")).cast("long").alias("len"), F.concat_ws(" ", "t").alias("words"))
    rows.write.mode("overwrite").parquet(f"{path}/words")
    words = spark.read.parquet(f"{path}/words")
    lengths = words.groupBy("doc_id").agg(F.max("len").alias("len"))
    n_docs, avgdl = lengths.agg(F.count("*"), F.avg("len")).first()
    n_groups = max(1, -(-n_docs // GROUP))
    grp = F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)).alias("grp")
    members = lengths.select("doc_id", grp).groupBy("grp").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    members.write.mode("overwrite").parquet(f"{path}/members")
    by_group = words.withColumn("grp", grp).groupBy("grp").applyInArrow(_inverted(float(avgdl or 1.0)), _GROUPS)
    by_group.write.mode("overwrite").parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    held = groups.select("term", F.size("docs").alias("n")).groupBy("term").agg(F.sum("n").alias("df"))
    held.write.mode("overwrite").parquet(f"{path}/df")
    raw = spark.read.parquet(f"{path}/df").withColumn("raw", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floored = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    weighed = raw.crossJoin(F.broadcast(raw.agg(F.avg("raw").alias("mean")))).select("term", "df", floored.alias("idf"))
    weighed.write.mode("overwrite").parquet(f"{path}/terms")
    facts = spark.createDataFrame([(version, n_docs, float(avgdl or 0.0))], "version string, n_docs long, avgdl double")
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return _read(spark, path)


def stored(docs: DataFrame, path: str, version: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index at ``path`` if it is of this ``version`` and of as many documents as there are now; else built anew.

    The version is the caller's: a count and a sum over ids and lengths tell a changed corpus without reading its texts.
    """
    spark = docs.sparkSession
    try:
        kept = _read(spark, path)
        facts = kept.facts.first()
    except AnalysisException:
        facts = None
    if facts is not None and facts["version"] == version and facts["n_docs"] == docs.select(doc_id).distinct().count():
        return kept
    return build(docs, path, version, doc_id, text)


def kept_path(spark: SparkSession, name: str) -> str:
    """Where the index of a named corpus lies in the session's shared folder."""
    return f"{base(spark)}/quillgraph/bm25-{name}"


def temporary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """An index for one batch."""
    return build(docs, folder(docs.sparkSession, "bm25"), "once", doc_id, text)


def _scorer(k: int):
    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        """One group: every question's terms against the group's documents; the ``k`` best of each question."""
        out: list[tuple] = []
        ids = next((v for v in held.column("ids") if v.is_valid), None)
        if asks.num_rows and ids is not None:
            ids = np.array(ids.as_py(), np.int64)
            places, gains = {}, {}
            for term, docs, g in zip(held.column("term").to_pylist(), held.column("docs"), held.column("gains"), strict=True):
                if term is not None:
                    places[term] = np.searchsorted(ids, docs.values.to_numpy())
                    gains[term] = g.values.to_numpy()
            query, weight = asks.column("query_id").to_numpy(), asks.column("w").to_numpy()
            order = np.argsort(query, kind="stable")
            terms = asks.column("term").to_pylist()
            cuts = np.flatnonzero(np.diff(query[order])) + 1
            for rows in np.split(order, cuts):
                score, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
                for r in rows.tolist():
                    at = places[terms[r]]
                    score[at] += weight[r] * gains[terms[r]]
                    met[at] = True
                score = np.round(score, 6)
                at = np.flatnonzero(met)
                if len(at) > k and weight[rows].min() >= 0:  # else a document left out might be filled in with 0
                    least = np.partition(score[at], len(at) - k)[len(at) - k]
                    at = at[score[at] >= least]
                    at = at[np.lexsort((ids[at], -score[at]))[:k]]
                out.append((np.full(len(at), query[rows[0]]), ids[at], score[at]))
        q, d, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "doc_id": pa.array(d, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _words(queries: DataFrame, text: str) -> DataFrame:
    """The distinct terms of all questions, as a table whose true size Spark sees: few of them go to the index's rows."""
    return written(queries.select(F.explode(E.ascii_tokens(F.col(text))).alias("term")).distinct(), "asked")


def _best(groups: DataFrame, k: int) -> DataFrame:
    """(term, best): the ``k`` largest gains of each term."""
    top = F.slice(F.sort_array("gains", asc=False), 1, k)
    best = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, k)
    return groups.select("term", top.alias("top")).groupBy("term").agg(best.alias("best"))


def asked_groups(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """(grp, query_id, term, w): the groups that may hold one of a question's ``k`` best documents, with its terms there.

    ``words`` are the questions' distinct terms, where they lie written already.
    """
    words = _words(queries, text) if words is None else words
    held = index.groups.join(words, "term", "left_semi")
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.explode(E.ascii_tokens(F.col(text))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = asked.join(index.terms.join(words, "term", "left_semi"), "term")
    weight = F.col("qtf") * F.col("idf")
    if k <= BEST:
        asked = asked.join(_best(held, k), "term", "left")
    kth = F.when(F.size("best") >= k, weight * F.get("best", F.lit(k - 1))) if k <= BEST else F.lit(None).cast("double")
    asked = asked.select("query_id", "term", weight.alias("w"), kth.alias("kth"))
    # all weights above zero: a document with one term's k-th best gain has at least that score
    over = Window.partitionBy("query_id")
    least = F.when(F.min("w").over(over) >= 0, F.max("kth").over(over))
    asked = asked.withColumn("least", F.coalesce(least, F.lit(float("-inf"))))
    met = asked.join(held.select("term", "grp", "most"), "term")
    bound = F.sum(F.greatest("w", F.lit(0.0)) * F.col("most")).over(Window.partitionBy("query_id", "grp"))
    return met.withColumn("bound", bound).where(F.col("bound") >= F.col("least") - 1e-5).select("grp", "query_id", "term", "w")


def search(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of each question, to six places, ties to smaller ids.

    Question words count with their multiplicity. Where fewer than ``k`` documents hold a word of the question, the
    smallest ids of the rest fill its list with score 0. All rows come from the stored index.
    """
    words = _words(queries, text)
    asks = written(asked_groups(index, queries, k, query_id, text, words), "asks")
    # what nobody asks for is left out before anything is shuffled: by term, and by group, of which there are few. The pairs of
    # both are many, and lie as so few bytes that Spark would collect them all in the driver
    groups = asks.select("grp").distinct()
    held = index.groups.join(words, "term", "left_semi").join(groups, "grp", "left_semi").select("grp", "term", "docs", "gains", F.lit(None).cast("array<long>").alias("ids"))
    own = index.members.join(groups, "grp", "left_semi")
    own = own.select("grp", F.lit(None).cast("string").alias("term"), F.lit(None).cast("array<long>").alias("docs"), F.lit(None).cast("array<double>").alias("gains"), "ids")
    rows = held.unionByName(own).withColumnRenamed("grp", "of")
    scored = asks.groupBy("grp").cogroup(rows.groupBy("of")).applyInArrow(_scorer(k), _SCORED)
    first = index.members.select(F.explode("ids").alias("doc_id")).orderBy("doc_id").limit(k)
    fill = queries.select(F.col(query_id).cast("long").alias("query_id")).distinct().crossJoin(F.broadcast(first)).select("query_id", "doc_id", F.lit(0.0).alias("score"))
    # a document that was scored outranks or equals its own fill; both may be among the first
    pool = scored.unionByName(fill).groupBy("query_id", "doc_id").agg(F.max_by("score", F.abs("score")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def version(docs: DataFrame, doc_id: str = "doc_id", size: str = "n_chars") -> str:
    """A fingerprint of ids and lengths: it changes with the corpus, and no text is read for it."""
    n, mark = docs.agg(F.count("*"), F.sum(F.xxhash64(doc_id, size).cast("decimal(20,0)"))).first()
    return f"3-{n}-{mark}"

