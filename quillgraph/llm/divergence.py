"""Source divergence audit by systolic rotation.

A group is a (lang, source); its vector holds the scaled share of each kept term of the language. Vectors are cut into
slices of terms and packed; teams of groups sit in partitions that stay where they are (one cached, partitioned table),
and in each round of a round-robin tournament the packed vectors of one team of every pair travel to the other, where
both directions are evaluated. So a round moves half the vectors at most, and no task holds more than two teams' slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quillgraph.llm.common import materialize, partitions
from quillgraph.llm.words import byte_classes, held, words_of

#: Bytes of text counted at a time; terms in a slice, about; groups in a team.
BLOCK, SLICE, TEAM = 6 << 20, 4096, 8
LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: Fixed by the contract: a term is of letters A-Z and a-z and of what is not ASCII.
KINDS = byte_classes(bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

_COUNTS = "lang string, source string, term string, n long, df long"
_PACKED = "lang string, slice int, source string, at binary, p binary"
_MET = "lang string, source string, slice int, part string, item string, at int, value long"


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents that hold it), added up within a block."""
    for lang, rows in held(batches, "lang", "text", most):
        words, row, _ = words_of(rows.column("text").combine_chunks(), KINDS)
        if not len(words):
            continue
        coded, sources = words.dictionary_encode(), rows.column("source").combine_chunks().dictionary_encode()
        codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        source = sources.indices.to_numpy()
        in_doc, n = np.unique(row * len(terms) + codes, return_counts=True)  # a document's distinct terms
        key = source[in_doc // len(terms)].astype(np.int64) * len(terms) + in_doc % len(terms)
        keys, at = np.unique(key, return_inverse=True)
        cols = [
            pa.array([lang] * len(keys), pa.string()),
            sources.dictionary.cast(pa.string()).take(pa.array(keys // len(terms))),
            terms.cast(pa.string()).take(pa.array(keys % len(terms))),
            pa.array(np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)),
            pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)),
        ]
        whole = pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "df"])
        for i in range(0, len(keys), 65_536):
            yield whole.slice(i, 65_536)


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One group's slice: places of its terms, as steps, and their shares, both deflated."""
    at, p = rows.column("at").to_numpy(), rows.column("p").to_numpy()
    order = np.argsort(at)
    steps = np.diff(at[order], prepend=0).astype(np.uint32)
    lang, slice_, source = (k.as_py() for k in key)
    packed = [zlib.compress(steps.tobytes(), 1), zlib.compress(p[order].astype(np.int64).tobytes(), 1)]
    return pa.table({"lang": [lang], "slice": pa.array([slice_], pa.int32()), "source": [source], "at": [packed[0]], "p": [packed[1]]})


def _vectors(rows: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(sources, their shares of all terms of the slice, which terms occur) of the packed rows of a seat."""
    width = rows.column("width")[0].as_py()
    sources, rest = rows.column("source").to_pylist(), rows.column("rest").to_numpy()
    shares = np.repeat(rest.astype(np.int64)[:, None], width, axis=1)
    present = np.zeros(shares.shape, bool)
    for i, (at, p) in enumerate(zip(rows.column("at").to_pylist(), rows.column("p").to_pylist(), strict=True)):
        if at is not None:
            places = np.cumsum(np.frombuffer(zlib.decompress(at), np.uint32)).astype(np.int64)
            shares[i, places] = np.frombuffer(zlib.decompress(p), np.int64)
            present[i, places] = True
    return sources, shares, present


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), exact: shares are below 2^31."""
    return (p - q) * (p - q) // (p + q)


def _met(lang: str, slice_: int, rows: list[tuple]) -> pa.Table:
    """Rows (source, part, item, at, value) of a meeting."""
    source, part, item, at, value = zip(*rows, strict=True) if rows else ((),) * 5
    k = len(rows)
    return pa.table(
        {
            "lang": pa.array([lang] * k, pa.string()),
            "source": pa.array(source, pa.string()),
            "slice": pa.array([slice_] * k, pa.int32()),
            "part": pa.array(part, pa.string()),
            "item": pa.array(item, pa.string()),
            "at": pa.array(at, pa.int32()),
            "value": pa.array(value, pa.int64()),
        }
    )


def _meeting(home: pa.Table, guests: pa.Table) -> pa.Table:
    """Groups of the seat against the guests, in this slice; the value is the same from either side, and told to both."""
    if not home.num_rows or not guests.num_rows:
        return _met("", 0, [])
    sources, shares, _ = _vectors(home)
    others, theirs, _ = _vectors(guests)
    rows = []
    for i, source in enumerate(sources):
        values = _apart(shares[i][None, :], theirs).sum(axis=1).tolist()
        for other, value in zip(others, values, strict=True):
            rows += [(source, "pair", other, None, value), (other, "pair", source, None, value)]
    return _met(home.column("lang")[0].as_py(), home.column("slice")[0].as_py(), rows)


def _home_round(top: int):
    def run(home: pa.Table, language: pa.Table) -> pa.Table:
        """Groups of one seat among themselves, and the ``top`` terms of each that stand out from the language."""
        if not home.num_rows:
            return _met("", 0, [])
        sources, shares, present = _vectors(home)
        rows = []
        for i, source in enumerate(sources):
            for j in range(i):
                value = int(_apart(shares[i], shares[j]).sum())
                rows += [(source, "pair", sources[j], None, value), (sources[j], "pair", source, None, value)]
        if language.num_rows:
            _, (q,), _ = _vectors(language)
            for i, source in enumerate(sources):
                at = np.flatnonzero(present[i] & (shares[i] > q))
                value = _apart(shares[i][at], q[at])
                for k in np.lexsort((at, -value))[:top]:  # places go by the bytes of the terms
                    rows.append((source, "term", None, int(at[k]), int(value[k])))
        return _met(home.column("lang")[0].as_py(), home.column("slice")[0].as_py(), rows)

    return run


def _share(count: str, total: str) -> F.Column:
    wide = lambda x: f"cast({x} as decimal(38,0))"
    return F.expr(f"1 + ({wide(SCALE)} * ({wide(count)} + 2)) div ({wide(total)})")


def _opponent(team: F.Column, teams: F.Column, turn: int) -> F.Column:
    """Who meets whom in round ``turn`` of a tournament of ``teams`` (even): the last team stays, the others turn."""
    ring = teams - 1
    other = F.pmod(F.lit(2 * turn) - team, ring)
    return F.when(team == ring, F.pmod(F.lit(turn), ring)).when(other == team, ring).otherwise(other)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, team: int = TEAM, slice_terms: int = SLICE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each group is from each other source of its language (part
    ``pair``, every rank), and the terms that set it apart from the whole language (part ``term``, ranks to ``top``).

    A language keeps the terms of ``least`` documents or more. Groups and languages give a kept term the share
    1 + floor(10^9 (count + 2) / (N + 2 V)); two shares differ by floor((p - q)^2 / (p + q)). Integers all through.

    Defined results: null text, lang and source are ''; each row is a document, repeated or not; groups without kept
    terms have shares all the same; a language that keeps no term gives pairs of value 0; equal values rank by the
    bytes of the item; one source alone has no pairs; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = docs.select(*[F.coalesce(c, F.lit("")).cast("string").alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(lambda batches: _counted(batches, BLOCK), _COUNTS)
    counts = materialize(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).where(F.col("df") >= least)
    kept = materialize(kept.drop("df"), "audit-kept")
    language = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    language = language.withColumn("slices", F.ceil(F.col("v") / slice_terms).cast("int"))
    sliced = kept.join(language.select("lang", "slices"), "lang")
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")).drop("slices")
    place = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1
    terms = materialize(sliced.withColumn("at", place), "audit-terms")
    width = terms.groupBy("lang", "slice").agg(F.count(F.lit(1)).cast("int").alias("width"))

    groups = texts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"))
    mine = counts.join(terms.select("lang", "term", "slice", "at"), ["lang", "term"]).select("lang", "source", "slice", "at", "n")
    totals = mine.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    roster = groups.join(totals, ["lang", "source"], "left").join(language.select("lang", "v"), "lang", "left")
    roster = roster.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("source"), "source")) - 1
    roster = roster.withColumn("number", number).withColumn("team", F.floor(F.col("number") / team).cast("int"))
    most = F.max("team").over(Window.partitionBy("lang")) + 1
    roster = materialize(roster.withColumn("teams", (most + most % 2).cast("int")), "audit-roster")

    def packed(rows: DataFrame, of: DataFrame) -> DataFrame:
        """(lang, slice, source, at, p, width, rest, ...) for every row of ``of`` in every slice of its language."""
        weight = F.col("total") + 2 * F.col("v")
        shares = rows.join(of.select("lang", "source", weight.alias("weight")), ["lang", "source"])
        shares = shares.select("lang", "slice", "source", "at", _share("n", "weight").alias("p"))
        cut = shares.groupBy("lang", "slice", "source").applyInArrow(_pack, _PACKED)
        every = of.where("v > 0").withColumn("weight", weight).join(width, "lang").withColumn("rest", _share("0", "weight"))
        return every.join(cut, ["lang", "slice", "source"], "left")

    whole = language.select("lang", F.lit("").alias("source"), "total", "v")
    seats = ["lang", "slice", "team"]
    columns = [*seats, "source", "width", "rest", "at", "p"]
    vectors = materialize(packed(mine, roster).select(*columns, "teams"), "audit-vectors")
    of_language = terms.select("lang", F.lit("").alias("source"), "slice", "at", "n")
    spoken = materialize(packed(of_language, whole).select("lang", "slice", "source", "width", "rest", "at", "p"), "audit-languages")

    def guests(rows: DataFrame):
        """Vectors by the seat they are bound for, under names of their own."""
        named = rows.select(*[F.col(c).alias("to_" + c if c in seats else c) for c in columns])
        return named.groupBy(*["to_" + c for c in seats])

    resident = vectors.select(*columns).repartition(parts, *seats).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        visits = guests(vectors.select(*seats).distinct().join(spoken, ["lang", "slice"]))
        met = [materialize(resident.groupBy(*seats).cogroup(visits).applyInArrow(_home_round(top), _MET), "audit-home")]
        rounds = (roster.agg(F.max("teams")).first()[0] or 1) - 1
        for turn in range(rounds):
            # the team of the larger number travels; a language with fewer teams is through after its own rounds
            goes = F.when(F.lit(turn) < F.col("teams") - 1, _opponent(F.col("team"), F.col("teams"), turn))
            travel = vectors.withColumn("to", goes).where(F.col("to") < F.col("team")).drop("team").withColumnRenamed("to", "team")
            meeting = resident.groupBy(*seats).cogroup(guests(travel)).applyInArrow(_meeting, _MET)
            met.append(materialize(meeting, "audit-round"))
    finally:
        resident.unpersist()
    told = met[0]
    for more in met[1:]:
        told = told.unionByName(more)
    pairs = told.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    flat = roster.where("v = 0").select("lang", "source")
    flat = flat.join(flat.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = pairs.unionByName(flat.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    named = told.where("part = 'term'").drop("item").join(terms.select("lang", "slice", "at", F.col("term").alias("item")), ["lang", "slice", "at"])
    out = pairs.unionByName(named.select("lang", "source", "part", "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return out.withColumn("rank", F.row_number().over(order).cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= top))
