"""Phrase collocation mining by hierarchical pair naming.

Level 1 names the frequent words of a language. Level k reads, block by block, the sequence of frequent (k-1)-gram names,
counts adjacent pairs of them, sums the counts over all blocks, and names the pairs that are frequent after the first
block that has them; the names go back to the blocks, where they make the next sequence. A block's counts are shuffled
once: sum and name are windows over a pair's blocks, which spill where they are many. A name's two parents are its first and last k-1 words, so the
counts of all cuts, and the longer phrases that hold a phrase, are joins along parents: no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize
from quillgraph.llm.words import byte_classes, held, words_of

#: Bytes of text that a block holds.
BLOCK = 20 << 20
LEAST, WORDS, TOP = 10, 3, 2000
#: Fixed by the contract: blanks between words, and breaks between pieces.
KINDS = byte_classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")

_WORDS = "block long, lang string, code int, word string, n long, codes binary"
_PAIRS = "block long, lang string, code int, a long, b long, n long, codes binary"


def _coded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (lang, text): a row for each distinct word with its code and count, and one row with all codes in order."""
    task, block = TaskContext.get().partitionId() << 12, 0  # 4,096 blocks of a task are 80 GB of its text
    for lang, rows in held(batches, "lang", "text", most):
        words, _, opens = words_of(rows.column("text").combine_chunks(), KINDS)
        if not len(words):
            continue
        coded = words.dictionary_encode()
        codes, known = coded.indices.to_numpy(), coded.dictionary
        at = np.arange(len(codes)) + np.cumsum(opens)  # a gap before each piece
        line = np.full(at[-1] + 1, -1, np.int32)
        line[at] = codes
        if block >> 12:
            raise OverflowError("more than 4,096 blocks in one task: read the corpus in smaller splits")
        yield _rows(task + block, lang, {"word": known.cast(pa.string())}, np.bincount(codes, minlength=len(known)), line)
        block += 1


def _rows(block: int, lang: str, key: dict[str, pa.Array], n: np.ndarray, line: np.ndarray | None) -> pa.RecordBatch:
    k, more = len(n), int(line is not None)
    cols = {
        "block": pa.array(np.full(k + more, block), pa.int64()),
        "lang": pa.array([lang] * (k + more), pa.string()),
        "code": pa.concat_arrays([pa.array(np.arange(k), pa.int32()), pa.nulls(more, pa.int32())]),
        **{c: pa.concat_arrays([v, pa.nulls(more, v.type)]) for c, v in key.items()},
        "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(more, pa.int64())]),
        "codes": pa.concat_arrays([pa.nulls(k, pa.binary()), pa.array([] if line is None else [line.astype(np.int32).tobytes()], pa.binary())]),
    }
    return pa.RecordBatch.from_pydict(cols)


def _paired(lines: pa.Table, names: pa.Table, keep: bool) -> pa.Table:
    """Adjacent pairs of named codes of one block, counted; with ``keep`` also the sequence of pair codes."""
    if not lines.num_rows or not names.num_rows:
        return None
    line = np.frombuffer(lines.column("codes")[0].as_py(), np.int32)
    name = names.column("id").to_numpy()
    to = np.full(int(line.max()) + 2, -1, np.int32)  # the last place is that of -1
    to[names.column("code").to_numpy()] = np.arange(len(name))
    seq = to[line]
    ok = (seq[1:] >= 0) & (seq[:-1] >= 0)
    pairs, inverse, n = np.unique(seq[:-1][ok] * np.int64(len(name)) + seq[1:][ok], return_inverse=True, return_counts=True)
    if not len(pairs):
        return None
    line = None
    if keep:
        line = np.full(len(ok), -1, np.int32)
        line[ok] = inverse
    key = {"a": pa.array(name[pairs // len(name)], pa.int64()), "b": pa.array(name[pairs % len(name)], pa.int64())}
    return _rows(lines.column("of")[0].as_py(), lines.column("lang")[0].as_py(), key, n, line)


def _mark() -> F.Column:
    """A number for a code of a block: blocks are below 2^32 and codes below 2^31."""
    return F.col("block") * F.lit(1 << 31) + F.col("code")


def _named(coded: DataFrame, key: list[str], least: int) -> DataFrame:
    """(block, code, lang, key, f, id, own): codes of all blocks whose key is frequent, with its count over all blocks and
    its name, the mark of the first block and code that has it; ``own`` in that one row."""
    over = Window.partitionBy(*key)
    rows = coded.where("code is not null").select("block", "code", "lang", *[k for k in key if k != "lang"], "n", _mark().alias("mark"))
    rows = rows.withColumns({"f": F.sum("n").over(over), "id": F.min("mark").over(over)}).where(F.col("f") >= least)
    return materialize(rows.select("block", "code", "lang", *[k for k in key if k != "lang"], "f", "id", (F.col("mark") == F.col("id")).alias("own")), "phrases-named")


def named_phrases(docs: DataFrame, least: int = LEAST, words: int = WORDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(phrases of 1 to ``words`` words that occur ``least`` times, words by language), counted over whole texts.

    Phrases: id, lang, size, phrase, f, first and last (the names of its parents), heads and tails (counts of its first
    1, 2, .. and last .., 2, 1 words). ``least`` bounds a phrase only: all parts of a frequent phrase are frequent.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    coded = materialize(texts.mapInArrow(lambda batches: _coded(batches, block), _WORDS), "phrases-1")
    totals = materialize(coded.where("code is not null").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-n")
    none = F.array().cast("array<long>")
    named = _named(coded, ["lang", "word"], least)
    level = named.where("own").select(
        "id", "lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), "f",
        F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), none.alias("heads"), none.alias("tails"),
    )
    levels = [level]
    for size in range(2, words + 1):
        lines = coded.where("code is null").select(F.col("block").alias("of"), "lang", "codes")
        pairs = lines.groupBy("of").cogroup(named.select("block", "code", "id").groupBy("block"))
        coded = materialize(pairs.applyInArrow(_pairing(size < words), _PAIRS), f"phrases-{size}")
        if size < words:
            named = _named(coded, ["a", "b"], least)
            found = named.where("own").select("id", "lang", "a", "b", "f")
        else:  # nothing reads the blocks again: counts are enough
            found = coded.where("code is not null").groupBy("a", "b").agg(F.min(_mark()).alias("id"), F.min("lang").alias("lang"), F.sum("n").alias("f"))
            found = found.where(F.col("f") >= least)
        left = level.select(F.col("id").alias("a"), F.col("phrase").alias("p"), F.col("f").alias("fa"), F.col("heads"))
        right = level.select(F.col("id").alias("b"), F.substring_index("phrase", " ", -1).alias("w"), F.col("f").alias("fb"), F.col("tails"))
        level = materialize(
            found.join(left, "a")
            .join(right, "b")
            .select(
                "id", "lang", F.lit(size).alias("size"), F.concat_ws(" ", "p", "w").alias("phrase"), "f",
                F.col("a").alias("first"), F.col("b").alias("last"),
                F.concat("heads", F.array("fa")).alias("heads"), F.concat(F.array("fb"), "tails").alias("tails"),
            ),
            "phrases-names",
        )
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, totals


def _pairing(keep: bool):
    def run(lines: pa.Table, names: pa.Table) -> pa.Table:
        got = _paired(lines, names, keep)
        if got is None:
            got = _rows(0, "", {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}, np.zeros(0, np.int64), None)
        return pa.Table.from_batches([got])

    return run


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP, share: int = 50, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by how far they stick together.

    The score is floor(1000000 a a / (l r)) at the cut where it is lowest (ties: the earliest cut). A phrase goes where
    a longer one that holds it has at least ``share`` percent of its count: by monotone counts, one a word longer.
    Products are exact: decimals of 38 digits, enough for counts below 10^15.

    Defined results: null text is empty, null lang is ``und``; repeated rows count again; texts of any length are read
    whole; equal scores and counts rank by the bytes of the phrase; an empty table gives no rows; other columns are not
    read.
    """
    phrases, totals = named_phrases(docs, least, words, block)
    longer = phrases.where("size > 2").select(F.explode(F.array("first", "last")).alias("id"), F.col("size") - 1, "f").toDF("id", "size", "longer")
    longer = longer.groupBy("size", "id").agg(F.max("longer").alias("longer"))
    kept = phrases.where("size > 1").join(longer, ["size", "id"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.posexplode(F.arrays_zip("heads", "tails")).alias("k", "cut"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.col("cut.heads").alias("l"), F.col("cut.tails").alias("r"))
    wide = lambda c: f"cast({c} as decimal(38,0))"
    scored = cuts.withColumn("score", F.expr(f"({wide(1000000)} * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    ranked = lowest.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
