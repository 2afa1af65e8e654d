"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, per-document perplexity, quantiles by language.

Units are characters with case kept (one of 256 symbols each) and the order is 5: junk shows in case, marks and letter
order, and no word is unknown. All of the model lives in tables sharded by n-gram; nothing of it is collected:

1. Trusted documents come from a join of ids. Each task counts its own 5-grams, the partial counts are summed by n-gram.
   Lower orders count how many different symbols precede an n-gram; discounts come from the counts of counts.
2. Documents are packed into batches of about ``BATCH`` characters, dealt once. A batch asks for its distinct 5-grams, and
   one join per order gives each asked n-gram its probability: the share of its context's counts, and the context's
   back-off weight times the probability of the n-gram without its first symbol.
3. The answers are joined to the batches, which sum log-probabilities by document.

Asks and answers travel as arrays, one for each batch and shard of n-grams, some 4 bytes an n-gram and way.

So a row moves for each distinct n-gram of a batch, not for each place in a text. What is asked and counted grows with
the corpus, and every table is spread by hash; only the two lowest orders, of at most 256**2 rows whatever the corpus,
are broadcast.

A document is rejected when its perplexity lies outside the ``low`` and ``high`` quantiles of trusted documents of its
language and band of length (short texts vary more). A model knows its own training texts too well, so quantiles are taken from the trusted documents of one fold
in ``FOLDS`` (by a hash of the id) and the counts from the others. Quantiles come from histograms of log-perplexity in bins of ``BIN``, so they are the same however the rows are
dealt; ``high`` is a bin's upper edge and ``low`` a lower one. Where a band has fewer than ``LEAST`` such documents, the
quantiles are those of its language, and where a language has fewer than ``FEW``, those of all. Fewer than ``FEW`` in all
tell no quantile, and nothing is rejected.

Defined results: a null or empty text has perplexity null and is accepted; a null language is a language of its own,
apart from the empty string; repeated rows are scored each, and rows of one id by their own texts; rows of null id are
judged like others; without trusted documents nothing is rejected and perplexity is null; no rows give no rows. Columns
other than id, text and language are not read here and pass through :func:`accepted` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import free_name, materialize, partitions

ORDER, SYMBOLS, BITS = 5, 256, 8
BATCH, SLICE, HELD = 1 << 24, 1 << 20, 1 << 21  # characters of a batch and of a slice; n-grams that a task holds
BIN, LEAST, FEW, FOLDS = 0.001, 500, 50, 2
BANDS = (200, 1000, 5000)  # characters
HIGH, LOW = 0.9995, 0.0005
SPREAD = 1_000_003  # a prime: n-grams by their rest of it fall evenly into shards
_LIMIT = 0x3000


def symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 the edge of a text; ASCII and Latin-1 letters by themselves; digits, blanks and others by kind."""
    t = np.full(_LIMIT, 1, np.uint8)
    for c in range(256, _LIMIT):
        if chr(c).isalpha():
            t[c] = 2 + c % 24 + 4 * chr(c).isupper()
    t[33:128] = np.arange(33, 128)
    t[192:256] = np.arange(192, 256)
    t[48:58] = 48
    t[[9, 11, 12, 13, 32, 160]] = 32
    t[10] = 31
    return t


def _grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """5-gram ids of the texts end to end, and where each text's ids start. A text of n characters has n + 1."""
    pad = "\0" * (ORDER - 1)
    joined = pad + ("\0" + pad).join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = np.where(points < _LIMIT, table[np.minimum(points, _LIMIT - 1)], 1).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + ORDER)])[:-1] + ORDER - 1  # of each text's characters
    for k in range(1, ORDER):
        sym[begin - k] = 0
    sym[begin + lengths] = 0
    ids = sym[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        ids |= sym[ORDER - 1 - k : len(sym) - k] << (BITS * k)
    keep = np.ones(len(ids), bool)  # ids that end in a pad belong to no text
    start = begin - (ORDER - 1)
    for k in range(1, ORDER):
        keep[(start - k)[1:]] = False
    return ids[keep], np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]


def _slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of about ``most`` characters; one long text is a run of its own."""
    texts, n, start = [t.as_py() or "" for t in column], len(column), 0
    while start < n:
        end, size = start, 0
        while end < n and (end == start or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield start, end, texts[start:end]
        start = end


def count_grams(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """(i, c): how often each 5-gram occurs in the trusted texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, counts = symbol_table(), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts, pa.int64())], ["i", "c"])

        for batch in batches:
            for _, _, texts in _slices(batch.column(0)):
                texts = [t for t in texts if t]
                if not texts:
                    continue
                codes, g = pd.factorize(_grams(texts, table)[0])
                c = np.bincount(codes)
                codes, held = pd.factorize(np.concatenate([held, g]))
                counts = np.bincount(codes, np.concatenate([counts, c])).astype(np.int64)
                if len(held) > HELD:
                    yield from told()
                    held, counts = held[:0], counts[:0]
        yield from told()

    partial = trusted.select(text_col).mapInArrow(count, "i long, c long")
    return partial.groupBy("i").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    n = {r[0]: r[1] for r in counts.where("c <= 4").groupBy("c").count().collect()}  # at most four rows
    if not all(n.get(k) for k in (1, 2, 3, 4)):
        return [0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2.0 * n[2])
    found = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
    return [d if 0 < d < k else 0.5 for k, d in zip((1, 2, 3), found, strict=True)]


def _level(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, v): each n-gram's discounted share of its context's counts; (h, gamma): each context's back-off weight."""
    d = _discounts(counts)
    c = F.col("c")
    cut = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
    rows = counts.select("i", F.shiftright("i", BITS).alias("h"), c.cast("double").alias("c"), cut.alias("d"))
    held = rows.groupBy("h").agg(F.sum("c").alias("n"), F.sum("d").alias("lost"))
    shares = rows.join(held.select("h", "n"), "h").select("i", ((F.col("c") - F.col("d")) / F.col("n")).alias("v"))
    return shares, held.select("h", (F.col("lost") / F.col("n")).alias("gamma"))


class Model:
    """Shares and back-off weights of the orders from 3 up; the two lowest orders as probabilities of all pairs of symbols."""

    def __init__(self, levels: dict[int, tuple[DataFrame, DataFrame]], pairs: DataFrame) -> None:
        self.levels, self.pairs = levels, pairs  # pairs: (i, p), 256**2 rows

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """(i, p) for the distinct 5-grams ``asked`` (i): at each level joins with shares, weights and the level below."""
        wanted = {ORDER: asked}
        for k in range(ORDER - 1, 2, -1):
            wanted[k] = wanted[k + 1].select(F.col("i").bitwiseAND((1 << (BITS * k)) - 1).alias("i")).distinct()
        lower = F.broadcast(self.pairs)
        for k in range(3, ORDER + 1):
            shares, weights = self.levels[k]
            below = lower.withColumnsRenamed({"i": "tail", "p": "q"})
            rows = wanted[k].join(shares, "i", "left")
            rows = rows.withColumns({"h": F.shiftright("i", BITS), "tail": F.col("i").bitwiseAND((1 << (BITS * (k - 1))) - 1)})
            rows = rows.join(weights, "h", "left").join(below, "tail")
            lower = rows.select("i", (F.coalesce("v", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p"))
        return lower


def train(trusted: DataFrame, text_col: str = "text") -> Model | None:
    """The model of ``trusted``'s texts; None if there is no text."""
    spark = trusted.sparkSession
    counts = materialize(count_grams(trusted, text_col), f"kn-counts-{ORDER}")
    if counts.isEmpty():
        return None
    levels = {}
    for k in range(ORDER, 0, -1):
        levels[k] = _level(counts)
        if k > 2:
            levels[k] = tuple(materialize(x, f"kn-level-{k}") for x in levels[k])
        if k > 1:  # lower orders count the different symbols seen before, not occurrences
            lower = counts.groupBy(F.col("i").bitwiseAND((1 << (BITS * (k - 1))) - 1).alias("i")).agg(F.count("*").alias("c"))
            counts = materialize(lower, f"kn-counts-{k - 1}")
    p = np.full((1, SYMBOLS), 1.0 / SYMBOLS)
    for k in (1, 2):  # at most 256**2 rows
        shares, weights = (x.toArrow() for x in levels[k])
        gamma, share = np.ones(SYMBOLS ** (k - 1)), np.zeros(SYMBOLS**k)
        gamma[weights.column(0).to_numpy()] = weights.column(1).to_numpy()
        share[shares.column(0).to_numpy()] = shares.column(1).to_numpy()
        p = share.reshape(-1, SYMBOLS) + gamma[:, None] * p.reshape(1, SYMBOLS)
    flat = pa.table({"i": pa.array(np.arange(SYMBOLS**2), pa.int64()), "p": pa.array(p.reshape(-1))})
    return Model({k: levels[k] for k in range(3, ORDER + 1)}, spark.createDataFrame(flat))


def _packed(docs: DataFrame, batches: int, text_at: int) -> DataFrame:
    """(batch, blob): runs of rows as compressed Arrow streams, dealt to ``batches`` by the number of their task and run."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in rows:
            for start, end, _ in _slices(batch.column(text_at), 4 * SLICE):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(start, end - start))
                at = (part * 7919 + n) % batches
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "blob"])

    return docs.mapInArrow(run, "batch int, blob binary")


def _unpacked(blob: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(blob) as stream:
        yield from stream


def _squeezed(a: np.ndarray) -> bytes:
    """An array's bytes, all first ones, all second ones and so on, compressed."""
    return pa.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), codec="zstd", asbytes=True)


def _restored(raw: bytes, n: int, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    plain = pa.decompress(raw, decompressed_size=n * wide, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(wide, n).T).view(kind).reshape(-1)


def _asks(packed: DataFrame, text_at: int, shards: int) -> DataFrame:
    """(shard, batch, n, ids): the distinct 5-grams of each batch by shard, sorted, as squeezed differences."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = symbol_table(), {}, 0

        def told() -> Iterator[pa.RecordBatch]:
            for at, parts in held.items():
                g = np.sort(pd.unique(np.concatenate(parts)))
                shard = g % SPREAD % shards
                order = np.argsort(shard, kind="stable")
                g, shard = g[order], shard[order]
                first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                runs = np.split(g, first[1:])
                cols = [shard[first].astype(np.int32), np.full(len(first), at, np.int32), np.array([len(r) for r in runs], np.int32)]
                ids = [_squeezed(np.diff(r, prepend=0)) for r in runs]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(ids, pa.binary())], ["shard", "batch", "n", "ids"])
            held.clear()

        for batch in rows:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in _unpacked(blob.as_py()):
                    for _, _, texts in _slices(part.column(text_at)):
                        held.setdefault(at, []).append(pd.unique(_grams(texts, table)[0]))
                        size += len(held[at][-1])
                if size > HELD:
                    for x, parts in held.items():
                        held[x] = [pd.unique(np.concatenate(parts))]
                    size = sum(len(parts[0]) for parts in held.values())
                    if size > HELD // 2:  # asked twice is answered twice, which changes nothing
                        yield from told()
                        size = 0
        yield from told()

    return packed.mapInArrow(run, "shard int, batch int, n int, ids binary")


def _distinct(asks: DataFrame) -> DataFrame:
    """(i): what the asks of a task hold, each once; a shard lies in one task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in rows:
            parts = [np.cumsum(_restored(x.as_py(), n, "<i8")) for n, x in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            held = pd.unique(np.concatenate([held, *parts]))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], ["i"])

    return asks.mapInArrow(run, "i long").distinct()


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """(batch, n, ids, lps): a shard's asks with log-probabilities; ``right`` has (i, p) of the shard."""
    order = np.argsort(right.column("i").to_numpy())
    keys, logs = right.column("i").to_numpy()[order], np.log(right.column("p").to_numpy()[order]).astype(np.float32)
    asked = zip(left.column("n").to_pylist(), left.column("ids"), strict=True)
    lps = [_squeezed(logs[np.searchsorted(keys, np.cumsum(_restored(x.as_py(), n, "<i8")))]) for n, x in asked]
    return pa.table({"batch": left.column("batch"), "n": left.column("n"), "ids": left.column("ids"), "lps": pa.array(lps, pa.binary())})


def perplexities(docs: DataFrame, model: Model, text_col: str = "text", batch_chars: int = BATCH) -> DataFrame:
    """``docs`` with ``n_symbols`` and ``perplexity`` in place of its text column."""
    parts = partitions(docs.sparkSession)
    at = docs.columns.index(text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    names = [f.name for f in rest] + ["n_symbols", "perplexity"]
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    packed = _packed(docs, max(1, -(-chars // batch_chars)), at).repartition(parts, "batch")
    shards = 2 * parts
    asked = _asks(packed, at, shards).repartition(parts, "shard")
    known = model.probabilities(_distinct(asked)).withColumn("shard", (F.col("i") % SPREAD % shards).cast("int"))
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_answered, "batch int, n int, ids binary, lps binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        table, out = symbol_table(), []
        rows = list(zip(right.column("n").to_pylist(), right.column("ids"), right.column("lps"), strict=True))
        keys = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_restored(x.as_py(), n, "<i8")) for n, x, _ in rows)])
        values = np.concatenate([np.zeros(0, np.float32), *(_restored(y.as_py(), n, "<f4") for n, _, y in rows)]).astype(np.float64)
        keys, first = np.unique(keys, return_index=True)
        known, values = pd.Index(keys), values[first]
        for blob in left.column("blob"):
            for part in _unpacked(blob.as_py()):
                for start, end, texts in _slices(part.column(at)):
                    ids, begin = _grams(texts, table)
                    total = np.add.reduceat(values[known.get_indexer(ids)], begin)
                    n = np.array([len(t) for t in texts])
                    value = [round(math.exp(m), 6) if c else None for m, c in zip((-total / (n + 1)).tolist(), n.tolist(), strict=True)]
                    cols = [c for k, c in enumerate(part.slice(start, end - start).columns) if k != at]
                    out.append(pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(value, pa.float64())], names))
        return pa.Table.from_batches(out)

    schema = T.StructType([*rest, T.StructField("n_symbols", T.LongType()), T.StructField("perplexity", T.DoubleType())])
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)


def _band() -> Column:
    return reduce(lambda b, e: b + (F.col("n_symbols") >= e).cast("int"), BANDS, F.lit(0))


def thresholds(scored: DataFrame, low: float, high: float) -> DataFrame:
    """(level, lang, band, lo, hi) from trusted rows (lang, n_symbols, perplexity); levels: 0 a band, 1 a language, 2 all."""
    binned = scored.where("perplexity is not null").select("lang", _band().alias("band"), F.floor(F.log("perplexity") / BIN).alias("b"))
    bands = binned.groupBy("lang", "band", "b").agg(F.count("*").alias("n")).withColumn("level", F.lit(0))
    no_lang, no_band = F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("band")
    langs = bands.groupBy("lang", "b").agg(F.sum("n").alias("n")).select("lang", no_band, "b", "n", F.lit(1).alias("level"))
    every = bands.groupBy("b").agg(F.sum("n").alias("n")).select(no_lang, no_band, "b", "n", F.lit(2).alias("level"))
    both, key = bands.unionByName(langs).unionByName(every), ["level", "lang", "band"]
    # a group has as many rows here as it has bins
    seen = both.withColumns({"seen": F.sum("n").over(Window.partitionBy(*key).orderBy("b")), "total": F.sum("n").over(Window.partitionBy(*key))})
    cut = seen.groupBy(*key).agg(
        F.exp(F.min(F.when(F.col("seen") > low * F.col("total"), F.col("b"))) * BIN).alias("lo"),
        F.exp((F.min(F.when(F.col("seen") >= high * F.col("total"), F.col("b"))) + 1) * BIN).alias("hi"),
        F.max("total").alias("n"),
    )
    return cut.where(f"n >= case when level = 0 then {LEAST} else {FEW} end").drop("n")


def _judged(rows: DataFrame, labels: DataFrame, trusted: str, low: float, high: float) -> DataFrame:
    """``rows`` (doc_id, lang, text and others) without text, with n_symbols, perplexity, lo, hi and accepted."""
    good = labels.where(trusted).select("doc_id").distinct()
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    # building on the ids alone keeps texts out of sorts
    model = train(rows.join(good.where(~held_out).hint("shuffle_hash"), "doc_id", "left_semi").select("text"))
    rest = [c for c in rows.columns if c != "text"]
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(*rest, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_symbols"), none.alias("perplexity"), none.alias("lo"), none.alias("hi"), F.lit(True).alias("accepted"))
    scored = materialize(perplexities(rows, model), "kn-scored")
    cuts = materialize(thresholds(scored.join(good.where(held_out), "doc_id", "left_semi"), low, high), "kn-cuts")
    of = lambda level: cuts.where(F.col("level") == level).select(*[F.col(c).alias(f"_{c}{level}") for c in ("lang", "band", "lo", "hi")])
    own, wide, every = of(0), of(1), of(2)
    out = scored.join(own, scored["lang"].eqNullSafe(own["_lang0"]) & (_band() == own["_band0"]), "left")
    out = out.join(wide, scored["lang"].eqNullSafe(wide["_lang1"]), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    out = out.withColumns({c: F.coalesce(f"_{c}0", f"_{c}1", f"_{c}2") for c in ("lo", "hi")})
    ok: Column = F.coalesce(F.col("perplexity").between(F.col("lo"), F.col("hi")), F.lit(True))
    return out.select(*rest, "n_symbols", "perplexity", "lo", "hi", ok.alias("accepted"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    trusted: str = "quality = 1 and toxic = 0", low: float = LOW, high: float = HIGH,
) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, lo, hi, accepted) of every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return _judged(rows, labels, trusted, low, high)


def accepted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    trusted: str = "quality = 1 and toxic = 0", low: float = LOW, high: float = HIGH,
) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns. A row is told by its id, language and text."""
    mark = F.xxhash64(id_col, lang_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), mark.alias("row"), F.col(text_col).alias("text"))
    key = free_name(docs, "row_mark")
    gone = _judged(rows, labels, trusted, low, high).where("not accepted").select(F.col("row").alias(key)).distinct()
    return docs.withColumn(key, mark).join(gone.hint("shuffle_hash"), key, "left_anti").drop(key)
