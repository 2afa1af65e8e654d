"""Mixing sources to target weights by soft membership (native).

1. A naive Bayes classifier is fitted on at most ``SAMPLE`` labelled rows (the smallest hashes of their ids). All its
   features are learned from these rows, near copies told once: how many words a text has that set a domain apart from
   the clean one (every word that passes a test of its odds, at a level for as many words as are tested, counts; so
   their number is bounded by the sample), and the shares of each mark, of
   capitals and of repeated words; all are cut into bins at quantiles of the sample. Each document gets posteriors of all domains, to three decimals.
2. A document's rate is the number of times it should be drawn, at least 0. Rates solve least squares: the expected
   tokens of each domain, summed over documents as rate * tokens * posterior, should equal the domain's target.
   Projected gradient descent (with momentum) starts at rate 1; each step adds up the residual over all documents and
   moves every rate against its own share of it, cut at 0.

A step moves a document's rate by a function of its posteriors and the residual alone, and all rates start equal. So, by
induction, documents of equal posteriors have equal rates at every step: the sums over documents are sums over distinct
posteriors weighed by their tokens, with nothing lost. Posteriors of three decimals bound these at half a million rows
whatever the corpus; they lie in ``SPREAD`` partitions, and each step is one aggregation of them.

Defined results: a null or empty text has 0 tokens and the posteriors of a text without features; repeated rows are
counted and drawn each, with the same copies; rows of null id are drawn once; no labelled rows give equal posteriors; no
rows give no rows. Other columns pass through :func:`draw` unchanged.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import free_name, materialize, unit_hash

DOMAINS = ("clean", "junk", "toxic")
DOMAIN_OF = "case when quality = 0 then 'junk' when toxic = 1 then 'toxic' when quality = 1 then 'clean' end"
SAMPLE, STEPS = 8192, 64
SPREAD = 8  # tasks that hold the distinct posteriors
LEAST, ODDS, BINS = 5, 2.0, 5  # documents of a listed word, its log odds, bins of a share
#: the printable ASCII marks: the classes of characters whose shares are features, besides capitals
MARKS = "!#$%&*+;<=>?@^_`{|}~\\/\"'()[]:-"


def _read(text: Column) -> dict[str, Column]:
    """Of a whole text, in two passes: its words in lower case (all beyond ASCII counts as letters), and its capitals and marks.

    A text that begins or ends with a mark has an empty first or last word.
    """
    return {
        "words": F.split(F.lower(text), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"),
        "rest": F.regexp_replace(text, "[a-z0-9\\s.,\\x80-\\x{10FFFF}]+", ""),
        "chars": F.greatest(F.length(text), F.lit(1)).cast("double"),
    }


def _features(words: list[list[str]]) -> Column:
    """An array over the columns of :func:`_read`: each mark's share, all marks', capitals', repeated words', and hits of ``words``."""
    rest, n = F.col("rest"), F.col("chars")
    each = F.transform(F.array(*[F.lit(m) for m in MARKS]), lambda m: (F.length(rest) - F.length(F.replace(rest, m, F.lit("")))) / n)
    left = F.length(F.translate(rest, MARKS, ""))
    # of words beyond the first ones, which seldom repeat even in clean text
    repeats = 1.0 - (F.size(F.array_distinct("words")) + 8.0) / (F.greatest(F.size("words"), F.lit(1)) + 8.0)
    array = lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    found = F.array_intersect("words", array(sorted({w for listed in words for w in listed})))
    hits = [F.size(F.array_intersect(found, array(listed))).cast("double") for listed in words]
    return F.concat(each, F.array((F.length(rest) - left) / n, left / n, repeats, *hits))


def _tokens() -> Column:
    empty = lambda w: F.when(w == "", 1).otherwise(0)
    ends = F.when(F.size("words") > 1, empty(F.element_at("words", 1)) + empty(F.element_at("words", -1))).otherwise(empty(F.element_at("words", 1)))
    return (F.size("words") - ends).cast("long")


def _table(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]).cast("array<double>") for row in rows])


def _binned(read: DataFrame, words: list[list[str]], cuts: list[list[float]]) -> DataFrame:
    """``read`` with ``_b``, the bin of each feature: how many of its edges lie below it."""
    df = read.withColumn("_f", _features(words))
    return df.withColumn("_b", F.zip_with("_f", _table(cuts), lambda f, edges: F.size(F.filter(edges, lambda e: e < f)))).drop("_f")


class Classifier:
    """Log weights of the domains for each bin of each feature; the features are shares, and hits of each domain's words."""

    def __init__(self, prior: list[float], bins: list[tuple[list[float], list[list[float]]]], words: list[list[str]]) -> None:
        self.prior, self.bins, self.words = prior, bins, words  # bins: edges and weights of each feature, in their order

    def posteriors(self, read: DataFrame) -> DataFrame:
        """``read`` (the columns of :func:`_read` and others) with ``p``, an array in the order of ``DOMAINS``."""
        if not self.bins:
            return read.withColumn("p", F.array(*[F.lit(round(1.0 / len(DOMAINS), 3)) for _ in DOMAINS]))
        df = _binned(read, self.words, [edges for edges, _ in self.bins])
        add = lambda acc, v: acc + v

        def score(d: int) -> Column:
            return F.aggregate(F.zip_with("_b", _table([[w[d] for w in logs] for _, logs in self.bins]), lambda b, w: F.get(w, b)), F.lit(self.prior[d]), add)

        df = df.withColumn("_s", F.array(*[score(d) for d in range(len(DOMAINS))]))
        df = df.withColumn("_e", F.transform("_s", lambda v: F.exp(v - F.array_max("_s"))))
        df = df.withColumn("_p", F.transform(F.slice("_e", 2, len(DOMAINS) - 1), lambda v: F.round(v / F.aggregate("_e", F.lit(0.0), add), 3)))
        first = F.round(1.0 - F.aggregate("_p", F.lit(0.0), add), 3)
        return df.withColumn("p", F.concat(F.array(first), "_p")).drop("_b", "_s", "_e", "_p")


def _sketch() -> Column:
    """The smallest hash of a text's runs of five words (of all its words, if fewer): near copies mostly share it."""
    w = F.col("words")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5)))
    return F.array_min(runs)


def _apart(domain: str, n: dict[str, int], tested: int) -> Column:
    """Whether a word sets ``domain`` apart from the clean one: by its odds, and by more than chance among ``tested`` words.

    If clean documents and those of the domain held the word alike, at least this many of its documents would be the
    domain's with a probability below exp(-gain) (Chernoff); less than one of all tested words gets so far by chance.
    """
    t, c = F.col(domain), F.col("clean")
    odds = F.log((t + 0.5) / (n[domain] + 1.0)) - F.log((c + 0.5) / (n["clean"] + 1.0))
    part = min(max(n[domain] / max(n[domain] + n["clean"], 1), 1e-9), 1.0 - 1e-9)
    gain = t * (F.ln(t) - F.ln(t + c) - math.log(part)) + F.when(c > 0, c * (F.ln(c) - F.ln(t + c) - math.log(1.0 - part))).otherwise(0.0)
    return (t >= LEAST) & (odds > ODDS) & F.coalesce(gain > math.log(max(tested, 1)), F.lit(False))


def fit(sample: DataFrame) -> Classifier:
    """The classifier of rows (domain, text), whose number the caller bounds."""
    read = materialize(sample.select("domain", *[c.alias(n) for n, c in _read(F.col("text")).items()]), "mix-read")
    count = lambda df: {d: 0 for d in DOMAINS} | {r[0]: r[1] for r in df.groupBy("domain").count().collect()}
    all_of = count(read)
    total = sum(all_of.values())
    if not total:
        return Classifier([0.0] * len(DOMAINS), [], [])
    prior = [math.log((all_of[d] + 1.0) / (total + len(DOMAINS))) for d in DOMAINS]
    # copies of a text are no independent witnesses: one row of those that share their smallest shingle tells
    read = read.groupBy("domain", _sketch().alias("_k")).agg(F.min(F.struct("words", "rest", "chars")).alias("_r")).select("domain", "_r.*")
    read = materialize(read.coalesce(SPREAD), "mix-told")
    n = count(read)
    held = read.select("domain", F.explode(F.array_distinct("words")).alias("w")).where("w <> ''").groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    held = materialize(held.coalesce(SPREAD), "mix-words")
    apart = {d: _apart(d, n, held.count()) for d in DOMAINS[1:]}
    listed = held.select("w", *[c.alias(d) for d, c in apart.items()]).where(reduce(Column.__or__, [F.col(d) for d in apart])).collect()  # bounded by the sample
    words = [sorted(r["w"] for r in listed if r[d]) for d in apart]
    # edges between bins: quantiles of the sample's values above 0; no value above 0, one bin
    some, points = len(MARKS) + 3 + len(words), [(i + 1) / BINS for i in range(BINS - 1)]
    at = lambda k: F.get("_f", F.lit(k))
    got = read.withColumn("_f", _features(words)).agg(*[F.percentile(F.when(at(k) > 0, at(k)), points).alias(f"q{k}") for k in range(some)]).first()
    cuts = [sorted({0.0, *row}) if row else [] for row in got]
    counted = _binned(read, words, cuts).select("domain", F.posexplode("_b").alias("f", "b")).groupBy("domain", "f", "b").count().collect()  # domains x features x bins
    seen = [np.full((len(cut) + 1, len(DOMAINS)), 0.5) for cut in cuts]
    for r in counted:
        seen[r["f"]][r["b"], DOMAINS.index(r["domain"])] += r["count"]
    return Classifier(prior, [(cut, np.log(x / x.sum(axis=0)).tolist()) for cut, x in zip(cuts, seen, strict=True)], words)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, p) of every row: its number of words and the posteriors in the order of ``DOMAINS``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = labels.withColumn("domain", F.expr(DOMAIN_OF)).where("domain is not null and doc_id is not null")
    known = named.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # the bound on labelled rows
    model = fit(rows.join(F.broadcast(picked), "doc_id").select("domain", "text"))
    read = rows.select("doc_id", *[c.alias(n) for n, c in _read(F.col("text")).items()])
    return materialize(model.posteriors(read).select("doc_id", _tokens().alias("tokens"), "p"), "mix-rows")


def solve(mass: DataFrame, target: list[float], steps: int = STEPS, tolerance: float = 1e-5) -> DataFrame:
    """(p, rate) for ``mass`` (p array, tokens), one row for each p: nonnegative rates whose expected domain totals approach ``target``."""
    k = len(target)
    p = [F.get("p", F.lit(d)) for d in range(k)]
    gram = [F.sum(F.col("tokens") * p[a] * p[b]).alias(f"g{a}_{b}") for a in range(k) for b in range(k)]
    row = mass.agg(*gram).first()
    g = np.array([[row[f"g{a}_{b}"] or 0.0 for b in range(k)] for a in range(k)])
    if not np.abs(g).max() > 0:
        return mass.select("p", F.lit(1.0).alias("rate"))
    # residuals are weighed by the inverse Gram matrix: domains count alike, and a step of 1 is the longest that is stable
    weigh = np.linalg.pinv(g, rcond=1e-9)
    size = max(1.0, float(np.abs(target).max()))
    moves: list[Column] = []

    def state() -> Column:
        """Rate and look-ahead point after all moves so far, cell by cell: a fold, so nothing is written between steps."""
        start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
        if not moves:
            return start

        def step(acc: Column, m: Column) -> Column:
            share = F.aggregate(F.zip_with("p", m["g"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            r = F.greatest(F.lit(0.0), acc["y"] - share)
            return F.struct(r.alias("r"), (r + m["b"] * (r - acc["r"])).alias("y"))

        return F.aggregate(F.array(*moves), start, step)

    at, before = 1.0, None
    for _ in range(steps):
        ahead = mass.withColumn("_y", state()["y"])
        sums = ahead.agg(*[F.sum(F.col("_y") * F.col("tokens") * p[d]).alias(f"s{d}") for d in range(k)]).first()
        residual = np.array([(sums[f"s{d}"] or 0.0) - target[d] for d in range(k)])
        if np.abs(residual).max() <= tolerance * size or (before is not None and np.abs(residual - before).max() <= 1e-7 * size):
            break
        before, nxt = residual, (1.0 + math.sqrt(1.0 + 4.0 * at * at)) / 2.0
        grad = F.array(*[F.lit(float(x)) for x in weigh @ residual])
        moves.append(F.struct(grad.alias("g"), F.lit((at - 1.0) / nxt).alias("b")))
        at = nxt
    return mass.select("p", state()["r"].alias("rate"))


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None, anchor: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", snap: float = 0.01,
) -> DataFrame:
    """(doc_id, tokens, p_<domain>.., rate, copies) of every row.

    ``weights`` are relative; targets add up to ``total`` tokens, by default those of ``docs``. With ``anchor`` they add
    up so that this domain keeps the tokens it has. ``copies`` is the rate rounded up or down by a hash of the id, in
    proportion; rates within ``snap`` of a whole number are that number.
    """
    rows = classify(docs, labels, id_col, text_col)
    # half a million rows at most, whatever the corpus: a few tasks a step are enough
    mass = materialize(rows.groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")).coalesce(SPREAD), "mix-mass")
    sums = mass.agg(*[F.sum(F.col("tokens") * F.get("p", F.lit(d))).alias(x) for d, x in enumerate(DOMAINS)]).first()
    have = [sums[x] or 0.0 for x in DOMAINS]
    share = np.array([float(weights.get(d, 0.0)) for d in DOMAINS])
    share = share / share.sum()
    if anchor:
        at = DOMAINS.index(anchor)
        total = have[at] / share[at]
    target = (share * (sum(have) if total is None else total)).tolist()
    # three decimals that add up to one: 501,501 posteriors at most, whatever the corpus, and many rows share one
    out = rows.join(F.broadcast(materialize(solve(mass, target), "mix-solved")), "p")
    rate = F.round(F.col("rate"), 6)
    near = F.round(rate, 0)
    whole = F.when(F.abs(rate - near) <= snap, near).otherwise(F.floor(rate + unit_hash(F.col("doc_id"), seed="mix")))
    return out.select(
        "doc_id", "tokens", *[F.get("p", F.lit(d)).alias(f"p_{x}") for d, x in enumerate(DOMAINS)],
        rate.alias("rate"), whole.cast("long").alias("copies"),
    )


def draw(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with every row as often as :func:`mix` says, columns unchanged.

    Rows of one id stay together, whatever their texts: each comes as often as the one of them that comes most. A row
    without an id comes once.
    """
    n, i = free_name(docs, "copies"), free_name(docs, "copy")
    copies = mix(docs, labels, weights, id_col=id_col, **how).groupBy("doc_id").agg(F.max("copies").alias(n))
    copies = copies.where("doc_id is not null").withColumnRenamed("doc_id", id_col)
    joined = docs.join(copies.hint("shuffle_hash"), id_col, "left").withColumn(n, F.coalesce(n, F.lit(1)))  # a null id: once
    joined = joined.where(F.col(n) > 0)
    return joined.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
