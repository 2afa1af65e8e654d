"""Quality, mixing and the pipeline."""

import importlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing, quality


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    parts = ["ta", "ri", "mo", "len", "su", "ke", "an"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    clean = lambda n: (" ".join(word() for _ in range(n)) + ".").capitalize()
    docs, labels = [], []
    for i in range(300):
        kind = "junk" if i % 10 == 0 else "toxic" if i % 10 == 1 else "clean"
        text = clean(rng.randint(30, 90))
        if kind == "junk":
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        if kind == "toxic":
            text = text.replace(" ", " vilename ", 2)
        docs.append((i, text, "en" if i % 3 else None, i, "k"))
        if i % 2 == 0 or i % 5 == 1:
            labels.append((i, 0 if kind == "junk" else 1, int(kind == "toxic")))
    docs += [(300, None, "en", 0, "k"), (301, "", "xx", 0, "k"), (302, docs[2][1], "en", 0, "k"), (302, docs[2][1], "en", 0, "k")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, perplexity long, rate string").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


def kind(i):
    return "junk" if i % 10 == 0 else "toxic" if i % 10 == 1 else "clean"


def brute_kneser_ney(texts):
    """The same model in plain Python, as nested dictionaries."""
    table, n = quality.symbol_table(), quality.ORDER
    symbols = lambda t: [0] * (n - 1) + [int(table[ord(c)]) if ord(c) < len(table) else 1 for c in t] + [0]
    count = {}
    for t in texts:
        s = symbols(t)
        for i in range(n - 1, len(s)):
            g = tuple(s[i - n + 1 : i + 1])
            count[g] = count.get(g, 0) + 1
    levels = {n: count}
    for k in range(n - 1, 0, -1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    info = {}
    for k, c in levels.items():
        m = [sum(v == j for v in c.values()) for j in range(5)]
        d = [0.5] * 3
        if all(m[1:]):
            y = m[1] / (m[1] + 2 * m[2])
            d = [x if 0 < x < j else 0.5 for j, x in ((j, j - (j + 1) * y * m[j + 1] / m[j]) for j in (1, 2, 3))]
        ctx = {}
        for g, v in c.items():
            e = ctx.setdefault(g[:-1], [0, 0.0])
            e[0] += v
            e[1] += d[min(v, 3) - 1]
        info[k] = (c, d, ctx)

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / quality.SYMBOLS
        c, d, ctx = info[len(g)]
        if g[:-1] not in ctx:
            return lower
        total, held = ctx[g[:-1]]
        v = c.get(g, 0)
        return (max(v - d[min(v, 3) - 1], 0) / total if v else 0) + held / total * lower

    def perplexity(t):
        s = symbols(t)
        logs = [math.log(p(tuple(s[i - n + 1 : i + 1]))) for i in range(n - 1, len(s))]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


def test_perplexity_matches_the_plain_model(spark, corpus):
    docs, labels, rows = corpus
    got = quality.judge(docs, labels).collect()
    fold = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS))).collect()}
    trusted = [r[1] for r in rows if r[0] < 300 and kind(r[0]) == "clean" and (r[0] % 2 == 0 or r[0] % 5 == 1) and fold[r[0]]]
    ppl = brute_kneser_ney(trusted)
    want = {r[0]: ppl(r[1]) for r in rows if r[1]}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in want:
            assert r["perplexity"] == pytest.approx(want[r["doc_id"]], rel=2e-4)
        else:
            assert r["perplexity"] is None and r["accepted"]


def test_quality_held_out(corpus):
    docs, labels, rows = corpus
    got = {r["doc_id"]: r["accepted"] for r in quality.judge(docs, labels).collect()}
    held = [i for i in range(300) if not (i % 2 == 0 or i % 5 == 1)]
    clean = [got[i] for i in held if kind(i) == "clean"]
    assert sum(clean) >= 0.9 * len(clean)  # thresholds are quantiles of the few trusted texts kept for them
    assert not any(got[i] for i in range(300) if kind(i) == "junk")
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(got[r[0]] for r in rows)


def test_quality_without_labels(spark, corpus):
    docs, labels, rows = corpus
    out = quality.judge(docs, labels.limit(0)).collect()
    assert len(out) == len(rows) and all(r["accepted"] and r["perplexity"] is None for r in out)
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_mix_meets_targets(corpus):
    docs, labels, rows = corpus
    weights = {"clean": 0.9, "junk": 0.06, "toxic": 0.04}
    out = mixing.mix(docs, labels, weights).collect()
    assert len(out) == len(rows)
    total = sum(r["tokens"] for r in out)
    for d, w in weights.items():
        assert sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in out) == pytest.approx(w * total, rel=0.03)
    for r in out:
        assert r["rate"] >= 0 and abs(sum(r[f"p_{d}"] for d in weights) - 1) < 1e-4
        assert math.floor(r["rate"]) - 1 <= r["copies"] <= math.ceil(r["rate"]) + 1
    right = [max(weights, key=lambda d: r[f"p_{d}"]) == kind(r["doc_id"]) for r in out if r["doc_id"] < 300 and not (r["doc_id"] % 2 == 0 or r["doc_id"] % 5 == 1)]
    assert np.mean(right) > 0.9


def test_words_by_chance_and_of_copies_are_not_learned(spark):
    filler = lambda i: " ".join(f"w{(i * i * 7 + k * k * 13 + i * k) % 300}" for k in range(40))
    rows = [("clean", filler(i)) for i in range(60)] + [("toxic", f"{filler(i + 7)} zorbly {filler(i + 9)}") for i in range(12)]
    rows += [("toxic", "one text told again and again with plainword in it")] * 12
    model = mixing.fit(spark.createDataFrame(rows, "domain string, text string"))
    assert model.words[1] == ["zorbly"]


def test_solve_against_nonnegative_least_squares(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 30)
    tokens = rng.integers(10, 100, 30).astype(float)
    target = [900.0, 0.0, 300.0]
    mass = spark.createDataFrame([(i, float(t), q.tolist()) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "cell int, tokens double, p array<double>")
    by = {tuple(r["p"]): r["rate"] for r in mixing.solve(mass, target, steps=200).collect()}
    rate = np.array([by[tuple(q)] for q in p.tolist()])
    a = (tokens[:, None] * p).T
    weigh = np.linalg.pinv((tokens[:, None] * p).T @ p)
    loss = lambda r: float((a @ r - target) @ weigh @ (a @ r - target))
    r = np.ones(30)
    for _ in range(20000):
        r = np.maximum(0, r - p @ (weigh @ (a @ r - target)))
    assert rate.min() >= 0 and loss(rate) <= loss(r) + 1e-3 * loss(np.ones(30))  # a first-order method: near the best, not at it


def test_mixture_of_the_pipeline_meets_its_shares(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = mixing.mix(docs, labels, pipeline.MIXTURE, anchor="clean").collect()
    drawn = {d: sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in out) for d in mixing.DOMAINS}
    for d, w in pipeline.MIXTURE.items():
        assert drawn[d] / sum(drawn.values()) == pytest.approx(w, rel=0.03, abs=5e-4), d  # half a per mille of 200 documents is less than one


def test_mix_of_equal_posteriors_loses_nothing(spark):
    """Rates document by document, by the same descent in plain Python, are those of the sums over distinct posteriors."""
    rng = np.random.default_rng(3)
    kinds = rng.dirichlet([0.4, 0.4, 0.4], 5).round(3)
    which, tokens = rng.integers(0, 5, 60), rng.integers(1, 50, 60).astype(float)
    p, target = kinds[which], [500.0, 40.0, 20.0]
    rows = spark.createDataFrame([(float(t), q.tolist()) for t, q in zip(tokens, p, strict=True)], "tokens double, p array<double>")
    got = {tuple(r["p"]): r["rate"] for r in mixing.solve(rows.groupBy("p").agg(F.sum("tokens").alias("tokens")), target, steps=25).collect()}
    a = (tokens[:, None] * p).T
    weigh = np.linalg.pinv(a @ p, rcond=1e-9)
    r = y = np.ones(60)
    at = 1.0
    for _ in range(25):
        new = np.maximum(0, y - p @ (weigh @ (a @ y - target)))
        nxt = (1 + math.sqrt(1 + 4 * at * at)) / 2
        r, y, at = new, new + (at - 1) / nxt * (new - r), nxt
    assert [got[tuple(q)] for q in p.tolist()] == pytest.approx(r.tolist(), rel=1e-3, abs=1e-3)


def test_draw(corpus):
    docs, labels, _ = corpus
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, labels, {"clean": 1.0}, anchor="clean").collect()}
    out = mixing.draw(docs, labels, {"clean": 1.0}, anchor="clean")
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert set(kept) == {i for i, c in copies.items() if c} and kept.count(302) == 2 * copies[302]
    assert np.mean([copies[i] > 0 for i in range(300) if kind(i) == "clean"]) > 0.9
    assert np.mean([copies[i] > 0 for i in range(300) if kind(i) == "junk"]) < 0.1
    assert mixing.draw(docs.limit(0), labels, {"clean": 1.0}).count() == 0


def test_pipeline(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        assert after.columns == docs.columns, name
        after = after.cache()
        assert 0 < after.count() <= 1.05 * now.count(), name
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        now = after
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0")
    from quillgraph.llm import ngram_join

    rep = ngram_join.similar(docs).where("doc_id = component_id")
    alone = clean.join(rep, "doc_id", "left_semi").count()
    assert now.join(clean, "doc_id", "left_semi").count() >= 0.97 * alone
    assert now.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    out = pipeline.run(spark, sf)
    assert out.count() == now.count()
