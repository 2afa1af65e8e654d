"""Names and resolution against plain loops over all of them."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillgraph.config import ResolutionParams
from quillgraph.operators import blocks, kg, names, resolution

P = ResolutionParams()
SYLLABLES = ["an", "bel", "cor", "da", "el", "fin", "gra", "ho", "ist", "jo", "ka", "lu"]


def made_names(n, seed=4):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))).title() for _ in range(rng.randint(1, 3)))
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(base))
            kind = rng.random()
            out.append(base[:at] + base[at + 1 :] if kind < 0.4 else base[:at] + rng.choice("aeiou") + base[at:] if kind < 0.8 else rng.choice(["Dr. ", "prof "]) + base.upper())
    rng.shuffle(out)
    return out[:n]


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(1)
    py = random.Random(9)
    listed = ["Ada Lovelace", "Grace Hopper"]
    bases = {}
    rows = []
    for i, name in enumerate(made_names(3000)):
        kind = py.choice(["PERSON", "PERSON", "PERSON", "COURSE", None])
        key = (name.replace("Dr. ", "").replace("prof ", "").lower()[:4], kind)
        center = bases.setdefault(key, rng.normal(size=6))
        vec = None if py.random() < 0.05 else [0.0] * 6 if py.random() < 0.02 else (center + rng.normal(size=6) * py.choice([0.02, 0.2, 0.4])).tolist()
        canonical = py.choice(listed) if py.random() < 0.02 else None
        rows.append((i * 3, name if py.random() > 0.01 else "", kind, canonical, vec))
    return rows


def plain_resolve(rows, p, judge=None):
    """The loop over all mentions: listed ones first, then the rest in order."""
    from quillgraph.functions import expr as E  # noqa: F401

    import re

    def norm(n):
        n = re.sub(r"^(?:dr|prof|professor|mr|mrs|ms|miss|sir|madam)\.?\s+", "", n.strip(" ").lower())
        n = re.sub(r"\s*&\s*", " and ", n).replace("-", " ")
        return re.sub(r"\s+", " ", re.sub(r"\s+\(", "(", n)).strip(" ")

    entities, aliases, exact, vecs, out = [], [], {}, {}, {}
    name_of = {}
    for o, name, kind, canonical, _ in rows:
        kind = kind or ""
        if canonical is not None:
            key = (norm(canonical), kind)
            if key not in exact:
                exact[key] = o
                entities.append((o, kind))
                name_of[o] = canonical
            e = exact[key]
            if name.lower() != canonical.lower() and (kind, name, e) not in [(a[0], a[1], a[2]) for a in aliases]:
                aliases.append((kind, name, e, o))
            exact.setdefault((norm(name), kind), e)
            out[o] = (name_of[e], "alias")
    for o, name, kind, canonical, vec in rows:
        kind = kind or ""
        if canonical is not None:
            continue
        key = (norm(name), kind)
        if key in exact:
            out[o] = (name_of[exact[key]], "exact")
            continue

        def cos(e, vec=vec):
            a, b = vec, vecs.get(e)
            if a is None or b is None:
                return 0.0
            n = np.linalg.norm(a) * np.linalg.norm(b)
            return float(np.dot(a, b) / n) if n else 0.0

        best, at = 0.0, None
        top = sorted(((-names.indel_ratio(name, name_of[e]), i, e) for i, (e, k) in enumerate(entities) if k == kind))[: p.candidates]
        for r, _, e in top:
            same = kind == "PERSON" and name.split()[-1:] and name_of[e].split()[-1:] and name.split()[-1].lower() == name_of[e].split()[-1].lower()
            score = min(1.0, p.embedding_weight * cos(e) - p.fuzzy_weight * r + (p.surname_bonus if same else 0))
            if score > best:
                best, at = score, e
        order = {e: i for i, (e, _) in enumerate(entities)}
        for r, _, _, e in sorted(((-names.indel_ratio(name, a), order[e], ao, e) for k, a, e, ao in aliases if k == kind))[: p.candidates]:
            score = min(1.0, p.embedding_weight * cos(e) - p.fuzzy_weight * r)
            if score > best:
                best, at = score, e
        action = "auto_merge" if best >= p.auto_merge else "review" if best >= p.review else "new_entity"
        if action == "review" and judge is not None and judge(name, at, best):
            action = "judge_merge"
        if action in ("auto_merge", "judge_merge"):
            if name.lower() != name_of[at].lower():
                aliases.append((kind, name, at, o))
            exact[key] = at
            out[o] = (name_of[at], action)
        else:
            entities.append((o, kind))
            name_of[o], vecs[o], exact[key] = name, vec, o
            out[o] = (name, action)
    return out


def _lenient(name, at, score):
    return score >= 0.91


@pytest.mark.parametrize("chunk,judge", [(256, None), (40, _lenient)])
def test_resolution_is_the_loop_over_3000_names(spark, many, monkeypatch, chunk, judge):
    monkeypatch.setattr(resolution, "CHUNK", chunk)
    rows = many if chunk > 100 else many[:700]
    df = spark.createDataFrame(rows, "ordinal long, name string, kind string, canonical string, vec array<double>").repartition(5)
    got = {r["ordinal"]: (r["entity_name"], r["action"]) for r in resolution.resolve(df, judge=judge).collect()}
    want = plain_resolve(rows, P, judge)
    wrong = {o: (got.get(o), w) for o, w in want.items() if got.get(o) != w}
    assert not wrong and len(got) == len(rows)
    seen = {a for _, a in want.values()}
    assert {"alias", "exact", "auto_merge", "review", "new_entity"} <= seen


def test_resolve_small(spark):
    rows = [(1, "Ada Lovelace", "PERSON", None, [1.0, 0.0]), (2, "Dr. Ada Lovelace", "PERSON", None, [1.0, 0.0]), (3, "Ada Lovelac", "PERSON", None, [1.0, 0.0]), (4, "Grace Hopper", "PERSON", None, [0.0, 1.0])]
    out = {r["ordinal"]: r for r in resolution.resolve(spark.createDataFrame(rows, "ordinal int, name string, kind string, canonical string, vec array<double>")).collect()}
    assert out[1]["entity_id"] == out[2]["entity_id"] == out[3]["entity_id"] != out[4]["entity_id"]
    assert [out[i]["action"] for i in (1, 2, 3, 4)] == ["new_entity", "exact", "auto_merge", "new_entity"]


def test_resolve_of_nothing(spark):
    none = spark.createDataFrame([], "ordinal long, name string, kind string, canonical string, vec array<double>")
    assert resolution.resolve(none).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abcé ", max_size=9), min_size=2, max_size=25), st.sampled_from([0.4, 0.67, 0.75, 0.9]))
def test_alike_finds_every_pair(spark, texts, least):
    rows = [("k", i, t) for i, t in enumerate(texts)]
    a = spark.createDataFrame(rows, "kind string, i long, name string")
    got = {(r["i"], r["j"]) for r in names.alike(a, a.withColumnRenamed("i", "j"), least).collect() if r["i"] != r["j"]}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and names.indel_ratio(a, b) >= least - 1e-12}
    assert got == want


def test_fuzzy_top_is_the_loop_over_3000_names(spark):
    some = sorted(set(made_names(3000)))
    rows = [("ab"[i % 2], n) for i, n in enumerate(some)]
    got = {}
    for r in kg.fuzzy_top(spark.createDataFrame(rows, "kind string, name string")).collect():
        got.setdefault((r["kind"], r["name"]), []).append((r["rank"], r["other"], r["ratio"]))
    for kind in "ab":
        own = [n for k, n in rows if k == kind]
        for n in random.Random(1).sample(own, 150):
            want = sorted((-round(names.indel_ratio(n, o), 6), o) for o in own if o != n)[:5]
            assert [(o, -r) for _, o, r in sorted(got[kind, n])] == [(o, r) for r, o in want], n


def test_nearest_blocks_are_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vs = [(i, rng.integers(-2, 3, 4).astype(float).tolist() if i % 9 else None) for i in range(400)] + [(900, [0.0] * 4), (901, [1.0, 2.0])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(blocks, "ROWS", 50)
    q = spark.createDataFrame([(i, v) for i, v in vs if i % 40 == 1], "query_id long, qvec array<double>")
    from quillgraph.operators import search

    got = {}
    for r in search.knn(df, q, 6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))

    def cos(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    for i, v in vs:
        if i % 40 == 1:
            want = sorted((-round(cos(v, w), 6) + 0.0, j) for j, w in vs)[:6]
            assert [(j, s) for _, j, s in sorted(got[i])] == [(j, -s + 0.0) for s, j in want]


def test_names_side_by_side_have_the_plain_ratio():
    rng = random.Random(2)
    some = ["".join(rng.choice("abcé 好") for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 127, 128, 129, 200) for _ in range(4)]
    coded = names.Coded(some)
    for a in some:
        assert coded.ratios(a, np.ones(len(some), bool)).tolist() == [names.indel_ratio(a, b) for b in some]


def test_only_names_that_may_merge_wait_for_each_other(spark):
    # near by vector and of one surname, but far too unlike for review: each would have met all others in one component
    rows = [(i, f"{'abcdefghij'[i % 10] * 9} {'klmnopqrst'[i // 10] * 9} Ng", "PERSON", None, [2.0] + [float(k == i) for k in range(60)] + [0.0]) for i in range(60)]
    rows += [(100 + n, name, "PERSON", None, [0.0] * 61 + [1.0]) for n, name in enumerate(["Ada Lovelace", "Ada Lovelac"])]
    mentions = spark.createDataFrame(rows, "ordinal long, name string, kind string, canonical string, vec array<double>")
    found, _ = resolution.registry(mentions)
    none = spark.createDataFrame([], "kind string, name string, entity long, place long")
    near, deep = resolution._cosines(found, P)
    assert deep.count() == 59
    movable, rivals = resolution.candidates(found, none, near, P)
    assert [r["a"] for r in movable.collect()] == ["Ada Lovelac"]
    assert rivals.count() == 1
    got = {r["ordinal"]: (r["entity_name"], r["action"]) for r in resolution.resolve(mentions).collect()}
    assert got == plain_resolve(rows, P)


def test_nearest_of_other_ids_and_of_one_label(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist(), None if i % 11 == 0 else i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    asked = df.where("vec_id % 20 = 1").selectExpr("vec_id as query_id", "embedding as qvec", "label as qlabel")
    monkeypatch.setattr(blocks, "ROWS", 30)
    from quillgraph.operators import search

    def cos(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / n) if n else 0.0

    for same in (None, ("label", "qlabel")):
        hits = search.knn(df, asked, 5, other=True, same=same)
        got = {}
        for r in hits.collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        for i, v, label in rows:
            if i % 20 == 1:
                want = sorted((-round(cos(v, w), 6) + 0.0, j) for j, w, x in rows if j != i and (same is None or (x is not None and x == label)))[:5]
                assert [(j, s) for _, j, s in sorted(got.get(i, []))] == [(j, -s + 0.0) for s, j in want], i


def test_many_names_side_by_side_have_the_plain_ratio(monkeypatch):
    monkeypatch.setattr(names, "PAIRS", 7)
    rng = random.Random(3)
    some = ["".join(rng.choice("abcé 好") for _ in range(n)) for n in (0, 1, 5, 63, 64, 65, 127, 128, 129, 200) for _ in range(3)]
    wanted = np.random.default_rng(3).random((len(some), len(some))) < 0.7
    got = names.Coded(some).all_ratios(some, wanted)
    assert got.tolist() == [[names.indel_ratio(a, b) if wanted[i, j] else -1.0 for j, b in enumerate(some)] for i, a in enumerate(some)]
    assert names.Coded([""]).all_ratios(["", "a"], np.ones((2, 1), bool)).tolist() == [[1.0], [0.0]]
    assert names.Coded([]).all_ratios(["a"], np.ones((1, 0), bool)).shape == (1, 0)
