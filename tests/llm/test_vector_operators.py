"""Vector operators against brute force."""

import numpy as np
import pytest

from quillgraph.llm import cover_tree, projections
from tests.llm.test_text_operators import components


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for label in range(3):
        centers = rng.standard_normal((12, 16))
        for i in range(90):
            v = centers[i % 12] + rng.standard_normal(16) * (0.02 if i % 3 else 0.5)
            out.append((len(out), v.astype(np.float32).tolist(), label, "x"))
    same = rng.standard_normal(16).astype(np.float32).tolist()
    out += [(len(out) + i, same, 1, "x") for i in range(40)]
    n = len(out)
    out += [(n, None, 1, "x"), (n + 1, [0.0] * 16, 1, "x"), (n + 2, [1.0, None] + [0.0] * 14, 1, "x"), (n + 3, [float("nan")] * 16, 1, "x")]
    out += [(n + 4, same, None, "x"), (n + 5, [], 1, "x"), (n + 6, [float("inf")] + [0.0] * 15, 0, "x")]
    return out


def usable(rows):
    return [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]


@pytest.mark.parametrize("block", [10, 2048])
def test_near_duplicates(spark, rows, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    ok = [r for r in usable(rows) if r[2] is not None]
    x = np.array([r[1] for r in ok], np.float64)
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    links = [(ok[i][0], ok[j][0]) for i in range(len(ok)) for j in range(i) if ok[i][2] == ok[j][2] and cos[i, j] >= 0.93]
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    comp = components(links, [r[0] for r in rows])
    got = cover_tree.near_duplicates(frame(spark, rows).repartition(3)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (count[i], comp[i], comp[i] == i) for i in count}
    assert links


def test_dual_traversal_finds_all_pairs_between_two_trees():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((120, 8))
    x = np.concatenate([x, x + rng.standard_normal(x.shape) * 0.1])
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = x[::2], x[1::2]
    counts, _ = cover_tree.meet(cover_tree.CoverTree(a), cover_tree.CoverTree(b), 0.9)
    close = a @ b.T >= 0.9
    assert counts.tolist() == close.sum(axis=1).tolist() + close.sum(axis=0).tolist()


def test_nearest_recall_scores_and_ties(spark, rows, monkeypatch):
    monkeypatch.setattr(projections, "LEAF", 40)  # several leaves
    got = projections.nearest(frame(spark, rows), "vec_id % 5 = 0", 10).collect()
    ok = usable(rows)
    ids, x = np.array([r[0] for r in ok]), np.array([r[1] for r in ok], np.float64)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q in np.flatnonzero(ids % 5 == 0):
        s = np.array([sum(float(a) * float(b) for a, b in zip(x[q], y, strict=True)) for y in x])
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        mine = found[int(ids[q])]
        assert sorted(mine) == list(range(1, 11)) and int(ids[q]) not in [v for v, _ in mine.values()]
        keys = [(-mine[k][1], mine[k][0]) for k in sorted(mine)]
        assert keys == sorted(keys)
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(abs(sc - s[at[v]]) < 1e-9 for v, sc in mine.values())
        hit += len({v for v, _ in mine.values()} & {int(ids[i]) for i in order})
        total += 10
    assert hit / total >= 0.9


def test_few_candidates_and_unequal_lengths(spark):
    rows = [(0, [1.0, 0.0], 0, ""), (5, [0.5, 0.5], 0, ""), (7, [2.0, 1.0], 0, ""), (9, [1.0, 2.0, 3.0], 0, "")]
    got = projections.nearest(frame(spark, rows), "vec_id % 5 = 0", 20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 7, 2.0), (0, 2, 5, 0.5), (5, 1, 7, 1.5), (5, 2, 0, 0.5)]
    assert {r["vec_id"] for r in cover_tree.near_duplicates(frame(spark, rows)).collect()} == {0, 5, 7, 9}


def test_chi_square():
    assert abs(projections.chi_square_quantile(0.95, 6) - 12.5916) < 1e-3
    assert abs(projections.chi_square_cdf(8.0, 8) - 0.56653) < 1e-4


def test_empty(spark):
    none = frame(spark, [])
    assert cover_tree.near_duplicates(none).count() == 0
    assert projections.nearest(none).count() == 0


def test_levels_halve_and_cover():
    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((30, 6)), 20, axis=0) + rng.standard_normal((600, 6)) * 0.001
    x = np.concatenate([x, np.repeat(x[:1], 50, axis=0)])  # and copies
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = cover_tree.CoverTree(x)
    assert len(tree.levels) > 3
    for above, level in zip([None, *tree.levels], tree.levels, strict=False):
        far = np.linalg.norm(x - x[level["center"][level["of"]]], axis=1)
        assert (far <= level["radius"][level["of"]] + 1e-7).all()
        assert sorted(level["order"].tolist()) == list(range(len(x)))
        if above is not None:
            assert (level["parent"][level["of"]] == above["of"]).all() and set(above["center"].tolist()) <= set(level["center"].tolist())
    wide = np.diff(tree.levels[-1]["start"]) > cover_tree.FEW
    assert (tree.levels[-1]["radius"][wide] <= 1e-5).all()


def test_weights_count_copies():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((80, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    w = rng.integers(1, 9, 80)
    counts, _ = cover_tree.meet(cover_tree.CoverTree(x), None, 0.8, w)
    close = (x @ x.T >= 0.8) & ~np.eye(80, dtype=bool)
    assert counts.tolist() == (close @ w).tolist()


def test_repeated_and_null_ids(spark):
    v, far = [1.0, 0.0], [0.0, 1.0]
    rows = [(3, v, 0, ""), (3, v, 0, ""), (3, far, 0, ""), (8, far, 0, ""), (9, [-0.0, 1.0], 0, ""), (None, v, 0, ""), (1, v, 1, "")]
    got = cover_tree.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), str(r["kept"])) for r in got) == sorted(
        [("3", 1, "3", "True")] * 2 + [("3", 2, "3", "True"), ("8", 2, "3", "False"), ("9", 2, "3", "False"), ("None", 0, "None", "None"), ("1", 0, "1", "True")]
    )
    found = projections.nearest(frame(spark, rows), "vec_id = 8", 3).collect()
    assert {r["vec_id"] for r in found} >= {3, 9} and all(r["query_id"] == 8 for r in found)


def test_equal_scores_across_leaves_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(projections, "LEAF", 8)
    rng = np.random.default_rng(13)
    rows = [(i, ([1.0, 0.0, 0.0] if i % 4 == 0 else rng.standard_normal(3).astype(np.float32).tolist()), 0, "") for i in range(80)]
    got = projections.nearest(frame(spark, rows), "vec_id = 40", 5, sure=0.999999).orderBy("rank").collect()
    x = {i: r[1] for i, r in enumerate(rows)}
    want = sorted(((-x[i][0], i) for i in x if i != 40))[:5]
    assert [r["vec_id"] for r in got] == [i for _, i in want]
