"""Connected components against a plain walk, over chains, stars, cliques and random graphs."""

import random

import pytest

from quillgraph.llm import common
from tests.llm.test_text_operators import components


def graphs():
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(200)]
    rng.shuffle(chain)
    star = [(500, i) for i in range(501, 560)] + [(530, 499), (540, 498)]
    clique = [(i, j) for i in range(700, 730) for j in range(700, i)]
    yield "mixed", chain + star + clique + [(9000, 9000), (-5, 3), (2**40, 7), (1, 1)]
    for size, n in ((300, 200), (300, 400), (60, 30)):
        yield f"random {size}/{n}", [(rng.randrange(size), rng.randrange(size)) for _ in range(n)]
    yield "none", []


@pytest.mark.parametrize("name,edges", list(graphs()))
def test_connected_components(spark, name, edges):
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r["node"]: r["component"] for r in common.connected_components(df).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert got == components([e for e in edges if e[0] != e[1]], nodes)


def test_a_node_is_told_by_its_own_task():
    import numpy as np

    u, v = np.array([5, 4, 3, 9, 8]), np.array([4, 3, 1, 8, 1])
    node, root = common._forest(u, v, owned=np.array([1]))
    told = dict(zip(node.tolist(), root.tolist(), strict=True))
    assert told == {5: 1, 4: 1, 9: 1}  # 3-1 and 8-1 came in and belong to the tasks of 3 and 8


def test_roots_found_by_compression_are_told(spark, monkeypatch):
    """Leaves around a centre that has a smaller root, in a task that holds too many edges to keep them as they came."""
    import pyarrow as pa

    leaves = list(range(100, 140))
    rows = [(10, 1, 10)] + [(w, 10, 10) for w in leaves]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 8], strict=True)], ["u", "v", "at"]) for i in range(0, len(rows), 8)]
    (out,) = common._told(iter(batches), 5)
    told = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert {told.get(w) for w in leaves} == {1}
    monkeypatch.setattr(common, "HELD", 5)
    edges = [e for _, g in graphs() for e in g] + [(w, 10) for w in leaves] + [(10, 1)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert got == components([e for e in edges if e[0] != e[1]], nodes)
