import numpy as np
import pytest

from tallyforge.llm import graph


def smallest_reachable(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("kind", ["shuffled path", "star", "random"])
def test_components(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    n = 2048
    if kind == "star":
        edges = [(n, k) for k in range(n)]
    elif kind == "random":
        edges = [tuple(map(int, e)) for e in rng.integers(0, 3000, (1500, 2)) if e[0] != e[1]]
    else:
        names = rng.permutation(n)
        edges = list(zip(names[:-1].tolist(), names[1:].tolist(), strict=True))
    rounds = []
    monkeypatch.setattr(graph.itertools, "count", lambda k: (rounds.append(i) or i for i in range(k, 25)))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == smallest_reachable(edges)
    assert len(rounds) < 20


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
