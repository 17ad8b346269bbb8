"""Implementation edges: odd rows, pairs that meet more than once, cells of frequent names."""

import random

import pytest

from symlattice.operators import graph

SCHEMA = "dir string, type string, name string, n_params int, n_results int, method_id long, site string"


def rows(r, n):
    pick = lambda *x: r.choice(x)
    return [(pick("a", "b", None), pick("S", "T", "U", None), pick("f", "g", None), r.randrange(2), pick(1, None, 1), pick(*range(30), None), pick("x:1", "x:2", "y:3", None)) for _ in range(n)]


def expected(left, right):
    """(from_id, to_id) with the least site of all that meet."""
    out = {}
    for a in left:
        for b in right:
            if (a[0], *a[2:5]) == (b[0], *b[2:5]) and None not in (a[0], a[1], b[1], *a[2:5]) and a[1] != b[1]:
                out.setdefault((a[5], b[5]), []).append(a[6])
    return {k: min((s for s in v if s is not None), default=None) for k, v in out.items()}


@pytest.mark.parametrize("cell", [graph.CELL, 3])
def test_edges_have_the_least_site(spark, monkeypatch, cell):
    monkeypatch.setattr(graph, "CELL", cell)
    r = random.Random(cell)
    left, right = rows(r, 400), rows(r, 400)
    found = graph.implementation_edges(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    want = expected(left, right)
    assert len(found) == len(want) > 100 and {(x.from_id, x.to_id): x.site for x in found} == want


def test_one_name_has_many_tasks(spark, monkeypatch):
    """All methods have one name: its pairs are dealt into cells, each of them once."""
    monkeypatch.setattr(graph, "CELL", 50)
    m = spark.range(600).selectExpr("'d' as dir", "cast(id % 3 as string) as type", "'f' as name", "1 as n_params", "1 as n_results", "id as method_id", "'x:1' as site")
    pairs = graph.implementation_edges(m, m)
    assert pairs.count() == pairs.select("from_id", "to_id").distinct().count() == 600 * 400
    sizes = [n for n in pairs.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert max(sizes) < 600 * 400 / 2
