"""The part graph over all orders against brute force, with order ids far apart and a hot part."""

import random
from itertools import combinations

import pytest

from knotwork.plans import queries as catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, rows = random.Random(4), set()
    for order in (1, 7, 1199, *range(1200, 1230), 40_000, 5_000_000_000):
        rows |= {(order, p) for p in [3, *rng.sample(range(30), rng.randint(0, 4))]}  # part 3 is in each order
    d = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(sorted(rows) * 2, "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    orders = {}
    for order, part in rows:
        orders.setdefault(order, set()).add(part)
    return d, {e for parts in orders.values() for e in combinations(sorted(parts), 2)}


def test_part_graph_of_all_orders(spark, tables):
    d, edges = tables
    run = lambda name: catalogue.queries()[name](spark, d).collect()
    both = edges | {(j, i) for i, j in edges}
    assert sorted((r["i"], r["j"]) for r in run("symmetrize")) == sorted(both)
    triangles = sum((a, b) in edges and (b, c) in edges and (a, c) in edges for a, b, c in combinations(range(31), 3))
    assert triangles and run("triangle_count")[0]["triangles"] == triangles

    degree = {v: sum(i == v for i, _ in edges) for v in range(max(max(e) for e in edges) + 1)}
    rank = {v: k for k, v in enumerate(sorted(degree, key=lambda v: (degree[v], v)))}
    assert sorted((r["i"], r["j"]) for r in run("permute_by_degree")) == sorted((rank[i], rank[j]) for i, j in edges)
    low = {(rank[i], rank[j]) for i, j in both if rank[i] > rank[j]}
    assert run("wedge_count")[0]["wedges"] == sum(j == j2 for _, j in low for _, j2 in low)
    hit = {(a, b) for a, b in low if any((a, k) in low and (b, k) in low for k in rank)}
    assert tuple(run("masked_edge_count")[0]) == (len(hit), len(hit), 2 * len(hit))
