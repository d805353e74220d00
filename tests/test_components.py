import random

from strataform.operators.components import components, links_by_shared_key


def test_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(70)] + [(5, 5), (3, 4), (3, 4)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.group_id for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_links(spark):
    rows = [(1, "a"), (2, "a"), (3, "a"), (3, "a"), (4, None), (5, "b"), (None, "a")]
    got = {tuple(r) for r in links_by_shared_key(spark.createDataFrame(rows, "i long, k string"), "i", "k").collect()}
    assert got == {(2, 1), (3, 1)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
