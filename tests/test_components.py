import random

import curata.operators.components as components


def roots_of(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_star_components_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_LINKS", 40)
    rnd = random.Random(5)
    chain = [(i, i + 1) for i in range(150)]
    loose = [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)]
    hub = [(2000, 2001 + i) for i in range(120)]
    for links in (chain, loose, hub, [(5, 5)], []):
        rnd.shuffle(links)
        frame = spark.createDataFrame(links, "a long, b long").repartition(6)
        got = {r.node: r.root for r in components.star_components(frame, "a", "b").collect()}
        assert got == roots_of(links)


def test_rows_linked_by_keys(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, "u", "t"), (3, None, "t"), (4, None, None)], "id long, a string, b string")
    got = {r.id: r.component for r in components.connected_components(rows, "id", ["a", "b"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
