import random

from postrider.operators.graph import components


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
