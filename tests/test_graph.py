import random

from cohortvox.operators.graph import components
from cohortvox.sources.workspace import Workspace


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {x: find(x) for x in up}


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (None, 4), (2, 1), (1, 2), (2, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = components(df, "a", "b", Workspace(spark, "t")).collect()
    assert {r.node: r.component for r in got} == brute(edges)
    assert len(got) == len({r.node for r in got})


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert components(df, "a", "b", Workspace(spark, "t")).count() == 0
