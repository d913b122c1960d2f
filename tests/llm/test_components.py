import random

import pytest

from feedloom.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


CHAIN = [(k, k + 1) for k in range(40)]
STAR = [(7, k) for k in range(100, 160)] + [(k, 500 + k) for k in range(100, 130)]
RANDOM = [(random.Random(k).randrange(300), random.Random(k + 1000).randrange(300)) for k in range(250)]


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(2, 1), (1, 2), (2, 1)], CHAIN, CHAIN[::-1], STAR, RANDOM])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in got} == plain(edges) and len(got) == len(plain(edges))
