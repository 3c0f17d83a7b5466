import random

from campusledger.llm.components import components


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_chain_star_random(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)]
    edges += [(r.randint(300, 400), r.randint(300, 400)) for _ in range(80)] + [(7, 7), (150, 151)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}


def test_nulls_and_empty(spark):
    e = spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a long, b long")
    assert components(e).collect() == []
