import random

from tablecraft.llm.components import components


def brute(links):
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {x: find(x) for x in low}


def test_chains_stars_and_random_links(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    rng = random.Random(3)
    loose = [(200 + rng.randrange(150), 200 + rng.randrange(150)) for _ in range(90)]
    links = chain + star + loose + [(5, 5), (1, 0)]
    df = spark.createDataFrame([*links, (None, 3), (900, None)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(df).collect()}
    expected = brute([(a, b) for a, b in links if a != b])
    assert found == expected


def test_no_links(spark):
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0
