import numpy as np
import pytest

from shelfspark.llm.common import column, connected_components, fresh, local_components, lower_az


def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


CHAIN = [(i, i + 1) for i in range(60)]
HUB = [(1000, i) for i in range(1001, 1400)] + [(1399, 2000), (2000, -5)]
RANDOM = [tuple(x) for x in np.random.default_rng(1).integers(-300, 300, (250, 2)).tolist()]


@pytest.mark.parametrize("links", [CHAIN, HUB, RANDOM, CHAIN + HUB + RANDOM, [(3, 3)], []])
def test_components(spark, links):
    want = {x: r for x, r in roots(links).items() if any(x in p and p[0] != p[1] for p in links)}
    got = connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    if links:
        a, b = (np.array(x) for x in zip(*links))
        assert dict(zip(*(x.tolist() for x in local_components(a, b)))) == roots(links)


def test_names_and_case(spark):
    df = spark.createDataFrame([("ÀB", 1)], "`a.b` string, Llm_X int")
    assert fresh(df, "llm_x", "y") == ["_llm_x", "y"]
    assert df.select(lower_az(column(df, "a.b"))).first()[0] == "Àb"
