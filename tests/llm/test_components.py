from lociflow.llm.components import connected_components

from .helpers import components, rng, rows_of


def test_components_match_union_find(spark):
    r = rng(1)
    path = [(i, i + 1) for i in range(1000, 1300)]
    star = [(5000, i) for i in range(5001, 5400)]
    some = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))]
    links = [*path, *star, *some, (7, 7)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = rows_of(connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")), "node")
    assert {r_["node"]: r_["component"] for r_ in got} == components(nodes, [x for x in links if x[0] != x[1]]) and len(got) == len(nodes)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
