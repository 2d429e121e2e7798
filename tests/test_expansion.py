import random

from corpalith.operators import expansion

LINK, SEED = "u string, v string, weight double", "node string, score double"


def by_hand(links, seeds, hops, floor):
    """All walks, one by one."""
    best = {}
    walks = [(n, round(s, 6), 0) for n, s in seeds if n is not None and s is not None and s >= floor]
    while walks:
        node, score, hop = walks.pop()
        if (score, -hop) > best.get(node, (-1, 0)):
            best[node] = (score, -hop)
        for u, v, w in links:
            if u == node and v is not None and w is not None and w <= 1 and hop < hops and round(score * w, 6) >= floor:
                walks.append((v, round(score * w, 6), hop + 1))
    return sorted((n, s, -h) for n, (s, h) in best.items())


def test_as_all_walks(spark):
    """A small graph with rings, links back, ties, dead ends, and two seeds that meet."""
    links = [("a", "b", 0.5), ("b", "c", 0.5), ("c", "a", 1.0), ("a", "d", 0.25), ("d", "e", 1.0), ("b", "e", 0.5), ("e", "e", 1.0), ("x", "c", 0.9), ("c", "y", 0.1), ("y", "z", 1.0), ("q", "r", 1.0)]
    odd = [(None, "b", 1.0), ("a", None, 1.0), ("a", "n", None), ("a", "m", 1.5), ("a", "b", 0.4)]
    seeds = [("a", 1.0), ("x", 0.5), ("a", 0.3), (None, 1.0), ("w", None), ("alone", 0.9)]
    for hops, floor in ((0, 0.0), (1, 0.0), (3, 0.0), (4, 0.1), (6, 0.0)):
        got = expansion.expanded(spark.createDataFrame(links + odd, LINK), spark.createDataFrame(seeds, SEED), hops, floor).collect()
        assert sorted(map(tuple, got)) == by_hand(links + odd, seeds, hops, floor)


def test_many_links_of_one_node_and_none(spark):
    rng = random.Random(2)
    links = [("hub", f"n{i}", 0.5) for i in range(500)] + [(f"n{i}", "hub", round(rng.random(), 3)) for i in range(500)]
    got = expansion.expanded(spark.createDataFrame(links, LINK), spark.createDataFrame([("n7", 1.0)], SEED), 2).collect()
    assert len(got) == 501
    assert expansion.expanded(spark.createDataFrame([], LINK), spark.createDataFrame([("a", 1.0)], SEED), 3).count() == 1
    assert expansion.expanded(spark.createDataFrame(links, LINK), spark.createDataFrame([], SEED), 3).count() == 0
