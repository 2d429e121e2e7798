import random

from corpalith.operators import order

ROW = "g string, o long, v string"


def test_numbers_and_predecessors(spark):
    """Against sorting by hand, with a group of most rows, a null group and null values."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "a", "b", "c", None]), i, rng.choice(["x", "y", None])) for i in rng.sample(range(10_000), 3000)]
    want = {}
    for g in {r[0] for r in rows}:
        before = None
        for nth, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            want[o] = (g, v, nth, before)
            before = v
    got = order.numbered(spark.createDataFrame(rows, ROW).repartition(7), "g", ["o"], before="v").collect()
    assert {r.o: (r.g, r.v, r.nth, r.before) for r in got} == want and len(got) == len(rows)
    plain = order.numbered(spark.createDataFrame(rows, ROW), "g", ["o"])
    assert plain.columns == ["g", "o", "v", "nth"] and {r.o: r.nth for r in plain.collect()} == {o: x[2] for o, x in want.items()}
    assert order.numbered(spark.createDataFrame([], ROW), "g", ["o"], before="v").count() == 0
