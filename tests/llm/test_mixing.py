import random
from collections import Counter

import pytest

from corpalith.llm import mixing


def brute_targets(sizes, weights, share=1.5, most=2.0):
    target, free, rest = {}, set(sizes), share * sum(sizes.values())
    while free:
        level = rest / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else level * weights[s]
        rest -= sum(target[s] for s in over)
        free -= over or free
    return target


def test_targets_taken_and_reruns(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 900))), rng.choice(["b", "a", "é", "Z", None, "b", "b"])) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, shard=5_000).collect()
    order = sorted({s for _, _, s in docs if s is not None}) + [None]
    sizes = {s: sum(len(t.split()) for _, t, x in docs if x == s) for s in order}
    want = brute_targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in order:
        assert taken[s] == pytest.approx(want[s], rel=0.01, abs=60)
    again = mixing.mix(df.repartition(7), shard=5_000).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_sainte_lague_matches_highest_quotients(spark):
    rng = random.Random(5)
    for _ in range(4):
        votes = [rng.randint(0, 1000) for _ in range(9)]
        n = rng.randint(0, 60)
        quotients = sorted(((-v / (2 * s + 1), i, s) for i, v in enumerate(votes) if v for s in range(n)))[:n]
        want = Counter(i for _, i, _ in quotients)
        claims = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "k int, v double")
        got = mixing.sainte_lague(claims, [], ["k"], "v", mixing.F.lit(n)).collect()
        assert {r.k: r.quota for r in got} == {i: want[i] for i in range(9)}


def test_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0) and all(r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix(empty).collect()} == {0}


def test_quotas_by_steps(spark):
    """With groups of shards: the seats are all dealt, each step by the highest quotients, and few shards match one step."""
    rng = random.Random(8)
    votes = [rng.choice((0, rng.randint(1, 500))) for _ in range(23)]

    def highest(votes, seats):
        best = sorted(((-v / (2 * s + 1), i, s) for i, v in enumerate(votes) if v for s in range(seats)))[:seats]
        won = Counter(i for _, i, _ in best)
        return [won[i] for i in range(len(votes))]

    def steps(votes, seats, width, fan):
        if width == 1:
            return highest(votes, seats)
        parts = [votes[i : i + width] for i in range(0, len(votes), width)]
        return [q for part, n in zip(parts, highest([sum(x) for x in parts], seats), strict=True) for q in steps(part, n, width // fan, fan)]

    held = spark.createDataFrame([(7, i, 90, v) for i, v in enumerate(votes)], "nth int, shard_no long, seats long, held long")
    for fan, width in ((64, 1), (5, 5), (3, 9)):
        got = {r.shard_no: r.quota for r in mixing.shard_quotas(held, len(votes), fan).collect()}
        assert [got[i] for i in range(23)] == steps(votes, 90, width, fan)


def test_repeated_rows_are_taken_one_by_one(spark):
    """The mix of equal rows is that of the line of all their words; a thousand rows without an id are one group."""
    docs = [(None, "a b c", "s")] * 1000 + [(1, "d e f g", "s")] * 3 + [(2, "x", "t")]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert Counter((r.doc_id, r.times) for r in rows) == {(None, 1000): 1000, (1, 3): 3, (2, 1): 1}
    assert all(r.taken <= 2 * r.size for r in rows)
    want = brute_targets({"s": 3012, "t": 1}, {"s": 3, "t": 1})
    assert sum(r.taken for r in rows if r.source == "s") == pytest.approx(want["s"], abs=17)
