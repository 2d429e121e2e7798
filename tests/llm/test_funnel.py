import bisect
import datetime
import random
from collections import Counter, defaultdict

import pytest

from corpalith.llm import funnel
from corpalith.llm.funnel import MINUTE, Funnel
from corpalith.llm.queries import FUNNELS

ROW = "client_id long, kind string, arrived_at timestamp_ntz"
BEGIN = datetime.datetime(2024, 3, 30, 22, 0)


def at(microseconds):
    return BEGIN + datetime.timedelta(microseconds=microseconds)


def by_hand(rows, funnels, window=funnel.WINDOW):
    """One attempt at a time, with a search for each step."""
    times = defaultdict(list)
    for client, kind, when in {r for r in rows if None not in r}:
        times[client, kind].append(when)
    for held in times.values():
        held.sort()
    counts, took = Counter(), defaultdict(list)
    for f in funnels:
        for client in {c for c, k in times if k == f.steps[0]}:
            for first in times[client, f.steps[0]]:
                last = first
                counts[f.name, client, 1] += 1
                for step, kind in enumerate(f.steps[1:], 2):
                    later, bars = times[client, kind], times[client, f.excluded]
                    i, j = bisect.bisect_right(later, last), bisect.bisect_right(bars, last)
                    if i == len(later) or later[i] - first > datetime.timedelta(microseconds=window) or j < len(bars) and bars[j] <= later[i]:
                        break
                    counts[f.name, client, step] += 1
                    took[f.name, client, step].append((later[i] - last) // datetime.timedelta(microseconds=1))
                    last = later[i]
    deepest = {(f, c): max(s for g, d, s in counts if (g, d) == (f, c)) for f, c, _ in counts}
    depths = Counter((f, d) for (f, _), d in deepest.items())
    out = []
    for (f, c), deep in deepest.items():
        ranked = [sorted(took[f, c, s]) for s in (2, 3, 4)]
        out.append((f, c, *(counts[f, c, s] for s in (1, 2, 3, 4)), deep, *(x[(90 * len(x) + 99) // 100 - 1] if x else None for x in ranked), depths[f, deep]))
    return sorted(out)


def rows_of(df):
    names = ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def made(seed, n, span, clients):
    rng = random.Random(seed)
    kinds = ["view", "view", "view", "click", "click", "purchase", "error", "signup", "other"]
    return [(rng.choice([0, 0, 0, *range(clients)]), rng.choice(kinds), at(rng.randrange(0, span, 7_000_000))) for _ in range(n)]


@pytest.mark.parametrize("wide, narrow, dense, chunk", [(360, 10, 200_000, 1 << 18), (60, 10, 20, 50), (30, 30, 0, 1), (20, 5, 40, 64)])
def test_as_by_hand(spark, wide, narrow, dense, chunk):
    rows = made(1, 1500, 900 * MINUTE, 12)
    rows += rows[:50] + [(None, "view", at(0)), (1, None, at(0)), (1, "view", None)]
    df = spark.createDataFrame(rows, ROW)
    got = funnel.count_funnels(df, FUNNELS, wide=wide * MINUTE, narrow=narrow * MINUTE, dense=dense, chunk=chunk)
    assert rows_of(got) == by_hand(rows, FUNNELS)


def test_bounds_are_strict(spark):
    """Rows at the same time never follow each other; a bar counts up to the next step, the window up to its end."""
    steps = Funnel("F", ("a", "b", "a", "b"), "x")
    half = 30 * MINUTE
    rows = [
        (1, "a", at(0)), (1, "b", at(0)), (1, "b", at(half)),  # the window's end counts
        (2, "a", at(0)), (2, "b", at(half + 1)),  # too late
        (3, "a", at(0)), (3, "x", at(0)), (3, "b", at(5)),  # a bar at the step itself is no bar
        (4, "a", at(0)), (4, "x", at(5)), (4, "b", at(5)),  # one at the next step is
        (5, "a", at(0)), (5, "b", at(1)), (5, "a", at(1)), (5, "a", at(2)), (5, "b", at(3)),
    ]
    got = rows_of(funnel.count_funnels(spark.createDataFrame(rows, ROW), [steps], wide=half))
    assert [(r[1], r[2:6]) for r in got] == [(1, (1, 1, 0, 0)), (2, (1, 0, 0, 0)), (3, (1, 1, 0, 0)), (4, (1, 0, 0, 0)), (5, (3, 3, 1, 1))]
    assert got == by_hand(rows, [steps])


def test_one_client_with_very_many_rows(spark):
    """A third of all rows at one client and one row repeated very often, in ranges that are cut."""
    rows = made(2, 4000, 120 * MINUTE, 40) + [(0, "view", at(7_000_000))] * 2000
    got = funnel.count_funnels(spark.createDataFrame(rows, ROW), FUNNELS, wide=60 * MINUTE, dense=100)
    assert rows_of(got) == by_hand(rows, FUNNELS)


def test_text_clients_other_columns_and_zones(spark):
    rows = [(f"c{c}", k, t, 1, "x") for c, k, t in made(3, 400, 300 * MINUTE, 5)]
    df = spark.createDataFrame(rows, "client_id string, kind string, arrived_at timestamp_ntz, start long, code string")
    plain = rows_of(funnel.count_funnels(df, FUNNELS))
    assert plain == by_hand([r[:3] for r in rows], FUNNELS)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # an hour of this night is left out there
        assert rows_of(funnel.count_funnels(df, FUNNELS)) == plain
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_none(spark):
    empty = spark.createDataFrame([], ROW)
    assert funnel.count_funnels(empty, FUNNELS).count() == 0
    assert funnel.count_funnels(spark.createDataFrame([(1, "error", at(0))], ROW), FUNNELS).count() == 0
    with pytest.raises(ValueError):
        funnel.count_funnels(empty, [Funnel("a", ("x",), "y"), Funnel("b", ("x", "z"), "y")])
