import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpalith.streaming import jobs as J
from corpalith.streaming.jobs import MINUTE, Event

ROW = "key long, at long, id long, what string, who string, body string"
HOUR = 60 * MINUTE


def leases_of(seed=1, n=400, keys=4):
    rng = random.Random(seed)
    acts = ["queue", "claim", "claim", "beat", "beat", "done", "error"]
    rows = [(rng.randrange(keys), rng.randrange(0, 200 * HOUR, 1000), i, rng.choice(acts), rng.choice(["w1", "w2"]), None) for i in range(n)]
    return rows + [(0, 5 * HOUR, 9000 + i, "claim", f"w{i}", None) for i in range(3)]


def loads_of(seed=2, n=500, keys=3):
    rng = random.Random(seed)
    kinds = ["page"] * 8 + ["failed", "failed", "cancel"]
    return [(rng.randrange(keys), rng.randrange(0, 400 * MINUTE, 1000), i, rng.choice(kinds), f"p{rng.randrange(12)}", rng.choice("ab")) for i in range(n)]


MACHINES = [(J.Leases(6 * HOUR), leases_of), (J.Loads(20 * MINUTE, 30 * MINUTE), loads_of)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("machine, made", MACHINES)
def test_a_restarted_stream_gives_the_rows_of_one_table(spark, tmp_path, machine, made):
    """Batches in order of arrival, with events late by up to the bound, and a restart in the middle."""
    J.store_settings(spark)
    late, rng = 20 * MINUTE, random.Random(3)
    rows = made()
    arrived = sorted(rows, key=lambda r: r[1] + rng.randrange(late - 1000))
    cuts = [arrived[i : i + 80] for i in range(0, len(arrived), 80)]

    def put(name, part):
        df = spark.createDataFrame(part, ROW).select("key", F.timestamp_micros("at").alias("ts"), "id", "what", "who", "body")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    def go():
        events = spark.readStream.schema("key long, ts timestamp, id long, what string, who string, body string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        out = J.over_stream(events, machine, f"{late // 1_000_000} seconds")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    for i, part in enumerate(cuts[:3]):
        put(f"f{i}", part)
    go()
    first = spark.read.parquet(str(tmp_path / "out")).count()
    for i, part in enumerate(cuts[3:], 3):
        put(f"f{i}", part)
    go()
    got = rows_of(spark.read.parquet(str(tmp_path / "out")))
    passed = max(r[1] for r in rows) // 1000 * 1000 - late
    want = rows_of(J.over_table(spark.createDataFrame(rows, ROW), machine, passed))
    assert got == want and 0 < first < len(want)


def test_no_job_has_two_owners(spark):
    """Between a grant and its end no other is given; whoever acts under a lease has it."""
    rows = leases_of(seed=5, n=3000, keys=6)
    got = defaultdict(list)
    for r in J.over_table(spark.createDataFrame(rows, ROW), J.Leases(6 * HOUR), 300 * HOUR).collect():
        got[r.key].append(r)
    ends = {"done", "retry", "failed", "lapsed"}
    seen = set()
    for mine in got.values():
        owner, until = None, 0
        for r in sorted(mine, key=lambda r: (r.at, r.id is not None, r.id or 0)):
            seen.add(r.outcome)
            assert owner is None or r.at < until or r.outcome == "lapsed"
            if r.outcome == "granted":
                assert owner is None and r.attempt <= 3
                owner, until = r.who, r.at + 6 * HOUR
            elif r.outcome == "extended":
                assert owner == r.who
                until = r.at + 6 * HOUR
            elif r.outcome in ends:
                assert owner == r.who and (r.outcome != "lapsed" or r.at == until)
                owner = None
        assert owner is None  # the last lease lapsed long before the end
    assert seen == ends | {"queued", "waiting", "granted", "refused", "extended", "lost"}


def one(machine, events, until=1 << 60):
    state, names, out = machine.start(), J._Names(), []
    for e in events:
        out += machine.until(state, e.at, names) + machine.step(state, e, names)
    return out + machine.until(state, until, names)


def test_leases_step_by_step():
    m = lambda t, i, what, who="a": Event(t * 1_000_000, i, what, who, None)
    events = [m(0, 1, "claim"), m(1, 2, "queue"), m(2, 3, "queue"), m(3, 4, "claim"), m(3, 5, "claim", "b"), m(4, 6, "error"), m(8, 7, "claim", "b"), m(9, 8, "claim", "b"), m(10, 9, "done"), m(11, 10, "beat", "b")]
    got = [(r[0], r[3], r[4]) for r in one(J.Leases(100_000_000), events)]
    assert got == [
        (1, "refused", 0), (2, "queued", 0), (3, "waiting", 0), (4, "granted", 1), (5, "refused", 1), (6, "retry", 1), (7, "refused", 1),  # five seconds have not passed
        (8, "granted", 2), (9, "lost", 2), (10, "extended", 2), (None, "lapsed", 2),
    ]


def test_loads_step_by_step():
    m = lambda t, what, page="p", body="x": Event(t * MINUTE, t, what, page, body)
    events = [m(0, "page"), m(1, "page"), m(2, "failed", "q"), m(3, "page", "q"), m(4, "failed", "r"), m(25, "page", "s"), m(40, "page", "r"), m(41, "page", "p"), m(42, "cancel"), m(43, "cancel"), m(44, "page", "t")]
    got = [(r[0] // MINUTE, *r[1:]) for r in one(J.Loads(20 * MINUTE, 30 * MINUTE), events)]
    assert got == [
        (0, 1, "running", 1, 0, 0, "p"), (2, 1, "running", 1, 1, 0, "q"), (3, 1, "running", 2, 0, 0, "q"), (4, 1, "running", 2, 1, 0, "r"), (25, 1, "running", 2, 1, 1, "s"), (30, 1, "timeout", 2, 1, 1, None),
        (40, 2, "running", 1, 0, 0, "r"), (41, 2, "running", 2, 0, 0, "p"), (42, 2, "cancelled", 2, 0, 0, "p"), (44, 3, "running", 1, 0, 0, "t"), (74, 3, "complete", 1, 0, 0, None),
    ]


def test_snapshots_only_when_they_change(spark):
    for _, mine in _by_key(J.over_table(spark.createDataFrame(loads_of(), ROW), J.Loads(20 * MINUTE, 30 * MINUTE), 1 << 60)):
        assert all(a[2:7] != b[2:7] for a, b in zip(mine, mine[1:], strict=False))
        assert all(min(r.done, r.failed, r.skipped) >= 0 for r in mine)


def _by_key(df):
    held = defaultdict(list)
    for r in df.collect():
        held[r.key].append(r)
    return [(k, sorted(rows, key=lambda r: (r.at, r.run, r.status != "running"))) for k, rows in held.items()]


def test_odd_rows(spark):
    rows = [(None, 1, 1, "claim", "w", None), (1, None, 2, "claim", "w", None), (1, 1, None, "claim", "w", None), (1, 5, 3, None, None, None), (1, 6, 4, "claim", None, None), (1, 7, 5, "queue", None, None), (1, 99, 6, "claim", "w", None)]
    got = J.over_table(spark.createDataFrame(rows, ROW), J.Leases(10), 50).collect()
    assert sorted((r.id, r.outcome) for r in got) == [(3, "lost"), (4, "refused"), (5, "queued")]
    assert J.over_table(spark.createDataFrame([], ROW), J.Leases(10), 50).count() == 0
