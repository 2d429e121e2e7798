"""Ordered funnels with exclusions, counted by strict ASOF joins per client and time range.

A client's rows are cut into ranges of time. A range gets its own rows and a halo: the rows of one
window beyond its end, which is as far as an attempt that starts in it can go. Inside a task DuckDB
follows all attempts at once, one strict ASOF join for each next step and one for each exclusion.
Spark merges what the ranges give, and ranks the times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpalith.llm.common import hot_join, small, stored

MINUTE = 60_000_000
#: Microseconds after the first step within which a step counts.
WINDOW = 30 * MINUTE
#: Microseconds of a range, and of a range of a dense stretch of one client.
WIDE, NARROW = 360 * MINUTE, 10 * MINUTE
#: Rows of a client in one range from which the range is cut into narrow ones.
DENSE = 200_000
#: Rows that a task hands to DuckDB at a time, whole ranges at least.
CHUNK = 1 << 18
#: Times are ranked in two steps: by their upper bits, then by these lower ones.
LOW_BITS = 16


class Funnel(NamedTuple):
    """Kinds that must follow each other, and the kind that must not come between two of them."""

    name: str
    steps: tuple[str, ...]
    excluded: str


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone; exact, and the same in every session time zone."""
    day = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return ((day * 24 + F.hour(at)) * 60 + F.minute(at)) * MINUTE + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def _floor(t: Column, width: int) -> Column:
    return t - F.pmod(t, F.lit(width))


def _dense(rows: DataFrame, wide: int, dense: int) -> DataFrame | None:
    """(d_client, d_start) of the ranges of over ``dense`` rows, marked for broadcast if small; None if there are none.

    Only clients that have so many rows at all are counted range by range.
    """
    hot = stored(rows.groupBy(F.col("client").alias("h")).count().where(F.col("count") > dense).select("h"))
    n = hot.count()
    if not n:
        return None
    theirs = rows.join(small(hot, n), F.col("client") == F.col("h"), "left_semi")
    ranges = theirs.groupBy(F.col("client").alias("d_client"), _floor(F.col("t"), wide).alias("d_start")).count()
    ranges = stored(ranges.where(F.col("count") > dense).select("d_client", "d_start"))
    n = ranges.count()
    return small(ranges, n) if n else None


def _dealt(rows: DataFrame, window: int, wide: int, narrow: int, dense: int) -> DataFrame:
    """``rows(client, code, t)`` once for each range that needs them, with the range's (start, until)."""
    t = F.col("t")
    starts = F.array_distinct(F.array(_floor(t, wide), _floor(t - window, wide))) if wide >= window else F.sequence(_floor(t - window, wide), _floor(t, wide), F.lit(wide))
    dealt = rows.withColumn("start", F.explode(starts))
    ranges = _dense(rows, wide, dense)
    if ranges is None:
        return dealt.withColumn("until", F.col("start") + wide)
    marked = hot_join(dealt, ranges, [("client", "d_client"), ("start", "d_start")], "left")
    first = F.greatest(F.col("start"), _floor(t - window, narrow))
    last = F.least(F.col("start") + wide - narrow, _floor(t, narrow))
    inner = F.when(first <= last, F.sequence(first, last, F.lit(narrow))).otherwise(F.array().cast("array<bigint>"))
    cut = marked.where("d_start is not null").select("client", "code", "t", F.explode(inner).alias("start"))
    whole = marked.where("d_start is null").select("client", "code", "t", "start")
    return whole.withColumn("until", F.col("start") + wide).union(cut.withColumn("until", F.col("start") + narrow))


def _attempts_sql(number: int, codes: Sequence[int], excluded: int, window: int) -> str:
    """SQL over ``chunk`` for one funnel: (funnel, client, step, took, n), where took is -1 for first steps."""
    parts = [f"s1 AS (SELECT client, start, t AS first, t AS last, -1 AS took FROM chunk WHERE code = {codes[0]} AND t < until)"]
    parts.append(f"x AS (SELECT client, start, t FROM chunk WHERE code = {excluded})")
    for k, code in enumerate(codes[1:], 2):
        parts.append(f"k{k} AS (SELECT client, start, t FROM chunk WHERE code = {code})")
        parts.append(
            f"s{k} AS (SELECT a.client, a.start, a.first, n.t AS last, n.t - a.last AS took FROM s{k - 1} a "
            f"ASOF JOIN k{k} n ON a.client = n.client AND a.start = n.start AND a.last < n.t "
            f"ASOF LEFT JOIN x ON a.client = x.client AND a.start = x.start AND a.last < x.t "
            f"WHERE n.t <= a.first + {window} AND (x.t IS NULL OR x.t > n.t))"
        )
    steps = " UNION ALL ".join(f"SELECT client, {k} AS step, took FROM s{k}" for k in range(1, len(codes) + 1))
    return f"WITH {', '.join(parts)} SELECT CAST({number} AS INTEGER) AS funnel, client, CAST(step AS INTEGER) AS step, CAST(took AS BIGINT) AS took, count(*) AS n FROM ({steps}) GROUP BY ALL"


def _whole_ranges(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.Table]:
    """Tables of about ``chunk`` sorted rows that end where a range ends; only a longer range makes a longer one."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < chunk:
            continue
        table = pa.Table.from_batches(held)
        changes = [pc.not_equal(table[c].slice(1), table[c].slice(0, rows - 1)) for c in ("client", "start")]
        ends = pc.indices_nonzero(pc.or_(*changes))
        if len(ends):
            cut = ends[-1].as_py() + 1
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def follow(dealt: DataFrame, funnels: Sequence[Funnel], kinds: Sequence[str], window: int, chunk: int) -> DataFrame:
    """(funnel, client, step, took, n): how many attempts reached a step after so many microseconds."""
    sqls = [_attempts_sql(i, [kinds.index(s) for s in f.steps], kinds.index(f.excluded), window) for i, f in enumerate(funnels)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Bounded rows at a time and no folder to spill to: nothing is written outside Spark.
        with duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""}) as con:
            for table in _whole_ranges(batches, chunk):
                con.register("chunk", table)
                for sql in sqls:
                    yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("chunk")

    kind = dealt.schema["client"].dataType.simpleString()
    together = dealt.repartition("client", "start").sortWithinPartitions("client", "start")
    return together.mapInArrow(run, f"funnel int, client {kind}, step int, took long, n long")


def _ranked(times: DataFrame, percent: int) -> DataFrame:
    """(f, c, s, took): the ceil(percent * n / 100)-th smallest time of each funnel, client and step.

    The upper bits of a time are ranked first, then the lower bits of the chosen ones: both are
    windows of a bounded number of values, however many attempts a client has.
    """
    keys = ["funnel", "client", "step"]
    total = F.sum("n").over(Window.partitionBy(*keys))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("high")) - F.col("n")
    high = F.shiftright("took", LOW_BITS).alias("high")
    bins = times.groupBy(*keys, high).agg(F.sum("n").alias("n")).withColumns({"total": total, "before": before})
    rank = F.expr(f"(total * {percent} + 99) div 100") - F.col("before")
    chosen = bins.withColumn("rank", rank).where((F.col("rank") > 0) & (F.col("rank") <= F.col("n")))
    chosen = chosen.select(F.col("funnel").alias("f"), F.col("client").alias("c"), F.col("step").alias("s"), F.col("high").alias("h"), "rank")
    inside = hot_join(times.withColumn("high", high), chosen, [("funnel", "f"), ("client", "c"), ("step", "s"), ("high", "h")])
    upto = F.sum("n").over(Window.partitionBy("f", "c", "s").orderBy("took"))
    found = inside.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return found.select("f", "c", "s", F.col("took").alias("time"))


def count_funnels(
    events: DataFrame, funnels: Sequence[Funnel], window: int = WINDOW, percent: int = 90, wide: int = WIDE, narrow: int = NARROW, dense: int = DENSE, chunk: int = CHUNK
) -> DataFrame:
    """One row for each funnel and client with attempts: how many attempts reach each step, and how fast.

    ``events(client_id, kind, arrived_at)``; other columns are ignored, rows with a null in one of
    the three too, and repeated rows are one. Each row of a funnel's first kind starts an attempt.
    Its next step is the client's earliest row of the next kind that is later than the previous
    step; it is reached unless it is over ``window`` microseconds after the first, or a row of the
    excluded kind lies after the previous step and not after the next. Rows at the same time never
    follow each other.

    Returns funnel, client_id, n1 to nK, deepest (the last step that any attempt reached), t2 to tK
    (the ceil(percent * n / 100)-th smallest time from the previous step; null where no attempt
    reached it) and same_depth (clients of the same funnel and deepest). All funnels have K steps.
    An empty table gives none.

    Tasks hold a client's rows of one range and one window, and ranges of over ``dense`` rows are
    cut into narrow ones. The times of a funnel and step are ranked by value, so a client with very
    many attempts makes no large group.
    """
    if len({len(f.steps) for f in funnels}) != 1:
        raise ValueError("all funnels must have the same number of steps")
    kinds = sorted({k for f in funnels for k in (*f.steps, f.excluded)})
    code = (F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1).cast("int")
    rows = events.where(F.col("kind").isin(kinds) & F.col("client_id").isNotNull() & F.col("arrived_at").isNotNull())
    rows = stored(rows.select(F.col("client_id").alias("client"), code.alias("code"), micros(F.col("arrived_at")).alias("t")).distinct())

    met = follow(_dealt(rows, window, wide, narrow, dense), funnels, kinds, window, chunk)
    met = stored(met.groupBy("funnel", "client", "step", "took").agg(F.sum("n").alias("n")))
    steps = range(1, len(funnels[0].steps) + 1)
    counts = met.groupBy("funnel", "client").agg(*(F.sum(F.when(F.col("step") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in steps), F.max("step").alias("deepest"))
    times = _ranked(met.where("step > 1"), percent).groupBy(F.col("f").alias("tf"), F.col("c").alias("tc")).agg(*(F.max(F.when(F.col("s") == k, F.col("time"))).alias(f"t{k}") for k in steps[1:]))
    found = counts.join(times, (F.col("funnel") == F.col("tf")) & (F.col("client") == F.col("tc")), "left")
    # One row for each funnel and step at most.
    depths = counts.groupBy(F.col("funnel").alias("df"), F.col("deepest").alias("dd")).agg(F.count("*").alias("same_depth"))
    found = found.join(F.broadcast(depths), (F.col("funnel") == F.col("df")) & (F.col("deepest") == F.col("dd")))
    name = F.element_at(F.array(*(F.lit(f.name) for f in funnels)), F.col("funnel") + 1).alias("funnel")
    return found.select(name, F.col("client").alias("client_id"), *(f"n{k}" for k in steps), "deepest", *(f"t{k}" for k in steps[1:]), "same_depth")
