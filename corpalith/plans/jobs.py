"""Queries of jobs as state: leases over events, loads over clicks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpalith.plans.queries import query
from corpalith.sources.corpus import table
from corpalith.streaming import jobs as J

#: Until when jobs are followed, and for how long a lease holds.
UNTIL, LEASE = "2024-01-30 00:00:00", 12 * 60 * J.MINUTE
_HORIZON = int(datetime.fromisoformat(UNTIL).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
#: What the kinds of the events stand for; the worker is the third of the range that the event's number ``k`` falls into.
ACTS = {"signup": "queue", "view": "claim", "click": "beat", "purchase": "done", "error": "error"}


def micros(at):
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.unix_micros(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()))


def job_events(events: DataFrame) -> DataFrame:
    """(key, ts, at, id, what, who, body) of the events: a user's job, what happens to it, and the worker."""
    what = F.create_map(*(F.lit(x) for pair in ACTS.items() for x in pair))[F.col("event_type")]
    worker = F.concat(F.lit("w"), F.floor(F.get_json_object("props", "$.k").cast("int") / 34).cast("string"))
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("at"), F.col("event_id").alias("id"), what.alias("what"), worker.alias("who"), F.lit(None).cast("string").alias("body"))


@query(f"""WITH RECURSIVE acts AS (
  SELECT user_id AS job_id, event_id, epoch_us(ts) AS t, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTS.items())} END AS what,
    'w' || (CAST(json_extract_string(props, '$.k') AS INTEGER) // 34) AS who FROM events WHERE user_id IS NOT NULL AND ts < TIMESTAMP '{UNTIL}'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, event_id) AS nth FROM acts),
walk AS (
  SELECT DISTINCT job_id, 0::BIGINT AS nth, NULL::BIGINT AS event_id, NULL::BIGINT AS t, NULL::VARCHAR AS who, NULL::VARCHAR AS outcome, 'none' AS status, NULL::VARCHAR AS owner,
    0::BIGINT AS until, 0 AS attempt, 0::BIGINT AS ready, NULL::BIGINT AS lapsed_at, NULL::VARCHAR AS lapsed_by, NULL::INTEGER AS lapsed_try FROM ordered
  UNION ALL
  SELECT job_id, nth, event_id, t, who, outcome,
    CASE outcome WHEN 'queued' THEN 'queued' WHEN 'granted' THEN 'running' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' WHEN 'retry' THEN 'retry' ELSE status END,
    CASE outcome WHEN 'granted' THEN who ELSE owner END, CASE WHEN outcome IN ('granted', 'extended') THEN t + {LEASE} ELSE until END,
    CASE outcome WHEN 'queued' THEN 0 WHEN 'granted' THEN attempt + 1 ELSE attempt END,
    CASE outcome WHEN 'queued' THEN t WHEN 'retry' THEN t + 1000000 * CAST(least(300, 5 * pow(2, attempt - 1)) AS BIGINT) ELSE ready END,
    CASE WHEN lapsed THEN until END, CASE WHEN lapsed THEN owner END, CASE WHEN lapsed THEN attempt END
  FROM (
    SELECT *, CASE what WHEN 'queue' THEN CASE WHEN status IN ('none', 'done', 'failed') THEN 'queued' ELSE 'waiting' END
      WHEN 'claim' THEN CASE WHEN who IS NOT NULL AND status IN ('queued', 'retry') AND ready <= t THEN 'granted' ELSE 'refused' END
      ELSE CASE WHEN status <> 'running' OR owner IS DISTINCT FROM who THEN 'lost' WHEN what = 'beat' THEN 'extended' WHEN what = 'done' THEN 'done'
        WHEN what = 'error' THEN CASE WHEN attempt < 3 THEN 'retry' ELSE 'failed' END ELSE 'unknown' END END AS outcome
    FROM (
      SELECT o.job_id, o.nth, o.event_id, o.t, o.what, o.who, w.owner, w.until, w.attempt, w.status = 'running' AND w.until <= o.t AS lapsed,
        CASE WHEN w.status = 'running' AND w.until <= o.t THEN CASE WHEN w.attempt < 3 THEN 'retry' ELSE 'failed' END ELSE w.status END AS status,
        CASE WHEN w.status = 'running' AND w.until <= o.t THEN w.until ELSE w.ready END AS ready
      FROM walk w JOIN ordered o ON o.job_id = w.job_id AND o.nth = w.nth + 1))),
ends AS (SELECT job_id, arg_max(status, nth) AS status, arg_max(until, nth) AS until, arg_max(owner, nth) AS owner, arg_max(attempt, nth) AS attempt FROM walk GROUP BY job_id)
SELECT job_id, event_id, make_timestamp(t) AS acted_at, who AS worker, outcome, CAST(attempt AS INTEGER) AS attempt FROM walk WHERE nth > 0
UNION ALL SELECT job_id, NULL, make_timestamp(lapsed_at), lapsed_by, 'lapsed', CAST(lapsed_try AS INTEGER) FROM walk WHERE lapsed_at IS NOT NULL
UNION ALL SELECT job_id, NULL, make_timestamp(until), owner, 'lapsed', CAST(attempt AS INTEGER) FROM ends WHERE status = 'running' AND until < epoch_us(TIMESTAMP '{UNTIL}')""")
def st2_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's job: who was given it, kept it, lost it, and when leases lapsed."""
    rows = J.over_table(job_events(table(spark, sf_dir, "events")), J.Leases(LEASE), _HORIZON)
    at = F.timestamp_micros("at").cast("timestamp_ntz") if spark.conf.get("spark.sql.session.timeZone") == "UTC" else F.from_utc_timestamp(F.timestamp_micros("at"), F.current_timezone()).cast("timestamp_ntz")
    return rows.select(F.col("key").alias("job_id"), F.col("id").alias("event_id"), at.alias("acted_at"), F.col("who").alias("worker"), "outcome", "attempt")


def load_events(clicks: DataFrame) -> DataFrame:
    """(key, ts, at, id, what, who, body) of the clicks: a client's site, the page ``k``, and its kind as what the page says; errors are failures."""
    at = F.col("arrived_at")
    what = F.when(F.col("kind").isNull(), "cancel").when(F.col("kind") == "error", "failed").otherwise("page")
    return clicks.select(F.col("client_id").alias("key"), at.cast("timestamp").alias("ts"), micros(at).alias("at"), F.col("click_id").alias("id"), what.alias("what"), F.get_json_object("props", "$.k").alias("who"), F.col("kind").alias("body"))


#: A run's time for pages, and its deadline.
BUDGET, DEADLINE = 20 * J.MINUTE, 30 * J.MINUTE


@query()
def st9_load_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of every client's loads, each time they change; the next run goes on where the last one stopped."""
    return J.over_table(load_events(table(spark, sf_dir, "clicks")), J.Loads(BUDGET, DEADLINE), 1 << 62).withColumnRenamed("key", "site")
