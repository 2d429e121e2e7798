"""State that moves: publishing, refreshes, jobs and what supersedes what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def published(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """``stored(doc_id, body, version)`` after ``arrived(doc_id, body)``: the version moves only if the body changed; new ones start at 1."""
    new = arrived.select(F.col("doc_id").alias("a_id"), F.col("body").alias("a_body"))
    both = stored.join(new, F.col("doc_id") == F.col("a_id"), "full")
    moved = F.col("a_id").isNotNull() & ~F.col("a_body").eqNullSafe(F.col("body"))
    version = F.when(F.col("doc_id").isNull(), 1).otherwise(F.col("version") + moved.cast("int"))
    body = F.when(F.col("a_id").isNotNull(), F.col("a_body")).otherwise(F.col("body"))
    return both.select(F.coalesce("doc_id", "a_id").alias("doc_id"), body.alias("body"), version.cast("int").alias("version"))


def refreshed(members: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """``members(doc_id, hash, first_seen, last_changed, missing_since)`` after a refresh that ``found(doc_id, hash)``, with ``verdict``.

    new, changed, unchanged or gone. A member that is gone keeps the day it was first missed; one that
    is back is missed no more; the day of change moves only with the hash.
    """
    new = found.select(F.col("doc_id").alias("f_id"), F.col("hash").alias("f_hash"))
    both = members.join(new, F.col("doc_id") == F.col("f_id"), "full")
    verdict = F.when(F.col("doc_id").isNull(), "new").when(F.col("f_id").isNull(), "gone").when(F.col("hash").eqNullSafe(F.col("f_hash")), "unchanged").otherwise("changed")
    both = both.withColumn("verdict", verdict)
    fresh = F.col("verdict").isin("new", "changed")
    return both.select(
        F.coalesce("doc_id", "f_id").alias("doc_id"), F.coalesce("f_hash", "hash").alias("hash"), F.coalesce("first_seen", now).alias("first_seen"), F.when(fresh, now).otherwise(F.col("last_changed")).alias("last_changed"),
        F.when(F.col("verdict") == "gone", F.coalesce("missing_since", now)).alias("missing_since"), "verdict",
    )


def claimed(jobs: DataFrame, workers: int) -> DataFrame:
    """``jobs(job_id, kind, ...)`` with the ``worker`` that owns each: a job has one owner, so none is claimed twice and nobody waits."""
    return jobs.withColumn("worker", F.pmod(F.crc32(F.col("job_id").cast("string").cast("binary")), F.lit(workers)).cast("int"))


#: Which job follows which.
FOLLOWS = {"crawl_plan": "crawl_load", "materialise": "enrich", "enrich": "index", "refresh": "index"}


def follow_up(kind: Column, succeeded: Column) -> Column:
    """The job that a finished one sets off; none after a failure."""
    out = F.lit(None).cast("string")
    for name, after in FOLLOWS.items():
        out = F.when(succeeded & (kind == name), F.lit(after)).otherwise(out)
    return out


def superseded(links: DataFrame, steps: int = 8) -> DataFrame:
    """(doc_id, successor, hops) of ``links(doc_id, next_id)``: the last of each chain, by doubling, so chains of 2 ** ``steps`` are followed.

    A document has one successor at most; links that form a ring end nowhere and are left out.
    """
    now = links.where("doc_id <> next_id").select("doc_id", F.col("next_id").alias("successor"), F.lit(1).cast("long").alias("hops"))
    for _ in range(steps):
        on = now.select(F.col("doc_id").alias("d"), F.col("successor").alias("s"), F.col("hops").alias("h"))
        now = now.join(on, F.col("successor") == F.col("d"), "left").select("doc_id", F.coalesce("s", "successor").alias("successor"), (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"))
    ends = links.select(F.col("doc_id").alias("d"))
    return now.join(ends, F.col("successor") == F.col("d"), "left_anti")
