"""Writes as functions from the stored table and what arrives to the table that is stored next.

Every function reads both sides once and joins them by key, so it runs the same on a lake table
that is swapped whole or on a partition of it. Keys are unique on the stored side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.operators import order

#: The reasons that feedback may give.
REASONS = ("wrong", "incomplete", "outdated", "not_relevant", "no_answer", "other")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` (one for each key) and the rows of ``old`` whose key isn't in it."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def members(old: DataFrame, new: DataFrame) -> DataFrame:
    """(collection, doc_id, contributed_by, state, missing_since, pin) after a run of the rules.

    Contributors are united, a returning member is a member again, and a pin is kept.
    ``new(collection, doc_id, contributed_by)``.
    """
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, (F.col("a.collection") == F.col("b.collection")) & (F.col("a.doc_id") == F.col("b.doc_id")), "full")
    none, back = F.array().cast("array<string>"), F.col("b.doc_id").isNotNull()
    by = F.array_sort(F.array_union(F.coalesce("a.contributed_by", none), F.coalesce("b.contributed_by", none)))
    return both.select(
        F.coalesce("a.collection", "b.collection").alias("collection"), F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), by.alias("contributed_by"),
        F.when(back, "member").otherwise(F.col("a.state")).alias("state"), F.when(~back, F.col("a.missing_since")).alias("missing_since"), F.col("a.pin").alias("pin"),
    )


def soft_delete(stored: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Members that ``seen(doc_id)`` lacks are ``removed``; the first time it is noted stays. Those pinned "in" remain members."""
    found = seen.select(F.col("doc_id").alias("seen_id")).distinct()
    joined = stored.join(found, F.col("doc_id") == F.col("seen_id"), "left")
    gone = F.col("seen_id").isNull() & ~F.coalesce(F.col("pin") == "in", F.lit(False))
    put = {"state": F.when(gone, "removed").otherwise(F.col("state")), "missing_since": F.when(gone, F.coalesce("missing_since", now)).otherwise(F.col("missing_since"))}
    return joined.select(*(put[c].alias(c) if c in put else F.col(c) for c in stored.columns))


def append_turns(threads: DataFrame, turns: DataFrame) -> DataFrame:
    """(thread_id, ordinal, text, title) of new ``turns(thread_id, place, text)`` after the stored ``threads(thread_id, ordinal, text)``.

    Ordinals go on from the thread's last one. A thread is named by its first text, 300 characters.
    A thread with very many new turns is numbered range by range.
    """
    last = threads.groupBy("thread_id").agg(F.max("ordinal").alias("last"), F.min_by("text", "ordinal").alias("first_text"))
    rows = turns.join(last.withColumnRenamed("thread_id", "known"), F.col("thread_id") == F.col("known"), "left")
    named = turns.groupBy(F.col("thread_id").alias("begun")).agg(F.min_by("text", "place").alias("new_text"))
    rows = order.numbered(rows.select("thread_id", "place", "text", "last", "first_text"), "thread_id", ["place"])
    rows = rows.join(named, F.col("thread_id").eqNullSafe(F.col("begun")))
    first = F.coalesce("first_text", "new_text")
    return rows.select("thread_id", (F.coalesce("last", F.lit(-1)) + F.col("nth")).alias("ordinal"), "text", F.substring(first, 1, 300).alias("title"))


def feedback(rows: DataFrame) -> DataFrame:
    """``rows(verdict, reason, ...)`` with ``refused`` (a named reason or null) and ``promoted``: an unhelpful answer becomes a test case."""
    refused = F.when(~F.coalesce(F.col("verdict").isin("helpful", "unhelpful"), F.lit(False)), "unknown_verdict").when(F.col("reason").isNotNull() & ~F.col("reason").isin(*REASONS), "unknown_reason")
    return rows.withColumn("refused", refused).withColumn("promoted", F.col("refused").isNull() & (F.col("verdict") == "unhelpful"))


def replace_policy(policies: DataFrame, rules: DataFrame, new_rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(policies, rules) after the rules of some owners were replaced whole; a replaced owner's version goes up by one.

    An owner whose rules stay as they are keeps its version. Rules are ``(owner, rule)``.
    """
    old_set = rules.groupBy(F.col("owner").alias("o1")).agg(F.array_sort(F.collect_set("rule")).alias("was"))
    new_set = new_rules.groupBy(F.col("owner").alias("o2")).agg(F.array_sort(F.collect_set("rule")).alias("now"))
    joined = policies.join(old_set, F.col("owner") == F.col("o1"), "left").join(new_set, F.col("owner") == F.col("o2"), "left")
    moved = F.col("now").isNotNull() & ~F.col("was").eqNullSafe(F.col("now"))
    kept = rules.join(new_rules.select("owner").distinct(), "owner", "left_anti").unionByName(new_rules)
    return joined.select("owner", (F.col("version") + moved.cast("int")).alias("version")), kept


def prune(vectors: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """``vectors(ref, model, ...)`` with the chunk they belong to and of the current model; the rest is dropped."""
    return vectors.where(F.col("model") == model).join(chunks.select("ref").distinct(), "ref", "left_semi").select(*vectors.columns)
