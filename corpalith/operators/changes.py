"""Fingerprints, change verdicts, and merges of tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.functions import text as T
from corpalith.operators import ranking


def fingerprint(text: Column, in_order: bool = False) -> Column:
    """Hash of a text's normalised lines, sorted unless ``in_order``: the same for reordered lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != "")
    return F.md5(F.array_join(lines if in_order else F.array_sort(lines), "\n"))


def verdicts(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, verdict, similarity): new, gone, identical, reordered, cosmetic or changed."""
    a = old.select(F.col(key).alias("k1"), F.col(text).alias("t1"))
    b = new.select(F.col(key).alias("k2"), F.col(text).alias("t2"))
    # Equal texts, and those of one side only, are not cut into shingles.
    told = F.col("k1").isNotNull() & F.col("k2").isNotNull() & ~F.col("t1").eqNullSafe(F.col("t2"))
    met = a.join(b, F.col("k1") == F.col("k2"), "full")
    both = ranking.similarity(met.withColumns({"s1": F.when(told, F.col("t1")), "s2": F.when(told, F.col("t2"))}), "s1", "s2")
    words = lambda c: F.array_join(T.tokens(F.col(c)), " ")
    verdict = (
        F.when(F.col("k1").isNull(), "new").when(F.col("k2").isNull(), "gone").when(F.col("t1").eqNullSafe(F.col("t2")), "identical")
        .when(words("t1") == words("t2"), "cosmetic").when(fingerprint(F.col("t1")) == fingerprint(F.col("t2")), "reordered").otherwise("changed")
    )
    return both.select(F.coalesce("k1", "k2").alias(key), verdict.alias("verdict"), F.when(verdict == "changed", F.col("similarity")).alias("similarity"))


def merge(old: DataFrame, new: DataFrame, key: list[str], body: str, stamp: str, now: Column) -> DataFrame:
    """Upsert by key: new values win where they are not null; ``stamp`` moves only if ``body`` changed.

    Both sides have the same columns; keys are unique on each side.
    """
    a, b = old.alias("a"), new.alias("b")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    moved = F.col(f"b.{key[0]}").isNotNull() & ~F.col(f"a.{body}").eqNullSafe(F.col(f"b.{body}"))
    columns = [(F.when(moved, now).otherwise(F.col(f"a.{stamp}")) if c == stamp else F.coalesce(f"b.{c}", f"a.{c}")).alias(c) for c in old.columns]
    return a.join(b, same, "full").select(*columns)


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``old`` whose parent isn't in ``new``, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key isn't there yet, one for each key."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))
