"""Collections of documents by rules, and the ladder that resolves pasted URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How sure each rung is; accepted from 0.8, shown from 0.45.
RUNGS = {"exact": 1.0, "alias": 0.95, "redirect": 0.9, "path": 0.85, "title": 0.6, "search": 0.5}


def materialise(docs: DataFrame, include: dict[str, Column], exclude: dict[str, Column], existing: DataFrame) -> DataFrame:
    """(doc_id, contributed_by, change): what the rules give against ``existing(doc_id, pin)``.

    Exclusion beats inclusion; a pin ("in" or "out") beats both. change is added, removed or kept.
    """
    fits = lambda rules: F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    chosen = docs.select("doc_id", fits(include).alias("by"), fits(exclude).alias("out")).where((F.size("by") > 0) | (F.size("out") > 0))
    old = existing.select(F.col("doc_id").alias("old_id"), "pin")
    both = chosen.join(old, F.col("doc_id") == F.col("old_id"), "full")
    now = F.when(F.col("pin") == "in", True).when(F.col("pin") == "out", False).otherwise(F.coalesce((F.size("by") > 0) & (F.size("out") == 0), F.lit(False)))
    was = F.col("old_id").isNotNull()
    change = F.when(was & now, "kept").when(was, "removed").when(now, "added")
    return both.select(F.coalesce("doc_id", "old_id").alias("doc_id"), F.coalesce("by", F.array().cast("array<string>")).alias("contributed_by"), change.alias("change")).where("change is not null")


def descendants(docs: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, doc_id) of documents below a parent's path: an equi-join on every ancestor path, not a prefix scan."""
    parts = docs.select("doc_id", F.split("path", "/").alias("p"))
    above = parts.select("doc_id", F.explode(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda n: F.array_join(F.slice("p", 1, n), "/"))).alias("parent"))
    return above.join(parents.select(F.col("path").alias("parent")).distinct(), "parent").select("parent", "doc_id")


def resolve(keys: DataFrame, rungs: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(key, doc_id, rung, score, outcome) of ``keys(key, ...)`` over rungs {name: (column of keys, (by, n, doc_id))}: only the first rung that finds something counts.

    ``by`` is unique in a rung, so keys are only looked up. Accepted from 0.8 if a single document
    has the best score; ambiguous on ties and from 0.45; else unresolved.
    """
    rows, found = keys, F.lit(None).cast("struct<rung:string,score:double,n:bigint,doc_id:bigint>")
    for name, (column, held) in reversed(rungs.items()):
        rows = rows.join(held.select(F.col("by").alias(f"__{name}"), F.struct(F.lit(name).alias("rung"), F.lit(RUNGS[name]).alias("score"), "n", "doc_id").alias(f"__{name}_found")), F.col(column) == F.col(f"__{name}"), "left")
        found = F.coalesce(F.col(f"__{name}_found"), found)
    rows = rows.select("key", found.alias("f"))
    single = F.col("f.n") == 1
    outcome = F.when(F.col("f").isNull(), "unresolved").when((F.col("f.score") >= 0.8) & single, "accepted").when(F.col("f.score") >= 0.45, "ambiguous").otherwise("unresolved")
    return rows.select("key", F.when(outcome == "accepted", F.col("f.doc_id")).alias("doc_id"), "f.rung", "f.score", outcome.alias("outcome"))
