"""Scopes: a closed grammar of rules; every document left out is left out by exactly one named rule."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What is in: at least one root, then patterns, labels, types, an age window and a ceiling.

    ``roots`` are ("space" | "path" | "label", value). Ages are days before the fixed now.
    """

    roots: tuple[tuple[str, str], ...]
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    labels_any: tuple[str, ...] = ()
    labels_none: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    oldest_days: int | None = None
    newest_days: int | None = None
    ceiling: int = 1
    name: str = field(default="scope", compare=False)

    def __post_init__(self) -> None:
        if not self.roots:
            raise ValueError("a scope names at least one root")


def _glob(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ``*`` crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return rf"\A(?s:{''.join(out)})\z"


def path_matches(path: Column, pattern: str) -> Column:
    """A glob, or without glob characters the path itself or a folder above it."""
    if re.search(r"[*?\[]", pattern):
        return path.rlike(_glob(pattern))
    return (path == pattern) | path.startswith(pattern.rstrip("/") + "/")


def pattern_matches(pattern: str) -> Column:
    """On the path, or as a glob on the title."""
    return path_matches(F.col("path"), pattern) | F.col("title").rlike(_glob(pattern))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def exclusion_rule(scope: Scope) -> Column:
    """The first rule that leaves a catalogue row out, in fixed order; null if it is in scope.

    Documents without a type or date pass the rules on them. Exclusion beats inclusion.
    """
    root = {"space": lambda v: F.col("space") == v, "path": lambda v: path_matches(F.col("path"), v), "label": lambda v: F.array_contains("labels", v)}
    labels = lambda names: F.arrays_overlap("labels", F.array(*map(F.lit, names)))
    rules: list[tuple[Column, str]] = [(~_any([root[k](v) for k, v in scope.roots]), "no_matching_root")]
    if scope.include:
        rules.append((~_any([pattern_matches(p) for p in scope.include]), "include_pattern_did_not_match"))
    if scope.exclude:
        rules.append((_any([pattern_matches(p) for p in scope.exclude]), "exclude_pattern_matched"))
    if scope.labels_any:
        rules.append((~F.coalesce(labels(scope.labels_any), F.lit(False)), "required_label_absent"))
    if scope.labels_none:
        rules.append((F.coalesce(labels(scope.labels_none), F.lit(False)), "forbidden_label_present"))
    if scope.doc_types:
        rules.append((F.col("doc_type").isNotNull() & ~F.col("doc_type").isin(*scope.doc_types), "doc_type_not_in_scope"))
    if scope.oldest_days is not None:
        rules.append((F.coalesce(F.col("age_days") > scope.oldest_days, F.lit(False)), "updated_before_window"))
    if scope.newest_days is not None:
        rules.append((F.coalesce(F.col("age_days") < scope.newest_days, F.lit(False)), "updated_after_window"))
    rules.append((F.col("sensitivity") > scope.ceiling, "above_sensitivity_ceiling"))
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def age_bucket(age: Column) -> Column:
    """0-90, 90-365 days, 1-3 years, older, or unknown."""
    return F.when(age.isNull(), "unknown").when(age < 90, "0-90").when(age < 365, "90-365").when(age < 1095, "1-3y").otherwise("3+y")


def preview(catalogue: DataFrame, scope: Scope) -> DataFrame:
    """Counts of what a scope matches: in total and by space, type and age, in one pass."""
    rows = catalogue.select("doc_id", "space", F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), age_bucket(F.col("age_days")).alias("age"), "n_bytes", exclusion_rule(scope).alias("rule"))
    kept = rows.where("rule is null")
    sets = kept.groupingSets([["space"], ["doc_type"], ["age"], []], "space", "doc_type", "age")
    return sets.agg(F.count("*").alias("documents"), F.sum("n_bytes").alias("bytes"), F.grouping_id().cast("int").alias("level")).select("level", "space", "doc_type", "age", "documents", "bytes")


def diff(catalogue: DataFrame, old: Scope, new: Scope) -> DataFrame:
    """For each outcome of changing a scope (added, removed, unchanged, still_out): documents and the rules behind it."""
    both = catalogue.select("doc_id", exclusion_rule(old).alias("was"), exclusion_rule(new).alias("now"))
    change = F.when(F.col("was").isNull() & F.col("now").isNull(), "unchanged").when(F.col("was").isNull(), "removed").when(F.col("now").isNull(), "added").otherwise("still_out")
    return both.select("doc_id", change.alias("change"), "was", "now").groupBy("change", "was", "now").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
