"""The store and the index beside it: outcomes of a fetch, filters that the index takes, patterns of crawls and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.operators.scope import Scope


def fetched(asked: DataFrame, store: DataFrame, refused: Column) -> DataFrame:
    """``asked(asked_id)`` with the store's columns and ``outcome``: not_found, forbidden or resolved; only what resolved has a text.

    One join for all ids; ``refused`` is over the store's columns.
    """
    hits = asked.join(store, F.col("asked_id") == F.col("doc_id"), "left")
    outcome = F.when(F.col("doc_id").isNull(), "not_found").when(refused, "forbidden").otherwise("resolved")
    return hits.withColumn("outcome", outcome).withColumn("text", F.when(F.col("outcome") == "resolved", F.col("text")))


@dataclass(frozen=True)
class IndexFilters:
    """What of a scope the index itself can apply. Rows without a date pass the dates."""

    spaces: tuple[str, ...] = ()
    labels_any: tuple[str, ...] = ()
    labels_none: tuple[str, ...] = ()
    doc_types: tuple[str, ...] = ()
    oldest_days: int | None = None
    newest_days: int | None = None

    @classmethod
    def of(cls, scope: Scope) -> IndexFilters:
        """Spaces only if all roots are spaces: other roots could let more in."""
        spaces = tuple(v for kind, v in scope.roots if kind == "space")
        return cls(spaces if len(spaces) == len(scope.roots) else (), tuple(scope.labels_any), tuple(scope.labels_none), tuple(scope.doc_types), scope.oldest_days, scope.newest_days)

    def predicate(self) -> Column:
        """As one condition over an index's columns, which the scan can take."""
        some = lambda names: F.coalesce(F.arrays_overlap("labels", F.array(*map(F.lit, names))), F.lit(False))
        out = F.lit(True)
        if self.spaces:
            out = out & F.col("space").isin(*self.spaces)
        if self.labels_any:
            out = out & some(self.labels_any)
        if self.labels_none:
            out = out & ~some(self.labels_none)
        if self.doc_types:
            out = out & (F.col("doc_type").isNull() | F.col("doc_type").isin(*self.doc_types))
        if self.oldest_days is not None:
            out = out & (F.col("age_days").isNull() | (F.col("age_days") <= self.oldest_days))
        if self.newest_days is not None:
            out = out & (F.col("age_days").isNull() | (F.col("age_days") >= self.newest_days))
        return out


def typed_filter(field: str, op: str, value: str | list[str]) -> Column:
    """A filter that a caller may state: on space, owner, label, doc_type or title; eq, neq, in or contains. Others raise."""
    if field not in ("space", "owner", "label", "doc_type", "title") or op not in ("eq", "neq", "in", "contains"):
        raise ValueError(f"no filter {field} {op}")
    values = [value] if isinstance(value, str) else list(value)
    if field == "label":
        held = {"contains": lambda x: F.contains(F.lower(x), F.lit(values[0].lower())), "in": lambda x: x.isin(*values)}.get(op, lambda x: x == values[0])
        found = F.exists("labels", held)
        return ~found if op == "neq" else found
    column = F.col(field)
    test = {"eq": column == values[0], "neq": column != values[0], "in": column.isin(*values), "contains": F.contains(F.lower(column), F.lit(values[0].lower()))}[op]
    return F.coalesce(test, F.lit(op == "neq"))


def robots_allow(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the longest rule (prefix, allowed) that a path starts with lets it in; allowed wins ties, and no rule allows."""
    out = F.lit(True)
    for prefix, allowed in sorted(rules, key=lambda r: (len(r[0]), r[1])):
        out = F.when(path.startswith(prefix), F.lit(allowed)).otherwise(out)
    return out


def key_allowed(key: Column, patterns: list[str]) -> Column:
    """Whether a whole key fits a pattern; no patterns allow nothing."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | F.coalesce(key.rlike(rf"\A(?:{pattern})\z"), F.lit(False))
    return out


def public_url(doc_id: Column, path: Column, site: str) -> Column:
    """An id that is an address stands for itself; any other is the site's path."""
    return F.when(doc_id.rlike("^https?://"), doc_id).otherwise(F.concat(F.lit(site), path))


def unit(text: Column) -> Column:
    """A number from 0 to below 1 that follows from a text alone."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
