"""Access: lists, role rules and the chain of gates between a search hit and evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.operators.scope import Scope, exclusion_rule


@dataclass(frozen=True)
class RoleRule:
    """Allows or denies documents of a space and/or with a label; with both, both must fit; with neither it fits nothing."""

    effect: str
    space: str | None = None
    label: str | None = None

    def fits(self) -> Column:
        if self.space is None and self.label is None:
            return F.lit(False)
        out = F.lit(True)
        if self.space is not None:
            out = out & F.coalesce(F.col("space") == self.space, F.lit(False))
        if self.label is not None:
            out = out & F.coalesce(F.array_contains("labels", self.label), F.lit(False))
        return out

    def named(self) -> str:
        return " and ".join(f"{k} {v}" for k, v in (("space", self.space), ("label", self.label)) if v)


def role_reason(rules: list[RoleRule]) -> Column:
    """Why a document is allowed or not: denials first, then the allow list if there is one."""
    if not rules:
        return F.lit("no role rules")
    allows = [r for r in rules if r.effect == "allow"]
    out = F.lit("outside this role's allow list" if allows else "no allow list; not denied")
    for r in reversed(allows):
        out = F.when(r.fits(), F.lit(f"allowed by rule on {r.named()}")).otherwise(out)
    for r in reversed([r for r in rules if r.effect == "deny"]):
        out = F.when(r.fits(), F.lit(f"denied by rule on {r.named()}")).otherwise(out)
    return out


def role_allows(rules: list[RoleRule]) -> Column:
    """Whether the rules let a document through."""
    return ~(role_reason(rules).startswith("denied") | role_reason(rules).startswith("outside"))


def forbidden(groups: list[str], denied: Column | None = None) -> Column:
    """Whether a principal may not read a document.

    ``service`` reads everything; else a group on the ``denied`` list (an array) is refused; else
    one must be on the access list. Without an access list nobody else reads.
    """
    if "service" in groups:
        return F.lit(False)
    own = F.array(*map(F.lit, groups)) if groups else F.array().cast("array<string>")
    barred = F.coalesce(F.arrays_overlap(denied, own), F.lit(False)) if denied is not None else F.lit(False)
    return barred | ~F.coalesce(F.col("acl").isin("all-staff", *groups), F.lit(False))


def staleness(age: Column) -> Column:
    """By age in days: fresh, ageing (180), stale (365), expired (1095); unknown without a date."""
    return F.when(age.isNull(), "unknown_age").when(age >= 1095, "expired").when(age >= 365, "stale").when(age >= 180, "ageing").otherwise("fresh")


def authority(rules: list[tuple[Column, str]], pin: Column) -> Column:
    """The tier: a pin, else archive if expired, else the first rule that fits, else supporting."""
    tier = F.lit("supporting")
    for fits, name in reversed(rules):
        tier = F.when(F.coalesce(fits, F.lit(False)), F.lit(name)).otherwise(tier)
    return F.coalesce(pin, F.when(staleness(F.col("age_days")) == "expired", "archive").otherwise(tier))


def gates(hits: DataFrame, scope: Scope, groups: list[str], rules: list[RoleRule]) -> DataFrame:
    """``hits`` (catalogue rows of search hits) with ``dropped_by``: the one gate that stops each.

    In order: stale index entry, access list, scope rule, archive tier, role rule. Rows that pass
    have a null. Gates come before any ranking, so what is forbidden never moves what is not.
    """
    tier = authority([(F.array_contains("labels", "approved"), "authoritative"), (F.array_contains("labels", "archive"), "archive")], F.lit(None).cast("string"))
    out = F.when(~F.col("in_store"), "stale_index").when(forbidden(groups), "forbidden").otherwise(exclusion_rule(scope))
    out = F.coalesce(out, F.when(tier == "archive", "archive_tier"), F.when(~role_allows(rules), "role_rule"))
    return hits.withColumn("dropped_by", out)
