"""Field maps: typed coercions whose failures are rows of a report, never errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coercions by name. Each gives null for what it can't read.
COERCIONS = {
    "string": lambda c: c.cast("string"),
    "int": lambda c: c.try_cast("bigint"),
    "date_iso": lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"),
    "date_epoch": lambda c: F.timestamp_seconds(c.try_cast("bigint")).cast("date"),
    "date_dmy": lambda c: F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).cast("date"),
    "date_mdy": lambda c: F.try_to_timestamp(c, F.lit("MM/dd/yyyy")).cast("date"),
    "string_list": lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""),
    "csv_list": lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""),
}


def validate(raw: DataFrame, rules: dict[str, tuple[str, str]], threshold: float = 0.95) -> DataFrame:
    """(target, rows, present, parsed, distinct_values, first_example, blocking) of each rule {target: (field, coercion)}.

    A rule blocks if the share of present and parsed values is under the threshold.
    """
    cells = F.array(*(F.struct(F.lit(t).alias("target"), F.col(f).cast("string").alias("raw"), COERCIONS[c](F.col(f).cast("string")).cast("string").alias("value")) for t, (f, c) in rules.items()))
    rows = raw.select(F.inline(cells))
    there = F.col("raw").isNotNull() & (F.trim("raw") != "")
    out = rows.groupBy("target").agg(
        F.count("*").alias("rows"), F.count(F.when(there, 1)).alias("present"), F.count(F.when(there & F.col("value").isNotNull(), 1)).alias("parsed"),
        F.count_distinct("value").alias("distinct_values"), F.min("value").alias("first_example"),
    )
    return out.withColumn("blocking", F.col("parsed") < F.col("rows") * threshold)


def field_profile(rows: DataFrame, json_col: str) -> DataFrame:
    """(field, present, distinct_values, first_sample) of every key of a JSON object column."""
    pairs = rows.select(F.explode(F.from_json(json_col, "map<string,string>")).alias("field", "value"))
    return pairs.groupBy("field").agg(F.count("*").alias("present"), F.count_distinct("value").alias("distinct_values"), F.min("value").alias("first_sample"))


def datapoint(json: Column, path: str) -> Column:
    """A value by dotted path, trimmed to 400 characters; null if it is missing or empty."""
    value = F.get_json_object(json, f"$.{path}")
    return F.when(F.trim(value) != "", F.substring(value, 1, 400))


#: Parts of field names that suggest a target, the best first.
NEEDLES = {
    "doc_id": ("docid", "docref", "documentnumber", "contentid", "pageid", "controldocid", "matterdocid", "uid", "id"),
    "title": ("title", "name", "heading", "subject"),
    "url": ("url", "link", "href", "uri", "webui", "web", "self", "location", "permalink"),
    "updated_at": ("modified", "updated", "revised", "reviewed", "issued", "published", "date", "changed", "effective"),
    "space": ("space", "team", "domain", "site", "practice"),
    "owner": ("owner", "maintainer", "custodian", "accountable"),
    "labels": ("tag", "label", "topic", "keyword", "categor", "flag"),
    "sensitivity": ("classification", "level", "infoclass", "handling"),
    "acl_principals": ("acl", "readgroups", "entitlement", "permitted"),
}


def suggest(fields: DataFrame) -> DataFrame:
    """(kb, target, field, coercion) suggested for ``fields(kb, place, field)``: the first field that holds the best needle.

    A suggestion is for a reviewer; nothing is applied. Targets without a field have no row.
    """
    low = F.lower("field")
    cells = [F.when(F.contains(low, F.lit(needle)), F.struct(F.lit(target).alias("target"), F.lit(i).alias("needle"))) for target, needles in NEEDLES.items() for i, needle in enumerate(needles)]
    rows = fields.select("kb", "place", "field", F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    best = rows.groupBy("kb", "target").agg(F.min_by("field", F.struct("needle", "place")).alias("field"))
    dated = F.when(F.lower("field").rlike("epoch|ts|time"), "date_epoch").otherwise("date_iso")
    coercion = F.when(F.col("target") == "updated_at", dated).when(F.col("target") == "labels", "csv_list").when(F.col("target") == "acl_principals", "string_list").otherwise("string")
    return best.select("kb", "target", "field", coercion.alias("coercion"))
