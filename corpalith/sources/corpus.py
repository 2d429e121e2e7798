"""The corpus as a catalogue: documents with placement, labels, age, access and where they are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed "now" of every query.
AS_OF = "2026-08-22 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(documents: DataFrame) -> DataFrame:
    """Documents with metadata derived from their ids, as the tables carry none.

    ``age_days`` is null for documents without a date; ``in_index`` and ``in_store`` differ, so
    that a search hit is not always a document.
    """
    n = F.col("doc_id")
    return documents.select(
        "doc_id",
        F.col("source").alias("space"),
        F.col("lang").alias("kb"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), n.cast("string")).alias("path"),
        F.substring(F.regexp_extract("text", "^[^.!?]*", 0), 1, 80).alias("title"),
        F.element_at(F.array(*map(F.lit, ("policy", "procedure", "faq", "page", None))), (n % 5 + 1).cast("int")).alias("doc_type"),
        F.array("lang", F.when(n % 7 == 0, "draft").when(n % 7 == 1, "approved").when(n % 7 == 2, "archive").otherwise(F.concat(F.lit("state-"), "lang"))).alias("labels"),
        (n % 4).cast("int").alias("sensitivity"),
        F.when(n % 17 != 0, (n * 7) % 1500).alias("age_days"),
        F.when(n % 6 == 0, "restricted").otherwise("all-staff").alias("acl"),
        (n % 19 != 0).alias("in_index"),
        (n % 23 != 0).alias("in_store"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        "text",
    )


#: The same view as a common table expression, for the oracle.
CATALOGUE_SQL = """catalogue AS (
  SELECT doc_id, source AS space, lang AS kb, '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path,
    substring(regexp_extract(text, '^[^.!?]*'), 1, 80) AS title,
    CASE doc_id % 5 WHEN 0 THEN 'policy' WHEN 1 THEN 'procedure' WHEN 2 THEN 'faq' WHEN 3 THEN 'page' END AS doc_type,
    [lang, CASE doc_id % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' WHEN 2 THEN 'archive' ELSE 'state-' || lang END] AS labels,
    CAST(doc_id % 4 AS INTEGER) AS sensitivity, CASE WHEN doc_id % 17 <> 0 THEN (doc_id * 7) % 1500 END AS age_days,
    CASE WHEN doc_id % 6 = 0 THEN 'restricted' ELSE 'all-staff' END AS acl,
    doc_id % 19 <> 0 AS in_index, doc_id % 23 <> 0 AS in_store, CAST(strlen(text) AS BIGINT) AS n_bytes, text
  FROM documents)"""
