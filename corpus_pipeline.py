"""A corpus pipeline: quality, line dedup, near-duplicates, decontamination and source mixing.

Each stage works on everything its predecessor kept. All but the last return the columns of
``documents``; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpalith.llm import decontaminate, line_dedup, mixing, near_copies, quality
from corpalith.llm.common import durable, fold, hot_join, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_SCORE = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under ``KEEP_SCORE`` go. Rows are scored in place, without a join."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, learn=fold("id", 4) != 2)
    rows = docs.select(*COLUMNS)
    judged = quality.with_statistics(rows, F.col("text"), [F.col(c) for c in COLUMNS])
    return judged.where(model.score() >= KEEP_SCORE).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, exact repeats of short lines too; a document of which nothing is left goes with them."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    cleaned = cleaned.where((F.col("n_lines_dropped") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    return cleaned.select("doc_id", "text", "lang", "source", F.when(F.col("n_lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def text_key(text: Column) -> Column:
    """Hash of a text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of each group of texts: the one with the least (doc_id, text hash), a null id last.

    ``roots(key, root)`` names the group of a text by its key; a text without one is its own group.
    Repeated rows (same id and text) are one; of those the one with the least other columns stays.
    """
    rows = docs.select(*COLUMNS, text_key(F.col("text")).alias("key"))
    held = durable(rows.groupBy("doc_id", "key").agg(F.count("*").alias("times")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    placed = hot_join(held, roots.toDF("k", "root"), [("key", "k")], "left").select("doc_id", "key", "times", place.alias("place"), F.coalesce("root", "key").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("place").alias("first")).withColumnRenamed("root", "r")
    marked = hot_join(placed, firsts, [("root", "r")]).select(F.col("doc_id").alias("m_id"), F.col("key").alias("m_key"), "times", (F.col("place") == F.col("first")).alias("stays"))
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key"))
    marked = durable(marked.where("not stays or times > 1"))
    gone, repeated = marked.where("not stays"), marked.where("stays")
    n_gone, n_repeated = marked.agg(F.count_if(~F.col("stays")), F.count_if("stays")).first()
    if not n_repeated:
        return rows.join(small(gone, n_gone), same, "left_anti").select(*COLUMNS)
    single = rows.join(small(marked, n_gone + n_repeated), same, "left_anti").select(*COLUMNS)
    rest = [c for c in COLUMNS if c != "doc_id"]
    folded = rows.join(small(repeated, n_repeated), same, "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct(*rest)).alias("row"))
    return single.union(folded.select("doc_id", *(f"row.{c}" for c in rest)).select(*COLUMNS))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, chosen by ``one_of_each``; rows without an id take part.

    Near are texts whose 5-word shingles have a similarity of 0.8 or more. Fingerprints of 64 bits within
    few bits of each other miss most of these, so the links are those of ``near_copies``, which checks each.
    """
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    return one_of_each(docs, near_copies.near_copies(texts))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, judged by their text alone: rows without an id too."""
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    found = decontaminate.contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    found = durable(found.select(F.col("doc_id").alias("found")).distinct())
    return docs.select(*COLUMNS).join(small(found, found.count()), text_key(F.col("text")) == F.col("found"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words it takes, repeats counted.

    Rows that are equal in every column are counted out from one of them, so each is taken for
    itself; nulls in any column are values like others, and an empty table takes nothing.
    """
    rows = docs.select(*COLUMNS, mixing.text_hash(F.col("text")).alias("th"), F.xxhash64("lang", "n_chars").alias("rest"))
    extra = ["size", "source_size", "target", "taken"]
    mixed = durable(mixing.mix(rows, keep=("rest",)).where("taken > 0"))
    marks = mixed.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("text_hash").alias("m_th"), F.col("rest").alias("m_rest"), "times", *extra)
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("th") == F.col("m_th")) & (F.col("rest") == F.col("m_rest"))
    single = rows.join(marks.where("times = 1"), same).select(*COLUMNS, *extra)
    repeated = marks.where("times > 1")
    n = repeated.count()
    if not n:
        return single
    rest = [c for c in COLUMNS if c not in ("doc_id", "source")]
    firsts = rows.join(small(repeated.dropDuplicates(["m_id", "m_source", "m_th", "m_rest"]), n), same, "left_semi")
    firsts = firsts.groupBy("doc_id", "source", "th", "rest").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "source", "th", "rest", *(f"row.{c}" for c in rest if c != "rest"))
    return single.union(firsts.join(repeated, same).select(*COLUMNS, *extra))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mixing_stage),
]

#: A fitted classifier and 64-bit hashes are beyond the oracle's SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
