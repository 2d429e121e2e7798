"""Queries of the writes: what is stored after an upsert, a replacement, a removal or an append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpalith.operators import changes, writes
from corpalith.plans.queries import query
from corpalith.sources.corpus import table


@query("""SELECT doc_id, 0 AS ordinal, md5(text) AS body FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0
UNION ALL SELECT doc_id, i, md5(text || '!') FROM documents, (VALUES (0), (1)) v(i) WHERE doc_id % 3 = 0""")
def k3_replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.lit(0).alias("ordinal"), F.md5("text").alias("body"))
    new = docs.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"), F.md5(F.concat("text", F.lit("!"))).alias("body"))
    return changes.replace_children(old, new, "doc_id")


@query("""SELECT vec_id AS ref, CASE WHEN vec_id % 5 = 0 THEN 'second' ELSE 'first' END AS model, len(embedding) AS dim, true AS fresh FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 3 = 0
UNION ALL SELECT vec_id, 'first', len(embedding), false FROM embeddings WHERE vec_id % 5 = 0 OR vec_id % 3 <> 0""")
def k4_embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shaped = lambda rows, model, fresh: rows.select(F.col("vec_id").alias("ref"), model.alias("model"), F.size("embedding").cast("long").alias("dim"), F.lit(fresh).alias("fresh"))
    old = shaped(vectors, F.lit("first"), False)
    new = shaped(vectors.where("vec_id % 5 = 0 OR vec_id % 3 = 0"), F.when(F.col("vec_id") % 5 == 0, "second").otherwise("first"), True)
    return writes.upsert(old, new, ["ref", "model"])


def _members(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 4 <> 0").select(
        F.col("source").alias("collection"), "doc_id", F.array(F.lit("space")).alias("contributed_by"), F.when(F.col("doc_id") % 9 == 0, "removed").otherwise("member").alias("state"),
        F.when(F.col("doc_id") % 9 == 0, F.expr("date '2026-01-01'")).alias("missing_since"), F.when(F.col("doc_id") % 10 == 1, "in").alias("pin"),
    )


_MEMBERS = """stored AS (SELECT source AS collection, doc_id, ['space'] AS contributed_by, CASE WHEN doc_id % 9 = 0 THEN 'removed' ELSE 'member' END AS state,
  CASE WHEN doc_id % 9 = 0 THEN DATE '2026-01-01' END AS missing_since, CASE WHEN doc_id % 10 = 1 THEN 'in' END AS pin FROM documents WHERE doc_id % 4 <> 0)"""


@query(f"""WITH {_MEMBERS}, found AS (SELECT source AS collection, doc_id, [lang, 'space'] AS by FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(s.collection, f.collection) AS collection, coalesce(s.doc_id, f.doc_id) AS doc_id, list_sort(list_distinct(list_concat(coalesce(s.contributed_by, []), coalesce(f.by, [])))) AS contributed_by,
  CASE WHEN f.doc_id IS NOT NULL THEN 'member' ELSE s.state END AS state, CASE WHEN f.doc_id IS NULL THEN s.missing_since END AS missing_since, s.pin
FROM stored s FULL JOIN found f ON s.collection = f.collection AND s.doc_id = f.doc_id""")
def k5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return writes.members(_members(docs), docs.where("doc_id % 3 = 0").select(F.col("source").alias("collection"), "doc_id", F.array("lang", F.lit("space")).alias("contributed_by")))


@query(f"""WITH {_MEMBERS}, marked AS (SELECT *, NOT doc_id % 5 > 0 AND coalesce(pin, '') <> 'in' AS gone FROM stored)
SELECT collection, doc_id, contributed_by, CASE WHEN gone THEN 'removed' ELSE state END AS state, CASE WHEN gone THEN coalesce(missing_since, DATE '2026-08-22') ELSE missing_since END AS missing_since, pin FROM marked""")
def k7_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return writes.soft_delete(_members(docs), docs.where("doc_id % 5 > 0").select("doc_id"), F.expr("date '2026-08-22'"))


@query(f"""WITH {_MEMBERS}, pins AS (SELECT source AS collection, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'out' ELSE 'in' END AS pin FROM documents WHERE doc_id % 7 = 0)
SELECT coalesce(p.collection, s.collection) AS collection, coalesce(p.doc_id, s.doc_id) AS doc_id, coalesce(p.pin, s.pin) AS pin FROM (SELECT * FROM stored WHERE pin IS NOT NULL) s FULL JOIN pins p ON s.collection = p.collection AND s.doc_id = p.doc_id""")
def k8_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = _members(docs).where("pin is not null").select("collection", "doc_id", "pin")
    new = docs.where("doc_id % 7 = 0").select(F.col("source").alias("collection"), "doc_id", F.when(F.col("doc_id") % 2 == 0, "out").otherwise("in").alias("pin"))
    return writes.upsert(old, new, ["collection", "doc_id"])


@query("""WITH stored AS (SELECT conv_id, max(turn) AS last, arg_min(text, turn) AS head FROM conversations WHERE turn < 2 AND conv_id % 3 <> 0 GROUP BY conv_id),
late AS (SELECT c.conv_id, c.turn, c.text, last, coalesce(head, first(c.text) OVER (PARTITION BY c.conv_id ORDER BY c.turn)) AS head FROM conversations c LEFT JOIN stored s ON s.conv_id = c.conv_id WHERE c.turn >= 2)
SELECT conv_id AS thread_id, coalesce(last, -1) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, text, substring(head, 1, 300) AS title FROM late""")
def k9_append_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "thread_id")
    stored = turns.where("turn < 2 and thread_id % 3 <> 0").select("thread_id", F.col("turn").alias("ordinal"), "text")
    return writes.append_turns(stored, turns.where("turn >= 2").select("thread_id", F.col("turn").alias("place"), "text"))


_SAID = """said AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'meh' WHEN quality = 1 THEN 'helpful' ELSE 'unhelpful' END AS verdict,
  CASE doc_id % 4 WHEN 0 THEN 'wrong' WHEN 1 THEN 'outdated' WHEN 2 THEN 'ugly' END AS reason FROM labels)"""


@query(f"""WITH {_SAID}, judged AS (SELECT *, CASE WHEN verdict NOT IN ('helpful', 'unhelpful') THEN 'unknown_verdict' WHEN reason = 'ugly' THEN 'unknown_reason' END AS refused FROM said)
SELECT *, refused IS NULL AND verdict = 'unhelpful' AS promoted FROM judged""")
def k10_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 4
    said = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("doc_id") % 13 == 0, "meh").when(F.col("quality") == 1, "helpful").otherwise("unhelpful").alias("verdict"),
        F.when(n == 0, "wrong").when(n == 1, "outdated").when(n == 2, "ugly").alias("reason"),
    )
    return writes.feedback(said)


@query("""WITH policies AS (SELECT c_mktsegment AS owner, CAST(count(*) AS BIGINT) AS version FROM customer GROUP BY 1),
had AS (SELECT DISTINCT c_mktsegment AS owner, c_nationkey % 5 AS rule FROM customer), arrived AS (SELECT DISTINCT owner, CASE WHEN owner < 'C' THEN rule ELSE rule + 1 END AS rule FROM had WHERE owner < 'H'),
was AS (SELECT owner, list_sort(list(rule)) AS w FROM had GROUP BY owner), now AS (SELECT owner, list_sort(list(rule)) AS n FROM arrived GROUP BY owner)
SELECT p.owner, version + CASE WHEN n IS NOT NULL AND n IS DISTINCT FROM w THEN 1 ELSE 0 END AS version FROM policies p LEFT JOIN was USING (owner) LEFT JOIN now USING (owner)""")
def k12_policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "owner")
    rules = customers.select("owner", (F.col("c_nationkey") % 5).alias("rule")).distinct()
    arrived = rules.where("owner < 'H'").select("owner", F.when(F.col("owner") < "C", F.col("rule")).otherwise(F.col("rule") + 1).alias("rule"))
    return writes.replace_policy(customers.groupBy("owner").agg(F.count("*").alias("version")), rules, arrived)[0]


@query("""SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 2 <> 0 AND n_nationkey > 5""")
def k13_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    shaped = lambda rows, name: rows.select(F.col("n_nationkey").alias("key"), name.alias("name"))
    return changes.insert_or_ignore(shaped(nations.where("n_nationkey % 2 = 0"), F.col("n_name")), shaped(nations.where("n_nationkey > 5"), F.lower("n_name")), ["key"])


@query("""SELECT vec_id AS ref, 'current' AS model, label FROM embeddings WHERE vec_id % 4 <> 0 AND vec_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')""")
def k15_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), F.when(F.col("vec_id") % 4 == 0, "retired").otherwise("current").alias("model"), "label")
    return writes.prune(vectors, table(spark, sf_dir, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("ref")), "current")
