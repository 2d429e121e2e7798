"""Queries of reports, queues and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpalith.operators import access, ranking, reports, scope
from corpalith.plans import queries as Q
from corpalith.plans.queries import query
from corpalith.sources.corpus import CATALOGUE_SQL, table

_n = lambda c: F.count(F.when(c, 1))


@query(f"WITH {CATALOGUE_SQL} SELECT kb, doc_id, title, path FROM catalogue WHERE in_index AND kb = 'en'")
def s1_index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._catalogue(spark, sf_dir).where("in_index and kb = 'en'").select("kb", "doc_id", "title", "path").orderBy("doc_id")


@query(f"""WITH {CATALOGUE_SQL}, asked AS (SELECT vec_id AS asked_id FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT -vec_id - 1 FROM embeddings WHERE vec_id % 50 = 0)
SELECT asked_id, CASE WHEN doc_id IS NULL THEN 'not_found' WHEN acl <> 'all-staff' THEN 'forbidden' ELSE 'resolved' END AS outcome, CASE WHEN acl = 'all-staff' THEN md5(text) END AS body
FROM asked LEFT JOIN (SELECT * FROM catalogue WHERE in_store) s ON asked_id = doc_id""")
def s6_batch_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    asked = ids.where("vec_id % 2 = 0").select(F.col("vec_id").alias("asked_id")).union(ids.where("vec_id % 50 = 0").select(-F.col("vec_id") - 1))
    hits = asked.join(Q._catalogue(spark, sf_dir).where("in_store"), F.col("asked_id") == F.col("doc_id"), "left")
    outcome = F.when(F.col("doc_id").isNull(), "not_found").when(access.forbidden([]), "forbidden").otherwise("resolved")
    return hits.select("asked_id", outcome.alias("outcome"), F.when(outcome == "resolved", F.md5("text")).alias("body"))


@query("""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS pieces FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)""")
def j8_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, have = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id")
    pieces = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    return docs.join(have, F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id", pieces.alias("pieces"))


_TERMS = ["the", "and", "der", "la", "policy", "zebra"]


@query(f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents),
terms AS (SELECT unnest([{", ".join(f"'{t}'" for t in _TERMS)}]) AS term)
SELECT term, count(DISTINCT doc_id) AS documents, count(word) AS occurrences FROM terms LEFT JOIN words ON word = term GROUP BY term""")
def j9_term_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.term_use(table(spark, sf_dir, "documents"), spark.createDataFrame([(t,) for t in _TERMS], "term string"))


@query(f"WITH {CATALOGUE_SQL} SELECT kb, count(*) AS visible, CAST(count(*) FILTER (WHERE ({Q._RULE_A}) IS NULL) AS BIGINT) AS in_scope, count(*) FILTER (WHERE age_days IS NULL) > 0.05 * count(*) AS dates_missing FROM catalogue WHERE in_index GROUP BY kb")
def a5_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q._catalogue(spark, sf_dir).where("in_index").groupBy("kb")
    undated = _n(F.col("age_days").isNull())
    return rows.agg(F.count("*").alias("visible"), _n(scope.exclusion_rule(Q.SCOPE_A).isNull()).alias("in_scope"), (undated > F.count("*") * 0.05).alias("dates_missing"))


@query(f"""WITH {CATALOGUE_SQL}, s AS (SELECT {Q._STALE} AS state FROM catalogue WHERE in_index),
m AS (SELECT unnest([{{'metric': 'documents', 'n': count(*)}}, {{'metric': 'missing_dates', 'n': count(*) FILTER (WHERE state = 'unknown_age')}}, {{'metric': 'stale', 'n': count(*) FILTER (WHERE state = 'stale')}}, {{'metric': 'expired', 'n': count(*) FILTER (WHERE state = 'expired')}}]) AS x FROM s)
SELECT x.metric AS metric, CAST(x.n AS BIGINT) AS n, CASE x.metric WHEN 'missing_dates' THEN 'map a date field' WHEN 'stale' THEN 'review' WHEN 'expired' THEN 'archive' END AS action FROM m""")
def a6_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q._catalogue(spark, sf_dir).where("in_index").select(access.staleness(F.col("age_days")).alias("state"))
    actions = {"documents": (None, None), "missing_dates": ("unknown_age", "map a date field"), "stale": ("stale", "review"), "expired": ("expired", "archive")}
    counts = rows.agg(*((F.count("*") if state is None else _n(F.col("state") == state)).alias(name) for name, (state, _) in actions.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(name).alias("n"), F.lit(action).cast("string").alias("action")) for name, (_, action) in actions.items()))))


@query(f"""WITH {CATALOGUE_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE in_store) AS f, count(*) FILTER (WHERE in_store AND acl = 'all-staff') AS r, count(age_days) AS d FROM catalogue WHERE in_index)
SELECT 1 AS check_no, 'index answers' AS name, n > 0 AS passed, n::DOUBLE AS detail FROM c UNION ALL SELECT 2, 'documents resolve', f > 0, f FROM c UNION ALL SELECT 3, 'resolution rate', CASE WHEN f > 0 THEN f / n >= 0.8 END, round(f / n, 4) FROM c
UNION ALL SELECT 4, 'principal can read', CASE WHEN f > 0 THEN r > 0 END, r FROM c UNION ALL SELECT 5, 'documents are dated', CASE WHEN f > 0 THEN d > 0 END, d FROM c""")
def a15_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.probe(Q._catalogue(spark, sf_dir).where("in_index"), ~access.forbidden([]), F.col("in_store"))


_TITLES = "SELECT p_name || CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 11 = 0 THEN ' - Parts' ELSE ' | Parts Desk' END AS title FROM part"


@query(f"WITH t AS ({_TITLES}), s AS (SELECT ' | ' || split_part(title, ' | ', 2) AS suffix FROM t WHERE contains(title, ' | ') UNION ALL SELECT ' - ' || split_part(title, ' - ', 2) FROM t WHERE contains(title, ' - ')), c AS (SELECT suffix, count(*) AS n FROM s GROUP BY suffix ORDER BY n DESC, suffix LIMIT 1) SELECT suffix, n, round(n / (SELECT count(*) FROM t), 4) AS share FROM c WHERE n >= 3 AND n >= 0.7 * (SELECT count(*) FROM t)")
def a19_title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return reports.common_suffix(table(spark, sf_dir, "part").select(F.concat("p_name", F.when(n % 5 == 0, "").when(n % 11 == 0, " - Parts").otherwise(" | Parts Desk")).alias("title")))


@query(f"""WITH {Q._PAIRS}, placed AS (SELECT question_id, doc_id, rank, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM reranked),
summed AS (SELECT question_id, doc_id, round(1.0::DOUBLE / (60 + rerank_rank) + 1.0::DOUBLE / (60 + rank), 6) AS score, CAST(rerank_rank AS INTEGER) AS rerank_rank FROM placed)
SELECT * FROM summed QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rerank_rank) <= 16""")
def v7_second_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen best by the ranks of the channel and of the reranker together."""
    placed = Q._reranked(spark, sf_dir).withColumn("rerank_rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("rerank_score").desc(), "rank")))
    scored = placed.select("question_id", "doc_id", F.round(1 / (60 + F.col("rerank_rank")) + 1 / (60 + F.col("rank")), 6).alias("score"), "rerank_rank")
    best = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc(), "rerank_rank"))
    return scored.withColumn("best", best).where("best <= 16").drop("best")


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, age_days FROM catalogue WHERE in_index ORDER BY age_days DESC NULLS FIRST, doc_id LIMIT 500")
def t6_refresh_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 stalest; those of unknown age come first."""
    return Q._catalogue(spark, sf_dir).where("in_index").select("doc_id", "age_days").orderBy(F.col("age_days").desc_nulls_first(), "doc_id").limit(500)


@query("SELECT page_id, url, CAST(length(url) - length(replace(url, '/', '')) AS INTEGER) AS depth FROM pages ORDER BY depth, length(url), url, page_id LIMIT 500")
def t7_crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 shallowest addresses, the crawl's cap."""
    depth = (F.length("url") - F.length(F.translate("url", "/", ""))).alias("depth")
    return table(spark, sf_dir, "pages").select("page_id", "url", depth).orderBy("depth", F.length("url"), "url", "page_id").limit(500)


@query("""WITH r AS (SELECT lang AS kb, source AS section, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS inside, n_chars FROM documents)
SELECT kb, doc_id, section, CAST(row_number() OVER (PARTITION BY kb ORDER BY inside > 1, n_chars DESC, doc_id) AS INTEGER) AS place FROM r QUALIFY place <= 6""")
def w11_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.spread(table(spark, sf_dir, "documents").select(F.col("lang").alias("kb"), F.col("source").alias("section"), "doc_id", F.col("n_chars").alias("weight")))


@query(f"WITH {Q._LEXICAL} SELECT doc_id, count(*) AS uses, min(question_id) AS first_question FROM lexical GROUP BY doc_id")
def w13_global_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document found by several questions keeps the place of its first."""
    return Q._lexical(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("uses"), F.min("question_id").alias("first_question"))


@query(f"""WITH {Q._LEXICAL}, g AS (SELECT question_id, rank, {Q._GATE} AS d FROM lexical JOIN catalogue USING (doc_id))
SELECT question_id, min(rank) FILTER (WHERE d IS NULL) AS best_kept, min(rank) FILTER (WHERE d IS NOT NULL) AS best_withheld, coalesce(min(rank) FILTER (WHERE d IS NOT NULL) < min(rank) FILTER (WHERE d IS NULL), false) AS notice FROM g GROUP BY question_id""")
def w14_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = Q._lexical(spark, sf_dir).select("question_id", F.col("doc_id").alias("hit"), "rank")
    gated = access.gates(hits.join(Q._catalogue(spark, sf_dir), F.col("hit") == F.col("doc_id")), Q.SCOPE_A, ["hr"], Q.RULES)
    kept, withheld = F.min(F.when(F.col("dropped_by").isNull(), F.col("rank"))), F.min(F.when(F.col("dropped_by").isNotNull(), F.col("rank")))
    return gated.groupBy("question_id").agg(kept.alias("best_kept"), withheld.alias("best_withheld"), F.coalesce(withheld < kept, F.lit(False)).alias("notice"))


@query("SELECT doc_id, arg_min(line, i) AS first_line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def w5_first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.get(lines, F.lit(0)).alias("first_line")).where("first_line is not null")


_IN = "SELECT 'space' AS collection, doc_id FROM documents WHERE source = 'src1' UNION ALL SELECT 'even', doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'french', doc_id FROM documents WHERE lang = 'fr'"


def _collections(docs: DataFrame) -> DataFrame:
    rules = {"space": F.col("source") == "src1", "even": F.col("doc_id") % 2 == 0, "french": F.col("lang") == "fr"}
    return docs.select("doc_id", F.explode(F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())).alias("collection"))


@query(f"WITH m AS ({_IN}), h AS (SELECT doc_id, count(DISTINCT collection) AS n FROM m GROUP BY doc_id) SELECT coalesce(n, 0) AS collections, count(*) AS documents FROM documents LEFT JOIN h USING (doc_id) GROUP BY 1")
def y9_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reports.overlap(_collections(docs), docs.select("doc_id"))


@query(f"WITH m AS ({_IN}) SELECT collection, count(*) AS documents FROM m GROUP BY collection")
def j14_rule_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collections(table(spark, sf_dir, "documents")).groupBy("collection").agg(F.count("*").alias("documents"))


_SENSITIVE = " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in Q.T.SENSITIVE.values())


@query(f"WITH {CATALOGUE_SQL}, r AS (SELECT CASE WHEN NOT in_store THEN 'deleted' WHEN ({Q._RULE_B}) IS NOT NULL THEN 'out_of_scope' WHEN {_SENSITIVE} THEN 'quarantined' ELSE 'effective' END AS state FROM catalogue) SELECT state, count(*) AS documents FROM r GROUP BY state")
def y2_effective_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(~F.col("in_store"), "deleted").when(scope.exclusion_rule(Q.SCOPE_B).isNotNull(), "out_of_scope").when(F.size(Q.T.sensitive_classes(F.col("text"))) > 0, "quarantined").otherwise("effective")
    return Q._catalogue(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("documents"))


@query(f"""WITH {Q._LEXICAL}, wanted AS (SELECT question_id, doc_id FROM lexical WHERE rank IN (1, 7, 15)), top AS (SELECT * FROM lexical WHERE rank <= 10)
SELECT w.question_id, count(*) AS wanted, count(t.rank) AS found, round(count(t.rank) / count(*), 4) AS recall, coalesce(round(1 / min(t.rank), 4), 0.0::DOUBLE) AS reciprocal_rank FROM wanted w LEFT JOIN top t ON t.question_id = w.question_id AND t.doc_id = w.doc_id GROUP BY w.question_id""")
def y11_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = Q._lexical(spark, sf_dir)
    return reports.metrics(top, top.where("rank in (1, 7, 15)").select("question_id", "doc_id"), 10)


@query(f"""WITH {Q._LEXICAL}, g AS (SELECT question_id, doc_id, {Q._GATE} AS d FROM lexical JOIN catalogue USING (doc_id))
SELECT question_id, list_sort(list(doc_id) FILTER (WHERE d IS NULL)) AS returned, list_sort(list(doc_id) FILTER (WHERE d IS NOT NULL)) AS refused FROM g GROUP BY question_id""")
def y13_retrieval_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists are of one question's hits, of which the channel gives twenty."""
    hits = Q._lexical(spark, sf_dir).select("question_id", F.col("doc_id").alias("hit"))
    gated = access.gates(hits.join(Q._catalogue(spark, sf_dir), F.col("hit") == F.col("doc_id")), Q.SCOPE_A, ["hr"], Q.RULES)
    ids = lambda c: F.when(F.count(F.when(c, 1)) > 0, F.array_sort(F.collect_list(F.when(c, F.col("hit")))))
    return gated.groupBy("question_id").agg(ids(F.col("dropped_by").isNull()).alias("returned"), ids(F.col("dropped_by").isNotNull()).alias("refused"))


@query(f"""WITH {Q._LEXICAL}, f AS (SELECT kb, question_id, doc_id, row_number() OVER (PARTITION BY kb, question_id ORDER BY score DESC, doc_id) AS r FROM lexical JOIN catalogue USING (doc_id))
SELECT question_id, doc_id, round(1.0::DOUBLE / (60 + r), 6) AS score, CAST(1 AS BIGINT) AS channels, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(1.0::DOUBLE / (60 + r), 6) DESC, doc_id) AS INTEGER) AS rank FROM f""")
def y3_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every connector ranks its own hits; the ranks are fused."""
    hits = Q._lexical(spark, sf_dir).select("question_id", "doc_id", "score").join(Q._catalogue(spark, sf_dir).select("doc_id", "kb"), "doc_id")
    own = F.row_number().over(Window.partitionBy("kb", "question_id").orderBy(F.col("score").desc(), "doc_id"))
    return ranking.fuse(hits.select("question_id", F.col("kb").alias("channel"), "doc_id", own.alias("rank")))
