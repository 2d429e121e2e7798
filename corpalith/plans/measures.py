"""Queries that count, rank, compare and select: reports, candidates, set operations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpalith.functions import answers as A
from corpalith.functions import text as T
from corpalith.functions import urls as U
from corpalith.operators import access, ranking
from corpalith.plans import queries as Q
from corpalith.plans.queries import _strings, query
from corpalith.plans.store import _LINES, _PATH, _chunks
from corpalith.sources.corpus import CATALOGUE_SQL, table

_n = lambda c: F.count(F.when(c, 1))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id")
def a8_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("chunks")).where("chunks > 0")


@query(f"WITH {_LINES} SELECT doc_id, md5(string_agg(line, ' ' ORDER BY ordinal) FILTER (WHERE NOT contains(line, chr(123)))) AS digest FROM chunks GROUP BY doc_id")
def a9_joined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a document that hold no code, in order."""
    held = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    prose = F.filter(held, lambda x: ~F.contains(x, F.lit("{")))
    return table(spark, sf_dir, "documents").where(F.size(held) > 0).select("doc_id", F.md5(F.when(F.size(prose) > 0, F.array_join(prose, " "))).alias("digest"))


@query("SELECT t AS term, count(DISTINCT doc_id) AS documents, CAST(sum((length(text) - length(replace(text, t, ''))) / length(t)) AS BIGINT) AS occurrences FROM documents, (VALUES ('the'), ('tion'), ('ing'), ('Zebra')) v(t) WHERE contains(text, t) GROUP BY t")
def a10_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences by what a text loses when a term is taken out; all terms in one pass over the texts."""
    terms = F.array(*map(F.lit, ("the", "tion", "ing", "Zebra")))
    cells = F.transform(terms, lambda t: F.struct(t.alias("term"), ((F.length("text") - F.length(F.replace(F.col("text"), t, F.lit("")))) / F.length(t)).cast("long").alias("n")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(cells)).where("n > 0").groupBy("term").agg(F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("occurrences"))


@query("SELECT source AS space, list_sort(list(DISTINCT lang)) AS langs FROM documents WHERE lang IS NOT NULL GROUP BY source")
def a11_distinct_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each space: a set as large as the number of languages."""
    return table(spark, sf_dir, "documents").where("lang is not null").groupBy(F.col("source").alias("space")).agg(F.array_sort(F.collect_set("lang")).alias("langs"))


_CASES = "cases AS (SELECT conv_id % 7 AS run, conv_id, CASE WHEN turn % 5 = 4 THEN 'errored' WHEN contains(text, 'the') THEN 'passed' ELSE 'failed' END AS result FROM conversations WHERE role = 'assistant')"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("turn") % 5 == 4, "errored").when(F.contains("text", F.lit("the")), "passed").otherwise("failed")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") % 7).alias("run"), "conv_id", result.alias("result"))


@query(f"WITH {_CASES} SELECT run, count(*) AS cases, CAST(count(*) FILTER (WHERE result = 'passed') AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE result = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE result = 'errored') AS BIGINT) AS errored FROM cases GROUP BY run")
def a13_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("result")
    return _cases(spark, sf_dir).groupBy("run").agg(F.count("*").alias("cases"), _n(r == "passed").alias("passed"), _n(r == "failed").alias("failed"), _n(r == "errored").alias("errored"))


@query(f"WITH {CATALOGUE_SQL} SELECT space AS collection, count(*) AS members, CAST(count(*) FILTER (WHERE doc_id % 11 = 0) AS BIGINT) AS proposed, CAST(count(*) FILTER (WHERE NOT in_store) AS BIGINT) AS removed, CAST(count(*) FILTER (WHERE age_days IS NULL) AS BIGINT) AS undated, CAST(count(*) FILTER (WHERE doc_id % 13 = 0 AND in_store) AS BIGINT) AS never_checked FROM catalogue GROUP BY space")
def a14_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    counts = {"proposed": n % 11 == 0, "removed": ~F.col("in_store"), "undated": F.col("age_days").isNull(), "never_checked": (n % 13 == 0) & F.col("in_store")}
    return Q._catalogue(spark, sf_dir).groupBy(F.col("space").alias("collection")).agg(F.count("*").alias("members"), *(_n(c).alias(name) for name, c in counts.items()))


@query(f"WITH {Q._LEXICAL}, g AS (SELECT question_id, {Q._GATE} AS d FROM lexical JOIN catalogue USING (doc_id)), t AS (SELECT question_id, count(*) FILTER (WHERE d = 'stale_index') AS s, count(*) FILTER (WHERE d = 'forbidden') AS f, count(*) AS n FROM g GROUP BY question_id) SELECT question_id % 10 AS batch, count(*) AS traces, CAST(sum(s) AS BIGINT) AS stale, CAST(sum(f) AS BIGINT) AS forbidden, round(avg(s / n), 6) AS stale_rate FROM t GROUP BY 1")
def a16_index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of many questions merged: sums of what was left out, and the mean of their rates."""
    hits = Q._lexical(spark, sf_dir).select("question_id", F.col("doc_id").alias("hit"))
    gated = access.gates(hits.join(Q._catalogue(spark, sf_dir), F.col("hit") == F.col("doc_id")), Q.SCOPE_A, ["hr"], Q.RULES)
    d = F.col("dropped_by")
    traces = gated.groupBy("question_id").agg(_n(d == "stale_index").alias("s"), _n(d == "forbidden").alias("f"), F.count("*").alias("n"))
    return traces.groupBy((F.col("question_id") % 10).alias("batch")).agg(F.count("*").alias("traces"), F.sum("s").alias("stale"), F.sum("f").alias("forbidden"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("stale_rate"))


_SUFFIXED = "SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' - Depot' WHEN 1 THEN ' – Depot' ELSE '' END AS title, p_partkey // 4 AS answer FROM part"


@query(f"WITH t AS ({_SUFFIXED}), s AS (SELECT answer, regexp_extract(title, '\\s[-–|]\\s([^-–|]+)$', 1) AS suffix FROM t) SELECT answer, suffix, count(*) AS n FROM s WHERE suffix <> '' GROUP BY ALL HAVING count(*) >= 2")
def a20_shared_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ending after a dash that two or more of an answer's titles share."""
    n = F.col("p_partkey")
    title = F.concat("p_name", F.when(n % 3 == 0, " - Depot").when(n % 3 == 1, " – Depot").otherwise(""))
    rows = table(spark, sf_dir, "part").select(F.floor(n / 4).alias("answer"), F.regexp_extract(title, r"\s[-–|]\s([^-–|]+)$", 1).alias("suffix"))
    return rows.where("suffix <> ''").groupBy("answer", "suffix").agg(F.count("*").alias("n")).where("n >= 2")


@query("""WITH s AS (SELECT lang AS kb, source AS section, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY kb ORDER BY n DESC, section) AS nth FROM s),
t AS (SELECT lang AS kb, count(*) AS total FROM documents GROUP BY lang) SELECT t.kb, 'This covers ' || total || ' documents, most of them in ' || string_agg(section, ', ' ORDER BY nth) || '.' AS overview FROM t JOIN r ON t.kb = r.kb WHERE nth <= 3 GROUP BY t.kb, total""")
def a22_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence on each connector: how many documents, and its three largest sections."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("kb"), F.col("source").alias("section"))
    sections = docs.groupBy("kb", "section").agg(F.count("*").alias("n")).where("n > 1")
    top = sections.withColumn("nth", F.row_number().over(Window.partitionBy("kb").orderBy(F.col("n").desc(), "section"))).where("nth <= 3")
    named = top.groupBy("kb").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "section"))), lambda x: x["section"]), ", ").alias("named"))
    total = docs.groupBy(F.col("kb").alias("k")).agg(F.count("*").alias("total"))
    return named.join(total, F.col("kb") == F.col("k")).select("kb", F.format_string("This covers %d documents, most of them in %s.", "total", "named").alias("overview"))


@query("SELECT event_type, CAST(count(*) FILTER (WHERE nth > 1) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE nth = 1) AS BIGINT) AS misses, round(count(*) FILTER (WHERE nth > 1) / count(*), 6) AS rate FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS nth FROM events) GROUP BY event_type")
def a24_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache without a bound: the first read of a key misses and every later one hits, so counts by key are enough."""
    keys = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg((F.count("*") - 1).alias("later"))
    return keys.groupBy("event_type").agg(F.sum("later").alias("hits"), F.count("*").alias("misses"), F.round(F.sum("later") / (F.sum("later") + F.count("*")), 6).alias("rate"))


@query(f"WITH {Q._LEXICAL} SELECT question_id, doc_id, rank, round(1.0::DOUBLE / (60 + rank), 6) AS share FROM lexical")
def w1_channel_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._lexical(spark, sf_dir).select("question_id", "doc_id", "rank", F.round(1 / (60 + F.col("rank")), 6).alias("share"))


@query(f"WITH {_LINES}, s AS (SELECT doc_id, ordinal, length(line) - length(replace(line, ' ', '')) AS words FROM chunks) SELECT doc_id, ordinal, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, ordinal) AS INTEGER) AS nth FROM s QUALIFY nth <= 3")
def w2_best_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best chunks of each document, ties by their order, without a shuffle: a document's chunks are one array."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    scored = F.transform(lines, lambda x, i: F.struct((F.length(F.replace(x, F.lit(" "), F.lit(""))) - F.length(x)).alias("less"), i.alias("ordinal")))
    best = F.slice(F.array_sort(scored), 1, 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(best).alias("at", "x")).select("doc_id", F.col("x.ordinal").alias("ordinal"), (F.col("at") + 1).alias("nth"))


@query(f"WITH {Q._PAIRS} SELECT question_id, doc_id, rank FROM pairs QUALIFY row_number() OVER (PARTITION BY question_id, array_to_string(regexp_extract_all(lower(passage), '[a-z0-9]+'), ' ') ORDER BY rank) = 1")
def w3_collapsed_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hits with the same words the best ranked stays."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("same"))
    rows = Q._lexical(spark, sf_dir).select("question_id", "doc_id", "rank").join(words, F.col("doc_id") == F.col("d"))
    return rows.groupBy("question_id", "same").agg(F.min(F.struct("rank", "doc_id")).alias("x")).select("question_id", "x.doc_id", "x.rank")


@query(f"WITH {Q._PAIRS} SELECT question_id, doc_id, rank, rerank_score FROM reranked QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rank) <= 16")
def t5_shortlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("rerank_score").desc(), "rank"))
    return Q._reranked(spark, sf_dir).withColumn("best", best).where("best <= 16").select("question_id", "doc_id", "rank", "rerank_score")


@query(f"WITH p AS (SELECT page_id, {Q._HOST} AS host, {_PATH} AS path FROM pages WHERE url IS NOT NULL), c AS (SELECT host, page_id, CASE WHEN page_id % 3 = 0 THEN 1.0 WHEN page_id % 3 = 1 THEN 0.85 ELSE 0.6 END::DOUBLE AS score FROM p) SELECT host, page_id, score, CAST(row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS INTEGER) AS nth FROM c QUALIFY nth <= 5")
def t8_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 3
    rows = table(spark, sf_dir, "pages").where("url is not null").select(U.host(F.col("url")).alias("host"), "page_id", F.when(n == 0, 1.0).when(n == 1, 0.85).otherwise(0.6).alias("score"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy(F.col("score").desc(), "page_id"))).where("nth <= 5")


@query("SELECT word AS term, documents, round(0.4::DOUBLE + least(0.1::DOUBLE, documents * 0.02::DOUBLE), 4) AS confidence FROM (SELECT word, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM documents) WHERE regexp_full_match(word, '[A-Z][a-z]{3,5}') GROUP BY word) WHERE documents >= 3 ORDER BY confidence DESC, documents DESC, term LIMIT 60")
def t9_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty proposals that a reviewer sees first, the report's cap."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w.rlike(r"\A[A-Z][a-z]{3,5}\z")))).alias("term"))
    rows = words.groupBy("term").agg(F.count("*").alias("documents")).where("documents >= 3")
    rows = rows.withColumn("confidence", F.round(0.4 + F.least(F.lit(0.1), F.col("documents") * 0.02), 4))
    return rows.orderBy(F.col("confidence").desc(), F.col("documents").desc(), "term").limit(60)


@query("SELECT conv_id, turn, length(text) AS size FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') ORDER BY size DESC NULLS LAST, conv_id, turn LIMIT 50".replace("length(text) AS size", "CAST(length(text) AS INTEGER) AS size"))
def t11_longest_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as a page shows it: fifty rows, ordered with every tie settled."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.length("text").alias("size")).orderBy(F.col("size").desc_nulls_last(), "conv_id", "turn").limit(50)


@query("SELECT event_type AS kind, arg_min(event_id, (ts, event_id)) AS job FROM events WHERE user_id % 3 <> 0 GROUP BY event_type")
def t12_next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest runnable job of each kind."""
    return table(spark, sf_dir, "events").where("user_id % 3 <> 0").groupBy(F.col("event_type").alias("kind")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("job"))


@query(f"WITH {CATALOGUE_SQL}, r AS (SELECT doc_id, list_filter([CASE WHEN space = 'src0' THEN 'space' END, CASE WHEN list_contains(labels, 'approved') THEN 'label' END, CASE WHEN starts_with(path, '/src1/de/') THEN 'path' END], lambda x: x IS NOT NULL) AS rules, kb IS NOT DISTINCT FROM 'fr' AS gone FROM catalogue) SELECT doc_id, rules FROM r WHERE len(rules) > 0 AND NOT gone")
def u1_rule_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any rule takes in, with all rules that did, less what an exclusion names."""
    rules = {"space": F.col("space") == "src0", "label": F.array_contains("labels", "approved"), "path": F.col("path").startswith("/src1/de/")}
    by = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return Q._catalogue(spark, sf_dir).where("kb <> 'fr' or kb is null").select("doc_id", by.alias("rules")).where(F.size("rules") > 0)


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN [page_id] WHEN page_id % 3 = 1 AND url IS NOT NULL THEN [page_id, page_id + 1] ELSE [-1] END AS found FROM pages")
def u2_first_of_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rung that finds something; lower rungs don't add to it."""
    n = F.col("page_id")
    empty = F.array().cast("array<bigint>")
    rungs = [F.when(n % 3 == 0, F.array(n)).otherwise(empty), F.when((n % 3 == 1) & F.col("url").isNotNull(), F.array(n, n + 1)).otherwise(empty), F.array(F.lit(-1).cast("long"))]
    return table(spark, sf_dir, "pages").select("page_id", F.get(F.filter(F.array(*rungs), lambda x: F.size(x) > 0), F.lit(0)).alias("found"))


@query("SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) n ON o.doc_id = n.doc_id")
def u3_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    old, new = ids.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("o")), ids.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept")
    return old.join(new, F.col("o") == F.col("n"), "full").select(F.coalesce("o", "n").alias("doc_id"), change.alias("change"))


@query(f"WITH {Q._LEXICAL}, recent AS (SELECT item_id AS question_id, item_id * 3 % 50 AS doc_id, 1 AS rank FROM benchmark) SELECT question_id, doc_id, list_sort(list(channel)) AS channels FROM (SELECT question_id, doc_id, 'lexical' AS channel FROM lexical UNION ALL SELECT question_id, doc_id, 'recent' FROM recent) GROUP BY question_id, doc_id")
def u4_channel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all channels with the channels that found them, of which there are two."""
    lexical = Q._lexical(spark, sf_dir).select("question_id", "doc_id", F.lit("lexical").alias("channel"))
    recent = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") * 3 % 50).alias("doc_id"), F.lit("recent").alias("channel"))
    return lexical.union(recent).groupBy("question_id", "doc_id").agg(F.array_sort(F.collect_list("channel")).alias("channels"))


_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


@query(f"WITH p AS (SELECT a.conv_id, a.turn, {_WORDS('a.text')} AS x, {_WORDS('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, CAST(len(list_intersect(x, y)) AS INTEGER) AS shared, round(len(list_intersect(x, y)) / greatest(1, len(list_distinct(list_concat(x, y)))), 6) AS jaccard, round(len(list_intersect(x, y)) / greatest(1, len(x)), 6) AS coverage FROM p")
def u5_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each turn's words are in the next one's."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("x"))
    after = turns.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("x").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    rows = turns.join(after, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")))
    return rows.select("conv_id", "turn", shared.alias("shared"), F.round(shared / F.greatest(F.lit(1), F.size(F.array_union("x", "y"))), 6).alias("jaccard"), F.round(shared / F.greatest(F.lit(1), F.size("x")), 6).alias("coverage"))


@query("WITH w AS (SELECT doc_id, regexp_split_to_array(trim(text), '\\s+') AS w FROM documents) SELECT doc_id, array_to_string(list_slice(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), 1, 20), ' ') AS firsts FROM w")
def u6_first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty different words in their order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(F.split(F.trim(F.regexp_replace("text", r"\A\s+|\s+\z", "")), r"\s+")), 1, 20), " ").alias("firsts"))


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_NORMED = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"SELECT a.vec_id, round(CASE WHEN a.vec_id % 9 = 0 THEN 0.0::DOUBLE ELSE {_DOT} / ({_NORMED.format('a')} * {_NORMED.format('b')}) END, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v2_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of neighbours; a vector of zeros gives 0."""
    zero = F.when(F.col("vec_id") % 9 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    a = table(spark, sf_dir, "embeddings").select("vec_id", zero.alias("x"))
    b = table(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("v"), F.col("embedding").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, i: s + i)
    cosine = F.coalesce(F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))), F.lit(0.0))
    return a.join(b, F.col("vec_id") == F.col("v")).select("vec_id", F.round(cosine, 6).alias("cosine"))


@query(f"WITH c AS (SELECT a.vec_id, {_DOT} / ({_NORMED.format('a')} * {_NORMED.format('b')}) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 10) SELECT vec_id, round((cos + 1) / 2, 6) AS score, CAST(row_number() OVER (PARTITION BY vec_id - vec_id % 10 ORDER BY round((cos + 1) / 2, 6) DESC, vec_id) AS INTEGER) AS rank FROM c")
def r2_bi_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages ranked by their own vectors against their question's: (cosine + 1) / 2."""
    lead = F.col("vec_id") - F.col("vec_id") % 10
    rows = table(spark, sf_dir, "embeddings").select("vec_id", lead.alias("lead"), F.col("embedding").alias("x"))
    asked = rows.where("vec_id = lead").select(F.col("vec_id").alias("q"), F.col("x").alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, i: s + i)
    cosine = F.coalesce(F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))), F.lit(0.0))
    scored = rows.join(asked, F.col("lead") == F.col("q")).select("vec_id", "lead", F.round((cosine + 1) / 2, 6).alias("score"))
    return scored.select("vec_id", "score", F.row_number().over(Window.partitionBy("lead").orderBy(F.col("score").desc(), "vec_id")).alias("rank"))


@query(f"WITH {Q._LEXICAL} SELECT question_id, doc_id, round(CASE WHEN question_id % 4 = 0 THEN 1.0::DOUBLE / rank ELSE score END, 6) AS score, question_id % 4 = 0 AS degraded FROM lexical")
def r6_fallback_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a reranker failed, the pool's order gives the scores, and the answer says so."""
    failed = F.col("question_id") % 4 == 0
    return Q._lexical(spark, sf_dir).select("question_id", "doc_id", F.round(F.when(failed, 1 / F.col("rank")).otherwise(F.col("score")), 6).alias("score"), failed.alias("degraded"))


@query(f"WITH {Q._PAIRS} SELECT question_id, doc_id, CASE WHEN question_id % 3 = 0 THEN rank ELSE CAST(row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rank) AS INTEGER) END AS place FROM reranked")
def v8_index_order_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the index says that it ranked and no reranker was chosen, its order stays."""
    own = F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("rerank_score").desc(), "rank"))
    return Q._reranked(spark, sf_dir).select("question_id", "doc_id", F.when(F.col("question_id") % 3 == 0, F.col("rank")).otherwise(own).alias("place"))


@query(f"WITH {Q._LEXICAL}, h AS (SELECT question_id, {Q._GATE} AS d FROM lexical JOIN catalogue USING (doc_id)), c AS (SELECT question_id, count(*) AS n, count(*) FILTER (WHERE d IS NULL) AS kept FROM h GROUP BY question_id) SELECT item_id AS question_id, CASE WHEN item_id % 9 = 0 THEN 'connector_inactive' WHEN n IS NULL THEN 'no_candidates' WHEN kept = 0 THEN 'all_dropped' WHEN kept < 3 THEN 'too_few' END AS refusal FROM benchmark LEFT JOIN c ON question_id = item_id")
def v11_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason for which a question gets no answer, in fixed order."""
    hits = Q._lexical(spark, sf_dir).select("question_id", F.col("doc_id").alias("hit"))
    gated = access.gates(hits.join(Q._catalogue(spark, sf_dir), F.col("hit") == F.col("doc_id")), Q.SCOPE_A, ["hr"], Q.RULES)
    counts = gated.groupBy(F.col("question_id").alias("q")).agg(F.count("*").alias("n"), _n(F.col("dropped_by").isNull()).alias("kept"))
    refusal = F.when(F.col("question_id") % 9 == 0, "connector_inactive").when(F.col("n").isNull(), "no_candidates").when(F.col("kept") == 0, "all_dropped").when(F.col("kept") < 3, "too_few")
    return Q._questions(spark, sf_dir).join(counts, F.col("question_id") == F.col("q"), "left").select("question_id", refusal.alias("refusal"))


_SLUG = "array_to_string(regexp_extract_all(lower(substring(regexp_extract(text, '^[^.!?]*'), 1, 80)), '[a-z0-9]+'), '-')"


@query(f"WITH s AS (SELECT doc_id, {_SLUG} AS slug FROM documents) SELECT doc_id, first FROM (SELECT doc_id, slug, min(doc_id) OVER (PARTITION BY slug) AS first FROM s) WHERE slug <> '' AND first < doc_id")
def v13_upload_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads whose title's slug is already there: the first by id of each slug, counted once and joined."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.slug(T.first_sentence(F.col("text"), 80)).alias("slug")).where("slug <> ''")
    firsts = rows.groupBy(F.col("slug").alias("s")).agg(F.min("doc_id").alias("first"))
    return rows.join(firsts, F.col("slug") == F.col("s")).where("first < doc_id").select("doc_id", "first")


_RUNS = "list_distinct(list_transform(range(1, greatest(2, len({0}) - k + 2)), lambda i: array_to_string({0}[i:i + k - 1], ' ')))"


@query(f"""WITH p AS (SELECT a.doc_id, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS x, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
k AS (SELECT *, CASE WHEN least(len(x), len(y)) < 2 THEN 1 WHEN least(len(x), len(y)) < 12 THEN 2 WHEN least(len(x), len(y)) < 40 THEN 3 ELSE 5 END AS k FROM p),
s AS (SELECT doc_id, x, y, CASE WHEN len(x) = 0 THEN [] ELSE {_RUNS.format('x')} END AS sx, CASE WHEN len(y) = 0 THEN [] ELSE {_RUNS.format('y')} END AS sy FROM k)
SELECT doc_id, CASE WHEN len(x) + len(y) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(sx, sy)) / len(list_distinct(list_concat(sx, sy))), 4) END AS similarity FROM s""")
def v14_neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared word shingles of each document and the next one."""
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("a")).join(docs.select((F.col("doc_id") - 1).alias("d"), F.col("text").alias("b")), F.col("doc_id") == F.col("d"))
    return ranking.similarity(pairs, "a", "b").select("doc_id", "similarity")


@query("SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '([.!?:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS sentences FROM conversations WHERE NOT contains(text, chr(10))")
def x18_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one line cut at the ends of sentences."""
    parts = F.transform(A.sentences(F.col("text")), lambda s: F.regexp_replace(s, r"\s+\z", ""))
    rows = table(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("\n")))
    return rows.select("conv_id", "turn", F.filter(parts, lambda s: s != "").alias("sentences"))


_MARKED = "text || ' [' || (turn + 1) || '] [page] [d' || (conv_id % 4) || ']' || CASE WHEN conv_id % 3 = 0 THEN ' NOT_IN_CORPUS' ELSE '' END"


@query(f"WITH s AS (SELECT conv_id, turn, {_MARKED} AS said FROM conversations) SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(said, '\\[(\\d{{1,2}})\\]', 1), lambda x: CAST(x AS INTEGER))) = [turn + 1] AS own, regexp_matches(said, '(?i)\\[page\\]') AS page, list_transform(regexp_extract_all(said, '(?i)\\[d(\\d{{1,2}})\\]', 1), lambda x: CAST(x AS INTEGER)) AS points, contains(said, 'NOT_IN_CORPUS') AS absent FROM s")
def x20_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers of passages, the page and data points in an answer, and whether it says that the corpus has none."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_MARKED).alias("said"))
    points = F.transform(F.regexp_extract_all("said", F.lit(r"(?i)\[d(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))
    return said.select("conv_id", "turn", (A.cited(F.col("said")) == F.array((F.col("turn") + 1).cast("int"))).alias("own"), F.col("said").rlike(A.PAGE_MARKER).alias("page"), points.alias("points"), F.contains("said", F.lit("NOT_IN_CORPUS")).alias("absent"))


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents), h AS (SELECT *, substring(t, 1, 1200) AS head, instr(reverse(substring(t, 1, 1200)), ' ') AS gap FROM c)
SELECT doc_id, md5(CASE WHEN length(t) <= 1200 THEN t WHEN gap BETWEEN 1 AND 200 THEN substring(head, 1, length(head) - gap) ELSE head END) AS digest, length(t) > 1200 AS truncated FROM h""")
def x23_page_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", A.page_context(F.col("text")).alias("p")).select("doc_id", F.md5("p.text").alias("digest"), "p.truncated")


_GENERIC = ("home", "index", "introduction", "welcome", "overview", "contents", "table of contents", "documentation", "docs", "help", "help centre", "help center")


@query(f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN ' Overview ' WHEN doc_id % 10 = 1 THEN '' ELSE substring(regexp_extract(text, '^[^.!?]*'), 1, 80) END AS title FROM documents) SELECT doc_id, title FROM t WHERE trim(title) <> '' AND lower(trim(title)) NOT IN ({_strings(_GENERIC)}) AND length(trim(title)) <= 48")
def x25_starter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that name something and fit on a chip."""
    title = F.when(F.col("doc_id") % 10 == 0, " Overview ").when(F.col("doc_id") % 10 == 1, "").otherwise(T.first_sentence(F.col("text"), 80))
    rows = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))
    return rows.where((F.trim("title") != "") & ~F.lower(F.trim("title")).isin(*_GENERIC) & (F.length(F.trim("title")) <= 48))


@query(f"WITH {Q._LEXICAL}, a AS (SELECT question_id, doc_id, age_days, title FROM lexical JOIN catalogue USING (doc_id) WHERE rank <= 3) SELECT question_id, max(age_days) AS oldest, arg_min(doc_id, (-age_days, doc_id)) AS doc_id, CAST(count(*) FILTER (WHERE age_days >= 365) AS BIGINT) AS stale FROM a WHERE age_days IS NOT NULL GROUP BY question_id HAVING max(age_days) >= 365")
def x28_age_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the cited documents the oldest, where it is a year old or more."""
    ages = Q._catalogue(spark, sf_dir).where("age_days is not null").select(F.col("doc_id").alias("d"), "age_days")
    rows = Q._lexical(spark, sf_dir).where("rank <= 3").join(ages, F.col("doc_id") == F.col("d"))
    found = rows.groupBy("question_id").agg(F.max("age_days").alias("oldest"), F.min_by("doc_id", F.struct(-F.col("age_days"), "doc_id")).alias("doc_id"), _n(F.col("age_days") >= 365).alias("stale"))
    return found.where("oldest >= 365")


@query("""SELECT doc_id, md5('{"chars":' || n_chars || ',"id":' || doc_id || ',"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE '"' || lang || '"' END || '}') AS hash FROM documents""")
def x30_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order, no blanks, nulls written out: the same settings hash alike."""
    body = F.to_json(F.struct(F.col("n_chars").alias("chars"), F.col("doc_id").alias("id"), "lang"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(body).alias("hash"))


@query("WITH c AS (SELECT event_type AS kind, count(*) AS total, count(*) FILTER (WHERE user_id % 4 <> 0) AS done, date_diff('second', min(ts), max(ts)) AS took FROM events GROUP BY event_type) SELECT kind, round(done / took, 6) AS rate, round((total - done) / (done / took), 2) AS eta FROM c WHERE done > 0 AND took > 0")
def x31_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages a second so far, and seconds to go."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    took = F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))
    rows = events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("total"), _n(F.col("user_id") % 4 != 0).alias("done"), took.alias("took")).where("done > 0 and took > 0")
    rate = F.col("done") / F.col("took")
    return rows.select("kind", F.round(rate, 6).alias("rate"), F.round((F.col("total") - F.col("done")) / rate, 2).alias("eta"))


_VECTOR_SCORES = f"SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / ({_NORMED.format('v')} * {_NORMED.format('q')}), 6) AS score FROM embeddings v JOIN embeddings q ON v.vec_id <> q.vec_id"


@query(f"WITH s AS ({_VECTOR_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, score > 0.72 AS duplicate FROM r WHERE rank <= 3")
def t10_duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of each upload, and whether they are near enough to be shown as duplicates."""
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.knn(vectors, vectors, 3).select("query_id", "vec_id", "score", (F.col("score") > 0.72).alias("duplicate"))


@query(f"WITH x AS ({Q._X13 % Q._URL}) SELECT coalesce(rung, 'none') AS rung, outcome, count(*) AS keys FROM x GROUP BY ALL")
def j13_ladder_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pasted addresses each rung settles; a lower rung is asked only where the ones above found nothing."""
    rows = Q.x13_resolved_urls(spark, sf_dir)
    return rows.groupBy(F.coalesce("rung", F.lit("none")).alias("rung"), "outcome").agg(F.count("*").alias("keys"))
