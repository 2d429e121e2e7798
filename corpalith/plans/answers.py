"""Queries on questions and answers. Where the tables lack what is looked for, it is planted in their texts, and the SQL states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpalith.functions import answers as A
from corpalith.functions import urls as U
from corpalith.operators import embedding, glossary, mapping
from corpalith.plans.queries import _declines, _strings, query
from corpalith.sources.corpus import table

_PREFIX = "['How do I ', 'Compare and ', 'What is on screen here: ', 'Tell me '][CAST(conv_id % 4 AS INTEGER) + 1]"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.element_at(F.array(*map(F.lit, ("How do I ", "Compare and ", "What is on screen here: ", "Tell me "))), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(start, "text").alias("question"))


_LOW = f"SELECT conv_id, turn, lower({_PREFIX} || text) AS q FROM conversations WHERE role = 'user'"
_ANY = lambda words, test: "(" + " OR ".join(f"{test}(q, '{w}')" for w in words) + ")"


@query(f"""WITH a AS ({_LOW}), p AS (SELECT *, ' ' || regexp_replace(q, '[^a-z0-9]+', ' ', 'g') || ' ' AS padded FROM a)
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN false ELSE regexp_matches(padded, ' ({"|".join(A.DEICTIC)}) ') OR conv_id % 3 = 0 END AS live FROM p""")
def f17_live_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("conv_id") % 5 != 0, "k-1")
    return _asked(spark, sf_dir).select("conv_id", "turn", A.fetches_live(F.col("question"), key, F.col("conv_id") % 3 != 0).alias("live"))


@query(f"WITH a AS ({_LOW}) SELECT conv_id, turn, NOT {_ANY(A.RESEARCH, 'contains')} AND (len(regexp_split_to_array(trim(q), '\\s+')) <= 7 OR {_ANY(A.SINGLE, 'starts_with')}) AS single FROM a")
def f21_single_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", A.single_shot(F.col("question")).alias("single"))


@query("SELECT page_id, url IS NULL OR regexp_extract(url, '^[a-z]+://[^/?#]+') IN ('https://a.example.com', 'http://b.example.org') AS allowed FROM pages")
def f19_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("url").isNotNull(), F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0))
    return table(spark, sf_dir, "pages").select("page_id", A.origin_allowed(origin, ["https://a.example.com", "http://b.example.org"]).alias("allowed"))


_UPLOAD = "CASE WHEN page_id % 7 = 0 THEN chr(1) || 'BIN' || substring(url, 1, 20) WHEN page_id % 7 = 1 THEN '' WHEN page_id % 7 = 2 THEN '%PDF-1.7 ' || chr(2) ELSE html END"


@query(f"""WITH u AS (SELECT page_id, {_UPLOAD} AS body FROM pages) SELECT page_id, CASE WHEN strlen(body) = 0 THEN 'empty' WHEN strlen(body) > 2000 THEN 'too_large'
  WHEN NOT (starts_with(body, '%PDF-') OR regexp_matches(substring(body, 1, 2048), '(?i)<(!doctype|html|head|body)\\b') OR NOT regexp_matches(substring(body, 1, 2048), '[\\x00-\\x08\\x0E-\\x1F]')) THEN 'unsupported_format' END AS refusal FROM u""")
def f25_upload_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as uploads, some of them empty, binary or PDF."""
    body = F.expr(_UPLOAD)
    return table(spark, sf_dir, "pages").select("page_id", A.upload_refusal(F.octet_length(body), F.substring(body, 1, 2048), 2000).alias("refusal"))


_CHUNK = "CASE WHEN doc_id % 2 = 0 THEN '## ' || substring(text, 1, 20 + doc_id % 30) || chr(10) || chr(10) || text ELSE text END"


@query(f"SELECT doc_id, substring(trim(regexp_replace(c, '^\\s*#[^\\n]*\\n+', '')), 1, 600) AS span FROM (SELECT doc_id, {_CHUNK} AS c FROM documents)")
def m9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second document stands under a heading made of its own words."""
    return table(spark, sf_dir, "documents").select("doc_id", A.span(F.expr(_CHUNK.replace("chr(10)", "char(10)"))).alias("span"))


_PROSE = "'See ' || url || '. (' || replace(url, 'http:', 'https:') || '), \"' || url || '\"! ' || html"


@query(f"""SELECT page_id, list_transform(list_filter(list_zip(u, range(1, len(u) + 1)), lambda x: list_position(u, x[1]) = x[2]), lambda x: x[1]) AS urls
  FROM (SELECT page_id, list_transform(regexp_extract_all({_PROSE}, 'https?://[^\\s<>"'')\\]}}]+'), lambda x: regexp_replace(x, '[.,;:!?]+$', '')) AS u FROM pages)""")
def x12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's own address as prose writes it, and whatever addresses the page holds."""
    return table(spark, sf_dir, "pages").select("page_id", U.extract(F.expr(_PROSE)).alias("urls"))


@query("SELECT doc_id, substring(text, CAST(greatest(instr(lower(text), 'the') - 60, 1) AS INTEGER), 180) AS snippet FROM documents")
def x15_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", A.snippet(F.col("text"), F.lit("the")).alias("snippet"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM pages")
def x16_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(A.strip_tags(F.col("html"))).alias("digest"))


_SAID = "'It says ' || coalesce(nullif(regexp_extract(text, '[0-9][0-9,]*'), ''), 'none') || ' [page]. ' || CASE doc_id % 3 WHEN 0 THEN 'There are ' || n_chars || ' [d1].' WHEN 1 THEN 'In all ' || n_chars || ' [2].' ELSE 'No mark: ' || n_chars || '.' END"


@query(f"""WITH a AS (SELECT doc_id, n_chars, {_SAID} AS said, list_transform(regexp_extract_all(text, '-?\\d[\\d,]*(?:\\.\\d+)?'), lambda x: regexp_replace(replace(x, ',', ''), '(\\.\\d*?)0+$|\\.$', '\\1')) AS known FROM documents),
b AS (SELECT *, regexp_extract(said, 'It says ([0-9][0-9,]*)', 1) AS f FROM a),
c AS (SELECT *, f <> '' AND NOT list_contains(known, replace(f, ',', '')) AS page_gone, doc_id % 3 = 0 AND NOT list_contains(known, CAST(n_chars AS VARCHAR)) AS data_gone FROM b)
SELECT doc_id, list_filter([CASE WHEN page_gone THEN 'It says ' || f || ' [page].' END, CASE WHEN data_gone THEN 'There are ' || n_chars || ' [d1].' END], lambda x: x IS NOT NULL) AS removed,
  NOT page_gone OR doc_id % 3 = 1 OR (doc_id % 3 = 0 AND NOT data_gone) AS survives FROM c""")
def x17_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer about every document: its first figure, and its length as a figure that the text seldom holds."""
    answer = F.expr(_SAID.replace("regexp_extract(text, '[0-9][0-9,]*')", "regexp_extract(text, '[0-9][0-9,]*', 0)"))
    return table(spark, sf_dir, "documents").select("doc_id", A.supported(answer, F.col("text"), F.lit("how many")).alias("s")).select("doc_id", "s.removed", "s.survives")


_ANSWER = "text || CASE (conv_id + turn) % 6 WHEN 0 THEN '' WHEN 1 THEN ' [1] [' || (turn + 1) || ']' WHEN 2 THEN ' [page]' WHEN 3 THEN ' [2] [d' || (conv_id % 5) || ']' WHEN 4 THEN ' The documents do not mention it [1].' ELSE ' [2](x) [' || (conv_id % 7) || '] ' END"


@query(f"""WITH s AS (SELECT conv_id, turn, {_ANSWER} AS said FROM conversations),
c AS (SELECT *, list_transform(regexp_extract_all(replace(regexp_replace(said, '\\[\\d{{1,2}}\\]\\(', '', 'g'), 'zz', 'zz'), '\\[(\\d{{1,2}})\\]', 1), lambda x: CAST(x AS INTEGER)) AS cited, list_transform(regexp_extract_all(said, '(?i)\\[d(\\d{{1,2}})\\]', 1), lambda x: CAST(x AS INTEGER)) AS points FROM s),
v AS (SELECT conv_id, turn, CASE WHEN {_declines('said')} THEN 'declined' WHEN len(list_filter(cited, lambda n: n < 1 OR n > 3)) > 0 THEN 'invented_citation' WHEN regexp_matches(said, '(?i)\\[page\\]') THEN 'fabricated_page'
  WHEN len(list_filter(points, lambda n: n < 1 OR n > 2)) > 0 THEN 'fabricated_data' WHEN len(cited) = 0 AND len(points) = 0 THEN 'uncited' END AS reason FROM c)
SELECT conv_id, turn, reason IS NULL AS supported, reason FROM v""")
def x21_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as an answer, with markers that follow from its numbers, against three passages and two data points."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWER).alias("said"))
    return rows.select("conv_id", "turn", A.verdict(F.col("said"), F.lit(3), F.lit(False), F.lit(2)).alias("v")).select("conv_id", "turn", "v.supported", "v.reason")


@query("SELECT doc_id, DATE '2019-03-01' + CAST(doc_id % 2000 AS INTEGER) AS changed, DATE '2001-02-03' AS made FROM documents")
def d1_labelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.expr("date '2019-03-01'"), (F.col("doc_id") % 2000).cast("int"))
    n = F.col("doc_id") % 4
    said = F.when(n == 0, F.date_format(day, "d MMMM yyyy")).when(n == 1, F.date_format(day, "MMMM d, yyyy")).when(n == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    text = F.concat("text", F.lit("\nIssued 1 May 2011. Created 2001-02-03.\nLast updated: "), said)
    return table(spark, sf_dir, "documents").select("doc_id", A.labelled_date(text).alias("changed"), A.labelled_date(text, A.CREATED).alias("made"))


_PLANT = "CASE doc_id % 10 WHEN 0 THEN ' Value Added Tax (VAT) is due. VAT applies.' WHEN 1 THEN ' The KYC form.' WHEN 2 THEN ' SLA (service level agreement) and POST.' ELSE '' END"


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') || """ + _PLANT + """ AS text FROM documents), w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{N}_]+')) AS word FROM d), a AS (SELECT doc_id, regexp_replace(word, 's$', '') AS term FROM w WHERE regexp_full_match(word, '[A-Z]{3,6}s?')),
b AS (SELECT doc_id, unnest(list_concat(list_zip(regexp_extract_all(text, '""" + glossary.BEFORE.replace("(?U)", "").replace("'", "''") + """', 2), regexp_extract_all(text, '""" + glossary.BEFORE.replace("(?U)", "").replace("'", "''") + """', 1)), list_zip(regexp_extract_all(text, '""" + glossary.AFTER.replace("(?U)", "").replace("'", "''") + """', 1), regexp_extract_all(text, '""" + glossary.AFTER.replace("(?U)", "").replace("'", "''") + """', 2)))) AS p FROM d),
e AS (SELECT p[1] AS term, arg_min(regexp_replace(p[2], '\\s+', ' ', 'g'), (doc_id, p[2])) AS expansion FROM b GROUP BY p[1]),
u AS (SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM a WHERE term NOT IN (""" + _strings(glossary.NOT_TERMS) + """) GROUP BY term),
n AS (SELECT u.*, expansion FROM u LEFT JOIN e USING (term))
SELECT term, expansion, CASE WHEN expansion IS NULL THEN 'frequency' ELSE 'expansion' END AS method, documents, occurrences, round(CASE WHEN expansion IS NULL THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END + least(0.1::DOUBLE, documents * 0.02::DOUBLE), 4) AS confidence FROM n WHERE expansion IS NOT NULL OR documents >= 3 AND term NOT IN (""" + _strings(glossary.NOISE) + ")")
def x3_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.discover(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.expr(_PLANT)).alias("text")))


_TERMS = {"reaction": ["the", "that"], "POA": ["for", "power of attorney"]}


@query("""WITH f AS (SELECT conv_id, turn, [regexp_matches(text, '(?i)\\breaction\\b'), regexp_matches(text, '\\bthe\\b'), regexp_matches(text, '(?i)\\bthat\\b'), regexp_matches(text, '\\bPOA\\b'), regexp_matches(text, '\\bfor\\b'), regexp_matches(text, '(?i)\\bpower of attorney\\b')] AS h FROM conversations WHERE role = 'user')
SELECT conv_id, turn, list_slice(list_filter([CASE WHEN (h[4] OR h[5] OR h[6]) AND NOT h[4] THEN 'POA' END, CASE WHEN (h[4] OR h[5] OR h[6]) AND NOT h[5] THEN 'for' END, CASE WHEN (h[4] OR h[5] OR h[6]) AND NOT h[6] THEN 'power of attorney' END,
  CASE WHEN (h[1] OR h[2] OR h[3]) AND NOT h[1] THEN 'reaction' END, CASE WHEN (h[1] OR h[2] OR h[3]) AND NOT h[2] THEN 'the' END, CASE WHEN (h[1] OR h[2] OR h[3]) AND NOT h[3] THEN 'that' END], lambda x: x IS NOT NULL), 1, 4) AS added FROM f""")
def x2_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as they were asked, against a glossary of words that they use."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", glossary.expanded(F.col("text"), _TERMS).alias("added"))


@query("""WITH w AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark),
f AS (SELECT id, unnest(ws) AS feature, 1.0::DOUBLE AS weight FROM w
  UNION ALL SELECT id, '#' || substring('^' || x || '$', i, 3), 0.35::DOUBLE FROM (SELECT id, x, unnest(range(1, length(x) + 1)) AS i FROM (SELECT id, unnest(ws) AS x FROM w))
  UNION ALL SELECT id, ws[i] || '_' || ws[i + 1], 0.6::DOUBLE FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM w)),
c AS (SELECT id, CAST(CAST('0x' || substring(md5(feature), 1, 8) AS BIGINT) % 384 AS INTEGER) AS bucket, CASE WHEN CAST('0x' || substring(md5(feature), 9, 1) AS INTEGER) % 2 = 0 THEN weight ELSE -weight END AS w FROM f),
s AS (SELECT id, bucket, round(sum(w), 6) AS w FROM c GROUP BY id, bucket HAVING round(sum(w), 6) <> 0), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM s GROUP BY id)
SELECT id, bucket, round(w / norm, 6) AS weight FROM s JOIN n USING (id)""")
def v1_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embed(table(spark, sf_dir, "benchmark"), "item_id")


_NEEDLES = ", ".join(f"('{target}', {i}, '{needle}')" for target, needles in mapping.NEEDLES.items() for i, needle in enumerate(needles))


@query(f"""WITH f AS (SELECT table_name AS kb, column_index AS place, column_name AS field FROM duckdb_columns() WHERE table_name IN ('documents', 'pages', 'orders', 'events', 'conversations')),
h AS (SELECT kb, target, arg_min(field, (nth, place)) AS field FROM f JOIN (VALUES {_NEEDLES}) n(target, nth, needle) ON contains(lower(field), needle) GROUP BY kb, target)
SELECT kb, target, field, CASE target WHEN 'updated_at' THEN CASE WHEN regexp_matches(lower(field), 'epoch|ts|time') THEN 'date_epoch' ELSE 'date_iso' END WHEN 'labels' THEN 'csv_list' WHEN 'acl_principals' THEN 'csv_list' ELSE 'string' END AS coercion FROM h""")
def m4_suggested_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for the given tables' own fields."""
    fields = [(name, i, f) for name in ("documents", "pages", "orders", "events", "conversations") for i, f in enumerate(table(spark, sf_dir, name).columns)]
    return mapping.suggest(spark.createDataFrame(fields, "kb string, place int, field string"))
