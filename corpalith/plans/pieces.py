"""Queries of uploads, chunk identities, index decisions, glossary upkeep and evidence in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpalith.functions import text as T
from corpalith.operators import glossary, order
from corpalith.plans import queries as Q
from corpalith.plans.flows import _MEMBERS, _refreshed
from corpalith.plans.queries import query
from corpalith.plans.store import _LINES, _chunks
from corpalith.sources.corpus import CATALOGUE_SQL, table


def sniffed(body: Column, declared: Column) -> Column:
    """A type by what the content shows, then by what was declared, then plain text unless control characters say otherwise."""
    html = F.substring(body, 1, 2048).rlike(r"(?i)<(!doctype html|html|head|body)\b")
    binary = F.substring(body, 1, 2048).rlike(r"[\x00-\x08\x0E-\x1F]")
    return F.when(F.contains(F.substring(body, 1, 1024), F.lit("%PDF-")), "application/pdf").when(html, "text/html").when(declared.isNotNull(), declared).when(binary, "application/octet-stream").otherwise("text/plain")


_BODY = "CASE page_id % 6 WHEN 0 THEN 'x %PDF-1.4 ' || url WHEN 1 THEN substring(html, 200, 300) WHEN 2 THEN chr(3) || coalesce(url, '') ELSE html END"
_DECLARED = "CASE WHEN page_id % 12 = 1 THEN 'text/markdown' END"
_SNIFF = "CASE WHEN contains(substring(body, 1, 1024), '%PDF-') THEN 'application/pdf' WHEN regexp_matches(substring(body, 1, 2048), '(?i)<(!doctype html|html|head|body)\\b') THEN 'text/html' WHEN declared IS NOT NULL THEN declared WHEN regexp_matches(substring(body, 1, 2048), '[\\x00-\\x08\\x0E-\\x1F]') THEN 'application/octet-stream' ELSE 'text/plain' END"


@query(f"WITH b AS (SELECT page_id, {_BODY} AS body, {_DECLARED} AS declared FROM pages) SELECT page_id, {_SNIFF} AS mime FROM b")
def p1_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sniffed(F.expr(_BODY), F.expr(_DECLARED)).alias("mime"))


@query(f"WITH b AS (SELECT page_id, {_BODY} AS body, {_DECLARED} AS declared FROM pages WHERE page_id % 6 <> 5), u AS (SELECT page_id, md5(body) AS hash, {_SNIFF} AS mime FROM b WHERE body IS NOT NULL), s AS (SELECT md5(html) AS hash FROM pages WHERE page_id % 6 IN (3, 5)) SELECT page_id, CASE WHEN mime = 'application/octet-stream' THEN 'refused' WHEN hash IN (SELECT hash FROM s) THEN 'duplicate' WHEN page_id > (SELECT min(v.page_id) FROM u v WHERE v.hash = u.hash) THEN 'repeated' ELSE 'pending' END AS state FROM u")
def s12_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads by type and hash: refused, stored already, sent twice, or waiting for review."""
    pages = table(spark, sf_dir, "pages")
    rows = pages.where("page_id % 6 <> 5").select("page_id", F.expr(_BODY).alias("body"), F.expr(_DECLARED).alias("declared")).where("body is not null")
    rows = rows.select("page_id", F.md5("body").alias("hash"), sniffed(F.col("body"), F.col("declared")).alias("mime"))
    held = pages.where("page_id % 6 in (3, 5) and html is not null").select(F.md5("html").alias("h")).distinct()
    firsts = rows.groupBy(F.col("hash").alias("fh")).agg(F.min("page_id").alias("first"))
    rows = rows.join(held, F.col("hash") == F.col("h"), "left").join(firsts, F.col("hash") == F.col("fh"))
    state = F.when(F.col("mime") == "application/octet-stream", "refused").when(F.col("h").isNotNull(), "duplicate").when(F.col("page_id") > F.col("first"), "repeated").otherwise("pending")
    return rows.select("page_id", state.alias("state"))


@query(f"""WITH {CATALOGUE_SQL} SELECT doc_id, md5(CASE kb WHEN 'en' THEN '{{"DocID":' || doc_id || ',"Title":"' || space || '","Tags":"' || array_to_string(labels, ',') || '"}}' WHEN 'de' THEN '{{"id":' || doc_id || ',"heading":"' || space || '","modified":"' || strftime(DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER), '%d/%m/%Y') || '"}}'
  ELSE '{{"uid":' || doc_id || ',"name":"' || space || '","epoch":' || (doc_id % 900) * 86400 || '}}' END) AS raw FROM catalogue""")
def s14_raw_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same facts under the names and forms of three kinds of sources."""
    n, day = F.col("doc_id"), F.date_add(F.expr("date '2020-01-01'"), (F.col("doc_id") % 900).cast("int"))
    one = F.to_json(F.struct(n.alias("DocID"), F.col("space").alias("Title"), F.array_join("labels", ",").alias("Tags")))
    two = F.to_json(F.struct(n.alias("id"), F.col("space").alias("heading"), F.date_format(day, "dd/MM/yyyy").alias("modified")), {"escapeForwardSlash": "false"})
    three = F.to_json(F.struct(n.alias("uid"), F.col("space").alias("name"), (n % 900 * 86400).alias("epoch")))
    raw = F.when(F.col("kb") == "en", one).when(F.col("kb") == "de", F.replace(two, F.lit("\\/"), F.lit("/"))).otherwise(three)
    return Q._catalogue(spark, sf_dir).select("doc_id", F.md5(raw).alias("raw"))


_LAST = "coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY ordinal), '')"


@query(f"WITH {_LINES}, o AS (SELECT doc_id, ordinal, line, CASE WHEN length({_LAST}) <= 160 THEN {_LAST} ELSE right({_LAST}, 160) END AS over FROM chunks) SELECT o.doc_id, ordinal, md5(array_to_string(list_filter([source || ' > ' || lang, over, line], lambda x: x <> ''), chr(10))) AS embedded FROM o JOIN documents d ON d.doc_id = o.doc_id WHERE source IS NOT NULL AND lang IS NOT NULL")
def p8_embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of a chunk: its path, the end of the chunk before, and its text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    # Pairs of a line and the one before it, made before they become rows: else every row would carry all lines.
    pairs = F.transform(F.array(lines), lambda every: F.transform(every, lambda x, i: F.struct(F.coalesce(F.get(every, i - 1), F.lit("")).alias("before"), x.alias("line"))))
    rows = table(spark, sf_dir, "documents").where("source is not null and lang is not null").select("doc_id", F.concat("source", F.lit(" > "), "lang").alias("path"), F.element_at(pairs, 1).alias("pairs"))
    rows = rows.select("doc_id", "path", F.posexplode("pairs").alias("ordinal", "pair")).select("doc_id", "path", "ordinal", "pair.before", "pair.line")
    before = F.col("before")
    over = F.when(F.length(before) <= 160, before).otherwise(F.right(before, F.lit(160)))
    parts = F.filter(F.array(F.col("path"), over, F.col("line")), lambda x: x != "")
    return rows.select("doc_id", "ordinal", F.md5(F.array_join(parts, "\n")).alias("embedded"))


@query(f"WITH {_LINES} SELECT doc_id, ordinal, 'chk_' || substring(sha256(CAST(doc_id AS VARCHAR) || chr(31) || ordinal || chr(31) || line), 1, 16) AS chunk_id, substring(sha256('v2' || chr(31) || line), 1, 16) AS text_hash FROM chunks")
def p9_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of chunks and hashes of their texts; the chunker's version is in the hash and not in the id."""
    joined = lambda *x: F.substring(F.sha2(F.concat_ws("\u001f", *x), 256), 1, 16)
    return _chunks(spark, sf_dir).select("doc_id", "ordinal", F.concat(F.lit("chk_"), joined(F.col("doc_id").cast("string"), F.col("ordinal").cast("string"), F.col("line"))).alias("chunk_id"), joined(F.lit("v2"), F.col("line")).alias("text_hash"))


@query(f"WITH {CATALOGUE_SQL}, {_MEMBERS} SELECT c.doc_id, CASE WHEN ({Q._RULE_B}) IS NOT NULL THEN 'out_of_scope' WHEN NOT in_store OR acl <> 'all-staff' THEN 'unreadable' WHEN verdict = 'unchanged' AND c.doc_id % 8 <> 0 THEN 'unchanged' WHEN strlen(text) = 0 THEN 'refused' WHEN verdict = 'unchanged' THEN 'reuse' ELSE 'rechunk' END AS action FROM catalogue c JOIN r ON r.doc_id = c.doc_id WHERE verdict <> 'gone'")
def p13_index_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What indexing does with each document, by the first test that settles it; an old chunker (here one id in eight) means to look again."""
    from corpalith.operators import access, scope

    rows = _refreshed(spark, sf_dir).where("verdict <> 'gone'").select(F.col("doc_id").alias("d"), "verdict")
    same = F.col("verdict") == "unchanged"
    action = (
        F.when(scope.exclusion_rule(Q.SCOPE_B).isNotNull(), "out_of_scope").when(~F.col("in_store") | access.forbidden([]), "unreadable").when(same & (F.col("doc_id") % 8 != 0), "unchanged")
        .when(F.octet_length("text") == 0, "refused").when(same, "reuse").otherwise("rechunk")
    )
    return Q._catalogue(spark, sf_dir).join(rows, F.col("doc_id") == F.col("d")).select("doc_id", action.alias("action"))


_STATED = "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') WHEN 1 THEN strftime(o_orderdate, '%a, %d %b %Y 00:00:00 GMT') ELSE 'soon' END"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM (SELECT o_orderkey, o_orderdate, {_STATED} AS stated FROM orders)")
def d3_stated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as headers and site maps state them; what can't be read is null."""
    day = F.col("o_orderdate").cast("timestamp")
    stated = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    rest = F.regexp_replace(F.col("s"), "^[A-Z][a-z]{2}, ", "")
    read = F.coalesce(F.try_to_timestamp("s", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp(rest, F.lit("dd MMM yyyy HH:mm:ss 'GMT'")))
    return table(spark, sf_dir, "orders").select("o_orderkey", stated.alias("s")).select("o_orderkey", read.cast("date").alias("day"))


_STORED = "stored AS (SELECT n_name AS term, 'old ' || n_name AS expansion, CASE n_nationkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status FROM nation WHERE n_nationkey < 18), found AS (SELECT n_name AS term, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name END AS expansion, CAST(n_nationkey * 2 AS BIGINT) AS documents FROM nation WHERE n_nationkey > 4)"


@query(f"WITH {_STORED} SELECT coalesce(s.term, f.term) AS term, CASE WHEN s.status IN ('confirmed', 'rejected') THEN s.expansion ELSE coalesce(f.expansion, s.expansion) END AS expansion, coalesce(status, 'proposed') AS status, coalesce(documents, 0) AS documents FROM stored s FULL JOIN found f ON s.term = f.term")
def x4_glossary_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was measured is renewed; what a person judged stays."""
    nations, n = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    status = F.when(n % 3 == 0, "confirmed").when(n % 3 == 1, "rejected").otherwise("proposed")
    stored = nations.where("n_nationkey < 18").select(F.col("n_name").alias("term"), F.concat(F.lit("old "), "n_name").alias("expansion"), status.alias("status"))
    found = nations.where("n_nationkey > 4").select(F.col("n_name").alias("term"), F.when(n % 2 == 0, F.concat(F.lit("new "), "n_name")).alias("expansion"), (n * 2).cast("long").alias("documents"))
    return glossary.refreshed(stored, found)


@query(f"WITH {_STORED} SELECT term, expansion, CAST(row_number() OVER (ORDER BY length(term) DESC, term) AS INTEGER) AS nth FROM stored WHERE status = 'confirmed'")
def z6_expansion_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that may expand a question, the longest first: a reviewed glossary is a short list."""
    rows = table(spark, sf_dir, "nation").where("n_nationkey < 18 and n_nationkey % 3 = 0").select(F.col("n_name").alias("term"), F.concat(F.lit("old "), "n_name").alias("expansion"))
    return rows.withColumn("nth", F.row_number().over(Window.orderBy(F.length("term").desc(), "term")))


@query("SELECT word, CASE WHEN suffix(word, 'ies') AND length(word) >= 6 THEN left(word, length(word) - 3) || 'y' WHEN suffix(word, 'es') AND length(word) >= 5 THEN left(word, length(word) - 2) WHEN suffix(word, 's') AND length(word) >= 4 THEN left(word, length(word) - 1) ELSE word END AS stem, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY word")
def x6_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", T.stem(F.col("word")).alias("stem"), "n")


@query(f"WITH {CATALOGUE_SQL}, k AS (SELECT doc_id, list_sort(list_filter(labels, lambda l: regexp_matches(l, '^(state|region|jurisdiction|entity|product)-'))) AS own FROM catalogue) SELECT a.doc_id, a.own <> b.own AND len(a.own) + len(b.own) > 0 AS differ, len(a.own) = 0 AND len(b.own) > 0 OR len(b.own) = 0 AND len(a.own) > 0 AS one_sided FROM k a JOIN k b ON b.doc_id = a.doc_id + 1")
def c2_scope_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two documents declare different scopes, or only one of them a scope at all."""
    own = F.array_sort(F.filter("labels", lambda x: x.rlike("^(state|region|jurisdiction|entity|product)-")))
    keys = Q._catalogue(spark, sf_dir).select("doc_id", own.alias("a"))
    pairs = keys.join(keys.select((F.col("doc_id") - 1).alias("d"), F.col("a").alias("b")), F.col("doc_id") == F.col("d"))
    na, nb = F.size("a"), F.size("b")
    return pairs.select("doc_id", ((F.col("a") != F.col("b")) & (na + nb > 0)).alias("differ"), (((na == 0) & (nb > 0)) | ((nb == 0) & (na > 0))).alias("one_sided"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal FROM conversations WHERE turn % 3 <> 1")
def w12_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns numbered anew without gaps after some were removed."""
    left = table(spark, sf_dir, "conversations").where("turn % 3 <> 1").select("conv_id", "turn")
    return order.numbered(left, "conv_id", ["turn"]).select("conv_id", "turn", (F.col("nth") - 1).cast("int").alias("ordinal"))


@query(f"WITH {CATALOGUE_SQL}, p AS (SELECT title, min(doc_id) AS a, max(doc_id) AS b, count(*) AS n FROM catalogue WHERE trim(title) <> '' GROUP BY title HAVING count(*) > 1) SELECT a, b, 'Documents ' || a || ' and ' || b || ' share a title' || CASE WHEN n > 2 THEN ' with ' || (n - 2) || ' more.' ELSE '.' END AS prose FROM p")
def x27_evidence_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q._catalogue(spark, sf_dir).where(F.trim("title") != "").groupBy("title").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    more = F.when(F.col("n") > 2, F.concat(F.lit(" with "), F.col("n") - 2, F.lit(" more."))).otherwise(".")
    return rows.select("a", "b", F.concat(F.lit("Documents "), "a", F.lit(" and "), "b", F.lit(" share a title"), more).alias("prose"))


@query("SELECT doc_id, CAST(doc_id % 3 + 1 AS INTEGER) AS version, doc_id % 5 = 0 AS parsed_anew FROM documents WHERE doc_id % 3 + 1 > 1 OR doc_id % 5 = 0")
def v9_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that the cache doesn't hold: its key is document, version, parser and chunker, so a change of any of them misses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 + 1).cast("int").alias("version"), F.when(F.col("doc_id") % 5 == 0, "p2").otherwise("p1").alias("parser"), F.lit("c1").alias("chunker"))
    cached = docs.select(F.col("doc_id").alias("d"), F.lit(1).alias("v"), F.lit("p1").alias("p"), F.lit("c1").alias("c"))
    hit = (F.col("doc_id") == F.col("d")) & (F.col("version") == F.col("v")) & (F.col("parser") == F.col("p")) & (F.col("chunker") == F.col("c"))
    return docs.join(cached, hit, "left_anti").select("doc_id", "version", (F.col("parser") == "p2").alias("parsed_anew"))
