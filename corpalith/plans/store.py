"""Queries of the store, the index, filters, field maps and joins between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpalith.functions import urls as U
from corpalith.operators import access, mapping, ranking, scope, store
from corpalith.plans import queries as Q
from corpalith.plans.queries import query
from corpalith.sources.corpus import CATALOGUE_SQL, table
from corpalith.sources.kept import kept, small

_ASKED = "asked AS (SELECT vec_id AS asked_id FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT -vec_id - 1 FROM embeddings WHERE vec_id % 50 = 0), held AS (SELECT * FROM catalogue WHERE in_store)"
_OUTCOME = "CASE WHEN doc_id IS NULL THEN 'not_found' WHEN acl <> 'all-staff' THEN 'forbidden' ELSE 'resolved' END"


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select("vec_id")
    asked = ids.where("vec_id % 2 = 0").select(F.col("vec_id").alias("asked_id")).union(ids.where("vec_id % 50 = 0").select(-F.col("vec_id") - 1))
    return store.fetched(asked, Q._catalogue(spark, sf_dir).where("in_store"), access.forbidden([]))


@query(f"WITH {CATALOGUE_SQL}, {_ASKED} SELECT asked_id, md5(text) AS body, CAST(strlen(text) AS INTEGER) AS n_bytes, CASE WHEN regexp_matches(substring(text, 1, 2048), '(?i)<(html|body)\\b') THEN 'text/html' ELSE 'text/plain' END AS mime FROM asked JOIN held ON asked_id = doc_id WHERE acl = 'all-staff'")
def s4_fetch_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of what resolves, with the type that their first bytes show; nothing else has any."""
    mime = F.when(F.substring("text", 1, 2048).rlike(r"(?i)<(html|body)\b"), "text/html").otherwise("text/plain")
    return _fetched(spark, sf_dir).where("outcome = 'resolved'").select("asked_id", F.md5("text").alias("body"), F.octet_length("text").alias("n_bytes"), mime.alias("mime"))


@query(f"WITH {CATALOGUE_SQL}, {_ASKED} SELECT asked_id, {_OUTCOME} AS outcome, CASE WHEN doc_id IS NULL THEN 'not in the store' WHEN acl <> 'all-staff' THEN 'no grant' END AS detail, CASE WHEN acl = 'all-staff' THEN title END AS title FROM asked LEFT JOIN held ON asked_id = doc_id")
def s5_fetch_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.when(F.col("outcome") == "not_found", "not in the store").when(F.col("outcome") == "forbidden", "no grant")
    return _fetched(spark, sf_dir).select("asked_id", "outcome", detail.alias("detail"), F.when(F.col("outcome") == "resolved", F.col("title")).alias("title"))


_LINES = "lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS ordinal, line FROM lines WHERE trim(line) <> '')"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks (doc_id, ordinal, line): the lines of a text that are not blank, in order."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("ordinal", "line"))


@query(f"WITH {_LINES} SELECT doc_id, ordinal, md5(line) AS body, vec_id IS NOT NULL AS has_vector FROM chunks LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 0) e ON doc_id = vec_id WHERE doc_id % 3 = 0")
def s7_stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the wanted documents with their vectors of the current model, in one join."""
    current = table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").select("vec_id")
    rows = _chunks(spark, sf_dir).where("doc_id % 3 = 0").join(current, F.col("doc_id") == F.col("vec_id"), "left")
    return rows.select("doc_id", "ordinal", F.md5("line").alias("body"), F.col("vec_id").isNotNull().alias("has_vector"))


_ROBOTS = [("/", True), ("/en/1", False), ("/en/12", True), ("/fr", False), ("/de/9", False)]
_PATH = "regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1)"


@query(f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, CASE WHEN starts_with(path, '/en/12') THEN true WHEN starts_with(path, '/en/1') OR starts_with(path, '/fr') OR starts_with(path, '/de/9') THEN false ELSE true END AS allowed FROM p")
def s10_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", store.robots_allow(path, _ROBOTS).alias("allowed"))


@query("SELECT doc_id, CAST('0x' || substring(md5(text), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS unit FROM documents")
def s15_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", store.unit(F.col("text")).alias("unit"))


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, list_filter([CASE WHEN space = 'src0' THEN 'space src0' END, CASE WHEN path = '/src1/en' OR starts_with(path, '/src1/en/') THEN 'path /src1/en' END, CASE WHEN list_contains(labels, 'approved') THEN 'label approved' END, CASE WHEN regexp_full_match(path, '/src1./de/.*') THEN 'path /src1?/de/*' END], lambda x: x IS NOT NULL) AS roots FROM catalogue")
def f2_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root of a scope that a document stands under."""
    test = {"space": lambda v: F.col("space") == v, "path": lambda v: scope.path_matches(F.col("path"), v), "label": lambda v: F.array_contains("labels", v)}
    named = [F.when(test[kind](v), F.lit(f"{kind} {v}")) for kind, v in Q.SCOPE_A.roots]
    return Q._catalogue(spark, sf_dir).select("doc_id", F.filter(F.array(*named), lambda x: x.isNotNull()).alias("roots"))


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, path = '/src0/en' OR starts_with(path, '/src0/en/') AS under, regexp_full_match(path, '.*/fr/.*9') AS globbed, regexp_full_match(path, '/src[0-1]/.*') AS ranged FROM catalogue")
def f3_path_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = lambda pattern: scope.path_matches(F.col("path"), pattern)
    return Q._catalogue(spark, sf_dir).select("doc_id", fits("/src0/en").alias("under"), fits("*/fr/*9").alias("globbed"), fits("/src[0-1]/*").alias("ranged"))


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, regexp_full_match(path, '.*the.*') OR regexp_full_match(title, '.*the.*', 's') AS fits FROM catalogue")
def f4_title_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern is tried on the title as well as on the path."""
    return Q._catalogue(spark, sf_dir).select("doc_id", scope.pattern_matches("*the*").alias("fits"))


_FILTERS = "(doc_type IS NULL OR doc_type IN ('policy', 'faq', 'procedure')) AND NOT list_contains(labels, 'draft') AND (age_days IS NULL OR age_days <= 1200) AND (age_days IS NULL OR age_days >= 30)"


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id FROM catalogue WHERE in_index AND {_FILTERS}")
def f5_index_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a scope the index applies; its roots are of several kinds, so none is left to the index."""
    return Q._catalogue(spark, sf_dir).where("in_index").where(store.IndexFilters.of(Q.SCOPE_A).predicate()).select("doc_id")


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id FROM catalogue WHERE space IN ('src0', 'src2') AND len(list_intersect(labels, ['en', 'approved'])) > 0 AND len(list_intersect(labels, ['archive'])) = 0 AND (age_days IS NULL OR age_days <= 900)")
def f6_index_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = store.IndexFilters(("src0", "src2"), ("en", "approved"), ("archive",), oldest_days=900)
    return Q._catalogue(spark, sf_dir).where(wanted.predicate()).select("doc_id")


_DENIED = "CASE WHEN doc_id % 8 = 0 THEN ['hr'] WHEN doc_id % 8 = 1 THEN ['it', 'legal'] END"


@query(f"WITH {CATALOGUE_SQL}, l AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 'hr' ELSE acl END AS acl, {_DENIED} AS denied FROM catalogue) SELECT doc_id, coalesce(list_contains(denied, 'hr'), false) OR acl IS NULL OR acl NOT IN ('all-staff', 'hr') AS forbidden, false AS service FROM l")
def f7_access_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of those refused stands over the access list; without an access list only the service reads."""
    acl = F.when(F.col("doc_id") % 29 == 0, F.lit(None)).when(F.col("doc_id") % 6 == 1, "hr").otherwise(F.col("acl"))
    rows = Q._catalogue(spark, sf_dir).withColumn("acl", acl)
    denied = F.when(F.col("doc_id") % 8 == 0, F.array(F.lit("hr"))).when(F.col("doc_id") % 8 == 1, F.array(F.lit("it"), F.lit("legal")))
    return rows.select("doc_id", access.forbidden(["hr"], denied).alias("forbidden"), access.forbidden(["service"]).alias("service"))


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, age_days, {Q._STALE} AS state FROM catalogue")
def f9_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._catalogue(spark, sf_dir).select("doc_id", "age_days", access.staleness(F.col("age_days")).alias("state"))


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, {Q._TIER} AS tier FROM catalogue WHERE ({Q._TIER}) <> 'archive'")
def f11_archive_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(F.array_contains("labels", "approved"), "authoritative"), (F.array_contains("labels", "archive"), "archive")]
    tier = access.authority(rules, F.lit(None).cast("string"))
    return Q._catalogue(spark, sf_dir).select("doc_id", tier.alias("tier")).where("tier <> 'archive'")


_STATES = "connectors AS (SELECT lang AS kb, CASE lang WHEN 'en' THEN 'active' WHEN 'de' THEN 'paused' WHEN 'fr' THEN 'active' ELSE 'draft' END AS state FROM documents GROUP BY lang)"


@query(f"WITH {_STATES} SELECT d.doc_id, state, CASE WHEN state <> 'active' THEN 'connector_' || state END AS refusal FROM documents d JOIN connectors c ON d.lang = c.kb")
def f13_connector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    state = F.when(F.col("kb").isin("en", "fr"), "active").when(F.col("kb") == "de", "paused").otherwise("draft")
    states = docs.where("lang is not null").select(F.col("lang").alias("kb")).distinct().withColumn("state", state)
    return docs.join(states, F.col("lang") == F.col("kb")).select("doc_id", "state", F.when(F.col("state") != "active", F.concat(F.lit("connector_"), "state")).alias("refusal"))


@query("SELECT o_custkey % 5 AS org, count(*) AS rows, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_custkey % 5 IN (1, 3) GROUP BY 1")
def f14_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the caller's organisations only; the condition stands on the scan, ahead of any other."""
    rows = table(spark, sf_dir, "orders").withColumn("org", F.col("o_custkey") % 5).where("org in (1, 3)")
    return rows.groupBy("org").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"))


@query(f"WITH {Q._PAIRS} SELECT question_id, doc_id, rerank_score, CASE WHEN rerank_score < 0.08 THEN 'under_lexical' WHEN rerank_score < 0.35 THEN 'under_llm' WHEN rerank_score < 0.55 THEN 'under_embedding' ELSE 'over' END AS floor FROM reranked")
def f15_score_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor of each reranker that a score stays under."""
    score = F.col("rerank_score")
    floor = F.when(score < 0.08, "under_lexical").when(score < 0.35, "under_llm").when(score < 0.55, "under_embedding").otherwise("over")
    return Q._reranked(spark, sf_dir).select("question_id", "doc_id", "rerank_score", floor.alias("floor"))


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id FROM catalogue WHERE space IN ('src0', 'src1', 'src2') AND (doc_type IS NULL OR doc_type <> 'faq') AND contains(lower(title), 'the') AND NOT list_contains(labels, 'draft')")
def f16_typed_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q._catalogue(spark, sf_dir)
    for field, op, value in (("space", "in", ["src0", "src1", "src2"]), ("doc_type", "neq", "faq"), ("title", "contains", "The"), ("label", "neq", "draft")):
        rows = rows.where(store.typed_filter(field, op, value))
    return rows.select("doc_id")


@query("SELECT event_id, regexp_full_match('user-' || user_id, 'user-[0-4]\\d*') OR regexp_full_match('user-' || user_id, 'user-7') AS allowed FROM events")
def f18_allowed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("user-"), "user_id")
    return table(spark, sf_dir, "events").select("event_id", store.key_allowed(key, [r"user-[0-4]\d*", "user-7"]).alias("allowed"))


@query("""WITH c AS (SELECT count(*) AS n, count(TRY_CAST(left(o_orderdate::VARCHAR, 10) AS DATE)) AS d, count(CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END) AS a FROM orders)
SELECT list_filter([CASE WHEN d < 0.95 * n THEN 'dates under 95 %' END, CASE WHEN a < 0.95 * n THEN 'owner under 95 %' END, 'title is not mapped', 'no access field'], lambda x: x IS NOT NULL) AS blocking FROM c""")
def f23_activation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a field map may not go live: required fields covered too little or not mapped, and nothing that says who may read."""
    orders = table(spark, sf_dir, "orders")
    n, dated, owned = F.count("*"), F.count(F.try_to_timestamp(F.substring(F.col("o_orderdate").cast("string"), 1, 10), F.lit("yyyy-MM-dd"))), F.count(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))
    counts = orders.agg(n.alias("n"), dated.alias("d"), owned.alias("a"))
    found = F.array(F.when(F.col("d") < 0.95 * F.col("n"), "dates under 95 %"), F.when(F.col("a") < 0.95 * F.col("n"), "owner under 95 %"), F.lit("title is not mapped"), F.lit("no access field"))
    return counts.select(F.filter(found, lambda x: x.isNotNull()).alias("blocking"))


@query(f"WITH p AS (SELECT page_id, {Q._HOST} AS host, {_PATH} AS path FROM pages) SELECT page_id FROM p WHERE suffix(host, '.example.org') AND regexp_full_match(path, '/(en|de)/.*') AND NOT regexp_full_match(path, '.*/9.*') AND NOT (starts_with(path, '/en/1') AND NOT starts_with(path, '/en/12'))")
def f24_crawl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, folders to include and to leave out, then robots."""
    path = F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1)
    included = scope.path_matches(path, "/en/*") | scope.path_matches(path, "/de/*")
    keep = U.host(F.col("url")).endswith(".example.org") & included & ~scope.path_matches(path, "*/9*") & store.robots_allow(path, [("/en/1", False), ("/en/12", True)])
    return table(spark, sf_dir, "pages").where(keep).select("page_id")


_RAW = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN CAST(o_custkey * 1000000 AS VARCHAR) ELSE ' a, b ,,' || o_orderpriority END"


@query("""WITH r AS (SELECT o_orderkey, """ + _RAW + """ AS raw FROM orders)
SELECT o_orderkey, TRY_CAST(raw AS BIGINT) AS whole, TRY_CAST(CASE WHEN regexp_full_match(raw, '\\d{4}-\\d\\d-\\d\\d') THEN raw END AS DATE) AS iso, CAST(try_strptime(CASE WHEN regexp_full_match(raw, '\\d\\d/\\d\\d/\\d{4}') THEN raw END, '%d/%m/%Y') AS DATE) AS dmy,
  CAST(to_timestamp(TRY_CAST(raw AS BIGINT)) AT TIME ZONE 'UTC' AS DATE) AS epoch, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') AS listed FROM r""")
def m1_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coercion on values of four forms; what one can't read is null."""
    n = F.col("o_orderkey") % 4
    day = F.col("o_orderdate").cast("timestamp")
    raw = F.when(n == 0, F.date_format(day, "yyyy-MM-dd")).when(n == 1, F.date_format(day, "dd/MM/yyyy")).when(n == 2, (F.col("o_custkey") * 1_000_000).cast("string")).otherwise(F.concat(F.lit(" a, b ,,"), "o_orderpriority"))
    rows, to = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), mapping.COERCIONS
    return rows.select("o_orderkey", *(to[kind](F.col("raw")).alias(name) for name, kind in (("whole", "int"), ("iso", "date_iso"), ("dmy", "date_dmy"), ("epoch", "date_epoch"), ("listed", "csv_list"))))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(nullif(trim(json_extract_string(props, '$.owner')), ''), 'nobody') AS owner,
  CASE WHEN event_type IS NOT NULL AND TRY_CAST(event_type AS BIGINT) IS NULL THEN ['kind: int'] ELSE [] END AS errors FROM events""")
def m2_applied_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by path with their defaults; a value that can't be read is an error of its row, and the row stays."""
    to = mapping.COERCIONS
    k, owner = mapping.datapoint(F.col("props"), "k"), mapping.datapoint(F.col("props"), "owner")
    errors = F.filter(F.array(F.when(F.col("event_type").isNotNull() & to["int"](F.col("event_type")).isNull(), "kind: int")), lambda x: x.isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(to["int"](k), F.lit(-1).cast("long")).alias("k"), F.coalesce(F.trim(owner), F.lit("nobody")).alias("owner"), errors.alias("errors"))


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN 'facet ' || space END, path) AS place, coalesce(doc_type, 'raw ' || kb) AS doc_type FROM catalogue")
def m6_merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets over raw metadata; a null facet takes nothing away."""
    raw = F.create_map(F.lit("place"), F.col("path"), F.lit("doc_type"), F.concat(F.lit("raw "), "kb"))
    facets = F.map_filter(F.create_map(F.lit("place"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("facet "), "space")), F.lit("doc_type"), F.col("doc_type")), lambda _, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(raw, lambda k, _: ~F.map_contains_key(facets, k)), facets)
    return Q._catalogue(spark, sf_dir).select("doc_id", merged["place"].alias("place"), merged["doc_type"].alias("doc_type"))


@query("SELECT event_type, count(*) AS rows, CAST(count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS BIGINT) AS failures, list_slice(list_sort(list(event_id) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL OR event_id % 5 = 0)), 1, 3) AS samples FROM events GROUP BY event_type")
def m7_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a map reads, how many it can't, and the least three ids to look at, kept as three at a time."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", mapping.COERCIONS["int"](mapping.datapoint(F.col("props"), "k")).alias("k"))
    counts = rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.count(F.when(F.col("k").isNull(), 1)).alias("failures"))
    least = rows.where("k is null or event_id % 5 = 0").withColumn("nth", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).where("nth <= 3")
    shown = least.groupBy(F.col("event_type").alias("t")).agg(F.array_sort(F.collect_list("event_id")).alias("samples"))
    return counts.join(shown, F.col("event_type").eqNullSafe(F.col("t")), "left").drop("t")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical channel's hits, at most twenty of a question: few, so that what the documents are asked for is found where they are read."""
    hits = kept(Q._lexical(spark, sf_dir))
    return small(hits, hits.count())


@query(f"WITH {Q._LEXICAL} SELECT question_id, rank AS number, doc_id, strftime(DATE '2026-08-22' - CAST(age_days AS INTEGER), '%d %b %Y') AS dated FROM lexical JOIN catalogue USING (doc_id)")
def m10_numbered_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages numbered in rank order with their dates, as a prompt shows them."""
    ages = Q._catalogue(spark, sf_dir).select(F.col("doc_id").alias("d"), "age_days")
    day = F.date_sub(F.expr("date '2026-08-22'"), F.col("age_days").cast("int"))
    return _hits(spark, sf_dir).join(ages, F.col("doc_id") == F.col("d")).select("question_id", F.col("rank").alias("number"), "doc_id", F.date_format(day, "dd MMM yyyy").alias("dated"))


@query("SELECT kb, key, coalesce(own, general) AS value, CASE WHEN own IS NULL THEN 'default' ELSE 'override' END AS origin FROM (SELECT DISTINCT lang AS kb FROM documents) k, (VALUES ('k', '20'), ('floor', '0.08'), ('budget', '12')) d(key, general) LEFT JOIN (VALUES ('en', 'k', '40'), ('de', 'budget', '6')) o(okb, okey, own) ON okb = kb AND okey = key")
def m11_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting of every connector, and whether it is its own."""
    kbs = table(spark, sf_dir, "documents").select(F.col("lang").alias("kb")).distinct()
    defaults = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("general")) for k, v in (("k", "20"), ("floor", "0.08"), ("budget", "12"))))
    own = spark.createDataFrame([("en", "k", "40"), ("de", "budget", "6")], "okb string, okey string, own string")
    rows = kbs.select("kb", F.inline(defaults)).join(F.broadcast(own), (F.col("okb") == F.col("kb")) & (F.col("okey") == F.col("key")), "left")
    return rows.select("kb", "key", F.coalesce("own", "general").alias("value"), F.when(F.col("own").isNull(), "default").otherwise("override").alias("origin"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://store.example' || coalesce(" + _PATH + ", '') END AS public FROM pages WHERE url IS NOT NULL")
def m12_public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1)
    key = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", store.public_url(key, path, "https://store.example").alias("public"))


@query(f"WITH {_LINES}, e AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'old' ELSE 'current' END AS model, label FROM embeddings) SELECT c.doc_id, c.ordinal, d.lang, e.label FROM chunks c JOIN documents d ON c.doc_id = d.doc_id LEFT JOIN e ON e.vec_id = c.doc_id AND model = 'current'")
def j1_chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "lang")
    current = table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").select("vec_id", "label")
    rows = _chunks(spark, sf_dir).select("doc_id", "ordinal").join(docs, F.col("doc_id") == F.col("d")).join(current, F.col("doc_id") == F.col("vec_id"), "left")
    return rows.select("doc_id", "ordinal", "lang", "label")


@query(f"WITH {Q._LEXICAL} SELECT question_id, count(*) AS hits, CAST(count(*) FILTER (WHERE NOT in_store) AS BIGINT) AS stale FROM lexical JOIN catalogue USING (doc_id) GROUP BY question_id")
def j3_index_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search doesn't join the store, so its stale ids can be counted."""
    known = Q._catalogue(spark, sf_dir).select(F.col("doc_id").alias("d"), "in_store")
    return _hits(spark, sf_dir).join(known, F.col("doc_id") == F.col("d")).groupBy("question_id").agg(F.count("*").alias("hits"), F.count(F.when(~F.col("in_store"), 1)).alias("stale"))


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, title FROM catalogue WHERE doc_id = ANY(SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0)")
def j4_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").where("vec_id % 7 = 0").select("vec_id")
    return Q._catalogue(spark, sf_dir).join(ids, F.col("doc_id") == F.col("vec_id"), "left_semi").select("doc_id", "title")


@query(f"WITH {CATALOGUE_SQL} SELECT doc_id, EXISTS (SELECT 1 FROM unnest(labels) t(l) WHERE l IN ('approved', 'de')) AS any_of, NOT EXISTS (SELECT 1 FROM unnest(labels) t(l) WHERE starts_with(l, 'state-')) AS none_of FROM catalogue")
def j5_label_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._catalogue(spark, sf_dir).select("doc_id", F.exists("labels", lambda x: x.isin("approved", "de")).alias("any_of"), (~F.exists("labels", lambda x: x.startswith("state-"))).alias("none_of"))


@query(f"WITH {_LINES}, v AS (SELECT doc_id, ordinal, CASE WHEN (doc_id + ordinal) % 6 = 0 THEN 2 ELSE 1 END AS version FROM chunks) SELECT d.doc_id, EXISTS (SELECT 1 FROM v WHERE v.doc_id = d.doc_id AND version = 2) AS current FROM documents d")
def j6_current_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document has a chunk of the chunker's current version."""
    there = _chunks(spark, sf_dir).where("(doc_id + ordinal) % 6 = 0").select(F.col("doc_id").alias("d")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(there, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.col("d").isNotNull().alias("current"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def j10_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


_ROLES = "roles(role) AS (VALUES ('reader'), ('editor'), ('guest')), members(mrole, member) AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'reader' WHEN 1 THEN 'editor' ELSE 'lost' END, c_custkey FROM customer), rules(rrole, effect) AS (VALUES ('reader', 'allow'), ('reader', 'deny'), ('guest', 'allow'))"


@query(f"WITH {_ROLES} SELECT role, count(DISTINCT member) AS members, count(DISTINCT effect) AS rules FROM roles LEFT JOIN members ON mrole = role LEFT JOIN rules ON rrole = role GROUP BY role")
def j11_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and rules are counted by role before they meet, so neither multiplies the other."""
    roles = spark.createDataFrame([("reader",), ("editor",), ("guest",)], "role string")
    role = F.when(F.col("c_custkey") % 3 == 0, "reader").when(F.col("c_custkey") % 3 == 1, "editor").otherwise("lost")
    members = table(spark, sf_dir, "customer").groupBy(role.alias("mrole")).agg(F.count_distinct("c_custkey").alias("members"))
    rules = spark.createDataFrame([("reader", "allow"), ("reader", "deny"), ("guest", "allow")], "rrole string, effect string").groupBy("rrole").agg(F.count_distinct("effect").alias("rules"))
    rows = roles.join(members, F.col("mrole") == F.col("role"), "left").join(rules, F.col("rrole") == F.col("role"), "left")
    return rows.select("role", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("rules", F.lit(0)).alias("rules"))


@query("SELECT c.conv_id, count(*) AS turns, max(d.lang) AS kb, max(d.source) AS collection FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id AND d.doc_id % 5 <> 0 GROUP BY c.conv_id")
def j12_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with the connector they belong to, if it is still there."""
    threads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    owner = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select("doc_id", F.col("lang").alias("kb"), F.col("source").alias("collection"))
    return threads.join(owner, F.col("conv_id") == F.col("doc_id"), "left").select("conv_id", "turns", "kb", "collection")


@query(f"WITH {CATALOGUE_SQL} SELECT i.doc_id, coalesce(s.title, i.title) AS title, s.title IS DISTINCT FROM i.title AND s.doc_id IS NOT NULL AS moved FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '* ' || title ELSE title END AS title FROM catalogue WHERE in_index) i LEFT JOIN (SELECT doc_id, title FROM catalogue WHERE in_store) s USING (doc_id)")
def j16_titles_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Q._catalogue(spark, sf_dir)
    kept = docs.where("in_store").select(F.col("doc_id").alias("s_id"), F.col("title").alias("stored"))
    rows = docs.where("in_index").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("* "), "title")).otherwise(F.col("title")).alias("title")).join(kept, F.col("doc_id") == F.col("s_id"), "left")
    return rows.select("doc_id", F.coalesce("stored", "title").alias("new"), (F.col("s_id").isNotNull() & ~F.col("stored").eqNullSafe(F.col("title"))).alias("moved")).withColumnRenamed("new", "title")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE regexp_replace(p_name || ' | Parts Desk', ' [|] Parts Desk$', '') END AS title FROM part")
def j17_suffixes_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's common ending off every title that has it."""
    from corpalith.operators import reports

    titles = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(" | Parts Desk")).alias("t"))
    common = reports.common_suffix(titles.select(F.col("t").alias("title"))).select("suffix")
    rows = titles.join(F.broadcast(common), F.col("t").endswith(F.col("suffix")), "left")
    return rows.select("p_partkey", F.when(F.col("suffix").isNotNull(), F.substring(F.col("t"), F.lit(1), F.length("t") - F.length("suffix"))).otherwise(F.col("t")).alias("title"))


@query("SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS items, (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) AS neighbours FROM supplier")
def j19_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each parent's children, made by key and joined, none for none."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("items"))
    near = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("neighbours"))
    rows = table(spark, sf_dir, "supplier").join(items, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(near, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("s_suppkey", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"""WITH own AS (SELECT *, {_NORM} AS n FROM embeddings WHERE vec_id % 4 <> 0), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (v.n * q.n), 6) AS score
  FROM own v JOIN (SELECT *, {_NORM} AS n FROM embeddings WHERE vec_id % 20 = 0) q ON v.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def t2_chunk_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest among the vectors of the current model only."""
    vectors = table(spark, sf_dir, "embeddings")
    return ranking.knn(vectors.where("vec_id % 4 <> 0"), vectors.where("vec_id % 20 = 0"), 5)
