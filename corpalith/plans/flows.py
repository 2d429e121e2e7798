"""Queries of state that moves: publishing, runs, audits, refreshes, jobs, supersession and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpalith.functions import text as T
from corpalith.operators import flows, order, scope
from corpalith.plans import queries as Q
from corpalith.plans.measures import _CASES, _cases
from corpalith.plans.queries import query
from corpalith.sources.corpus import CATALOGUE_SQL, table

_n = lambda c: F.count(F.when(c, 1))
_NEW = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || '!' ELSE text END AS body FROM documents WHERE doc_id % 7 <> 0"


@query(f"WITH old AS (SELECT doc_id, text AS body, CAST(doc_id % 4 + 1 AS INTEGER) AS version FROM documents WHERE doc_id % 13 <> 0), new AS ({_NEW}) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, md5(CASE WHEN n.doc_id IS NULL THEN o.body ELSE n.body END) AS body, CASE WHEN o.doc_id IS NULL THEN 1 WHEN n.doc_id IS NOT NULL AND o.body IS DISTINCT FROM n.body THEN version + 1 ELSE version END AS version FROM old o FULL JOIN new n ON o.doc_id = n.doc_id")
def k1_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 13 <> 0").select("doc_id", F.col("text").alias("body"), (F.col("doc_id") % 4 + 1).cast("int").alias("version"))
    new = docs.where("doc_id % 7 <> 0").select("doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN text || '!' ELSE text END").alias("body"))
    return flows.published(old, new).withColumn("body", F.md5("body"))


@query("SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.source END, 'old ' || d.lang) AS title, coalesce(p.url, 'none') AS url, p.page_id IS NOT NULL AS loaded FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id AND p.page_id % 5 <> 0")
def k6_loaded_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after a load: what the load doesn't say stays as it was."""
    loaded = table(spark, sf_dir, "pages").where("page_id % 5 <> 0").select("page_id", "url")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(loaded, F.col("doc_id") == F.col("page_id"), "left")
    title = F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.concat(F.lit("old "), "lang"))
    return rows.select("doc_id", title.alias("title"), F.coalesce("url", F.lit("none")).alias("url"), F.col("page_id").isNotNull().alias("loaded"))


@query(f"WITH {_CASES}, t AS (SELECT run, count(*) AS cases, count(*) FILTER (WHERE result = 'passed') AS passed FROM cases GROUP BY run) SELECT run, 'lexical' AS reranker, cases, CAST(passed AS BIGINT) AS passed, CASE WHEN run % 3 = 2 THEN 'open' WHEN passed = cases THEN 'passed' ELSE 'failed' END AS state FROM t")
def k11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the configuration they were opened with; closed ones have their result."""
    totals = _cases(spark, sf_dir).groupBy("run").agg(F.count("*").alias("cases"), _n(F.col("result") == "passed").alias("passed"))
    state = F.when(F.col("run") % 3 == 2, "open").when(F.col("passed") == F.col("cases"), "passed").otherwise("failed")
    return totals.select("run", F.lit("lexical").alias("reranker"), "cases", "passed", state.alias("state"))


@query(f"WITH {CATALOGUE_SQL}, two AS (SELECT kb, {Q._RULE_A} AS was, {Q._RULE_B} AS now FROM catalogue) SELECT kb, 'admin' AS actor, CAST(count(*) FILTER (WHERE was IS NULL) AS BIGINT) AS before, CAST(count(*) FILTER (WHERE now IS NULL) AS BIGINT) AS after, CAST(count(*) FILTER (WHERE was IS NOT NULL AND now IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE was IS NULL AND now IS NOT NULL) AS BIGINT) AS removed FROM two GROUP BY kb")
def k14_scope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that a change of scope leaves, with the counts that were shown when it was saved."""
    two = Q._catalogue(spark, sf_dir).select("kb", scope.exclusion_rule(Q.SCOPE_A).isNull().alias("was"), scope.exclusion_rule(Q.SCOPE_B).isNull().alias("now"))
    was, now = F.col("was"), F.col("now")
    return two.groupBy("kb").agg(F.lit("admin").alias("actor"), _n(was).alias("before"), _n(now).alias("after"), _n(~was & now).alias("added"), _n(was & ~now).alias("removed"))


@query("WITH heads AS (SELECT conv_id, arg_min(text, turn) AS head, count(*) AS turns FROM conversations GROUP BY conv_id) SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'renamed ' || conv_id ELSE substring(head, 1, 60) END AS title, conv_id % 4 = 1 AS pinned, turns FROM heads WHERE conv_id % 4 <> 3")
def k16_threads_patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads after some were renamed, pinned or deleted; what a patch doesn't name stays."""
    heads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("head"), F.count("*").alias("turns")).where("conv_id % 4 <> 3")
    n = F.col("conv_id") % 4
    title = F.when(n == 0, F.concat(F.lit("renamed "), "conv_id")).otherwise(F.substring("head", 1, 60))
    return heads.select("conv_id", title.alias("title"), (n == 1).alias("pinned"), "turns")


_MEMBERS = "m AS (SELECT doc_id, md5(text) AS hash, DATE '2026-01-01' AS first_seen, DATE '2026-02-01' AS last_changed, CASE WHEN doc_id % 21 = 0 THEN DATE '2026-05-05' END AS missing_since FROM documents WHERE doc_id % 13 <> 0), f AS (SELECT doc_id, md5(body) AS hash FROM (" + _NEW + ")), r AS (SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, coalesce(f.hash, m.hash) AS hash, m.first_seen, m.last_changed, m.missing_since, CASE WHEN m.doc_id IS NULL THEN 'new' WHEN f.doc_id IS NULL THEN 'gone' WHEN m.hash = f.hash THEN 'unchanged' ELSE 'changed' END AS verdict FROM m FULL JOIN f ON m.doc_id = f.doc_id)"


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    day = lambda x: F.expr(f"date '{x}'")
    members = docs.where("doc_id % 13 <> 0").select("doc_id", F.md5("text").alias("hash"), day("2026-01-01").alias("first_seen"), day("2026-02-01").alias("last_changed"), F.when(F.col("doc_id") % 21 == 0, day("2026-05-05")).alias("missing_since"))
    found = docs.where("doc_id % 7 <> 0").select("doc_id", F.md5(F.expr("CASE doc_id % 3 WHEN 0 THEN text || '!' ELSE text END")).alias("hash"))
    return flows.refreshed(members, found, day("2026-08-22"))


@query(f"WITH {_MEMBERS} SELECT doc_id, hash, verdict FROM r WHERE verdict IN ('new', 'changed')")
def st10_changed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh hands on to be parsed again: only what its hash says has changed."""
    return _refreshed(spark, sf_dir).where("verdict in ('new', 'changed')").select("doc_id", "hash", "verdict")


@query(f"WITH {_MEMBERS} SELECT doc_id, coalesce(first_seen, DATE '2026-08-22') AS first_seen, CASE WHEN verdict IN ('new', 'changed') THEN DATE '2026-08-22' ELSE last_changed END AS last_changed FROM r")
def w16_seen_and_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).select("doc_id", "first_seen", "last_changed")


@query(f"WITH {_MEMBERS} SELECT doc_id, coalesce(missing_since, DATE '2026-08-22') AS missing_since, coalesce(missing_since, DATE '2026-08-22') < DATE '2026-08-22' - 30 AS remove FROM r WHERE verdict = 'gone'")
def y6_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that the source no longer has; a month after they were first missed they go."""
    gone = _refreshed(spark, sf_dir).where("verdict = 'gone'")
    return gone.select("doc_id", "missing_since", (F.col("missing_since") < F.expr("date '2026-08-22' - interval 30 day")).alias("remove"))


@query(f"WITH {_MEMBERS} SELECT verdict, count(*) AS documents FROM r GROUP BY verdict")
def a17_refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("documents"))


@query(f"WITH {_MEMBERS}, d AS (SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS chunks FROM documents) SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (WHERE verdict IN ('new', 'changed')) AS BIGINT) AS parsed, CAST(count(*) FILTER (WHERE verdict = 'unchanged') AS BIGINT) AS skipped, CAST(coalesce(sum(chunks) FILTER (WHERE verdict IN ('new', 'changed')), 0) AS BIGINT) AS chunks FROM r JOIN d USING (doc_id) WHERE verdict <> 'gone'")
def a18_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What indexing a refresh does: parse what changed, skip the rest, and the chunks that come of it."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), lines.alias("chunks"))
    rows = _refreshed(spark, sf_dir).where("verdict <> 'gone'").join(chunks, F.col("doc_id") == F.col("d"))
    fresh = F.col("verdict").isin("new", "changed")
    return rows.agg(F.count("*").alias("seen"), _n(fresh).alias("parsed"), _n(F.col("verdict") == "unchanged").alias("skipped"), F.coalesce(F.sum(F.when(fresh, F.col("chunks"))), F.lit(0)).alias("chunks"))


@query()
def st2_claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs dealt to workers; the SQL of the oracle has no CRC."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("event_type").alias("kind"))
    return flows.claimed(jobs, 4)


_KINDS = "['crawl_plan', 'materialise', 'enrich', 'refresh', 'index'][event_id % 5 + 1]"


@query(f"SELECT event_id AS job_id, {_KINDS} AS kind, CASE WHEN event_type <> 'error' THEN CASE event_id % 5 WHEN 0 THEN 'crawl_load' WHEN 1 THEN 'enrich' WHEN 2 THEN 'index' WHEN 3 THEN 'index' END END AS next FROM events")
def st4_job_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("crawl_plan", "materialise", "enrich", "refresh", "index")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"), (F.col("event_type") != "error").alias("ok"))
    return rows.select("job_id", "kind", flows.follow_up(F.col("kind"), F.col("ok")).alias("next"))


@query("SELECT user_id, count(*) AS uses, max(ts) AS last_used FROM events WHERE event_type <> 'error' GROUP BY user_id")
def st12_use_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"))


@query(f"""WITH {CATALOGUE_SQL}, c AS (SELECT unnest([{{'facet': 'space', 'value': space}}, {{'facet': 'type', 'value': coalesce(doc_type, 'unknown')}}, {{'facet': 'segment', 'value': string_split(path, '/')[3]}},
  {{'facet': 'age', 'value': CASE WHEN age_days IS NULL THEN 'unknown' WHEN age_days < 90 THEN '0-90' WHEN age_days < 365 THEN '90-365' ELSE '1+y' END}}]) AS x FROM catalogue WHERE in_index) SELECT x.facet AS facet, x.value AS value, count(*) AS documents FROM c GROUP BY ALL""")
def y7_facet_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.when(F.col("age_days").isNull(), "unknown").when(F.col("age_days") < 90, "0-90").when(F.col("age_days") < 365, "90-365").otherwise("1+y")
    facets = {"space": F.col("space"), "type": F.coalesce("doc_type", F.lit("unknown")), "segment": F.get(F.split("path", "/"), F.lit(2)), "age": age}
    cells = F.array(*(F.struct(F.lit(name).alias("facet"), value.alias("value")) for name, value in facets.items()))
    return Q._catalogue(spark, sf_dir).where("in_index").select(F.inline(cells)).groupBy("facet", "value").agg(F.count("*").alias("documents"))


@query(f"WITH {Q._LEXICAL}, kept AS (SELECT question_id FROM lexical JOIN catalogue USING (doc_id) GROUP BY question_id HAVING count(*) FILTER (WHERE ({Q._GATE}) IS NULL) = 0), t AS (SELECT DISTINCT question_id, term FROM asked SEMI JOIN kept USING (question_id)) SELECT term, count(*) AS refused FROM t GROUP BY term HAVING count(*) >= 2")
def y8_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of questions that found nothing they may use, by how many such questions ask for them."""
    from corpalith.operators import access

    hits = Q._lexical(spark, sf_dir).select("question_id", F.col("doc_id").alias("hit"))
    gated = access.gates(hits.join(Q._catalogue(spark, sf_dir), F.col("hit") == F.col("doc_id")), Q.SCOPE_A, ["hr"], Q.RULES)
    refused = gated.groupBy(F.col("question_id").alias("q")).agg(_n(F.col("dropped_by").isNull()).alias("kept")).where("kept = 0")
    asked = Q._questions(spark, sf_dir).join(refused, F.col("question_id") == F.col("q"), "left_semi")
    return asked.select(F.explode(T.search_terms(F.col("text"), 12)).alias("term")).groupBy("term").agg(F.count("*").alias("refused")).where("refused >= 2")


@query("WITH RECURSIVE l AS (SELECT doc_id, doc_id + 10 AS next_id FROM documents WHERE doc_id % 10 < 3 AND doc_id % 100 < 70), c AS (SELECT doc_id, next_id, CAST(1 AS BIGINT) AS hops FROM l UNION ALL SELECT c.doc_id, l.next_id, hops + 1 FROM c JOIN l ON l.doc_id = c.next_id) SELECT doc_id, next_id AS successor, hops FROM c WHERE next_id NOT IN (SELECT doc_id FROM l)")
def y12_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that stands in for a superseded one, however long the chain."""
    links = table(spark, sf_dir, "documents").where("doc_id % 10 < 3 and doc_id % 100 < 70").select("doc_id", (F.col("doc_id") + 10).alias("next_id"))
    return flows.superseded(links, 4)


@query("WITH k AS (SELECT md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || '|' || (conv_id % 2)) AS key, conv_id, turn FROM conversations WHERE role = 'user') SELECT key, count(*) AS asked, count(*) - 1 AS hits FROM k GROUP BY key")
def y14_plan_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans by the hash of the question and the catalogue's version: every later question of a key hits."""
    loose = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    keys = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.md5(F.concat(loose, F.lit("|"), F.col("conv_id") % 2)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("asked"), (F.count("*") - 1).alias("hits"))


@query("SELECT user_id, event_type, max(ts) AS read_at, date_diff('second', max(ts), TIMESTAMP '2024-01-30 00:00:00') > CASE event_type WHEN 'error' THEN 3600 ELSE 86400 END AS stale FROM events GROUP BY user_id, event_type")
def y15_stale_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings too old for their kind when a thread is opened again."""
    events = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("read_at"))
    age = F.unix_seconds(F.expr("timestamp '2024-01-30 00:00:00'")) - F.unix_seconds(F.col("read_at").cast("timestamp"))
    return events.select("user_id", "event_type", "read_at", (age > F.when(F.col("event_type") == "error", 3600).otherwise(86_400)).alias("stale"))


#: What a visitor is told of why something was left out: the first part that a reason holds.
TOLD = (("forbidden", "You may not see this."), ("stale", "This is no longer available."), ("archive", "This is kept for the record only."), ("role", "Your role does not cover this."))


@query(f"WITH {CATALOGUE_SQL}, g AS (SELECT doc_id, {Q._GATE} AS d FROM catalogue) SELECT doc_id, CASE WHEN d IS NULL THEN NULL WHEN contains(d, 'forbidden') THEN 'You may not see this.' WHEN contains(d, 'stale') THEN 'This is no longer available.' WHEN contains(d, 'archive') THEN 'This is kept for the record only.' WHEN contains(d, 'role') THEN 'Your role does not cover this.' ELSE 'This is outside what is covered.' END AS told FROM g")
def x29_visitor_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpalith.operators import access

    rows = access.gates(Q._catalogue(spark, sf_dir), Q.SCOPE_A, ["hr"], Q.RULES)
    told = F.lit("This is outside what is covered.")
    for part, words in reversed(TOLD):
        told = F.when(F.contains("dropped_by", F.lit(part)), words).otherwise(told)
    return rows.select("doc_id", F.when(F.col("dropped_by").isNotNull(), told).alias("told"))


#: Research budgets in seconds, passages and sub-questions.
BUDGETS = {"quick": (90, 30, 3), "standard": (300, 80, 6), "thorough": (600, 160, 10)}


@query("""WITH p(depth, s, n, q) AS (VALUES ('quick', 90, 30, 3), ('standard', 300, 80, 6), ('thorough', 600, 160, 10)), a AS (SELECT conv_id, ['quick', 'standard', 'thorough'][conv_id % 3 + 1] AS depth, CASE WHEN conv_id % 4 = 0 THEN 45 END AS own_s, CASE WHEN conv_id % 5 = 0 THEN 12 END AS own_n FROM conversations WHERE turn = 0)
SELECT conv_id, CASE WHEN own_s IS NOT NULL OR own_n IS NOT NULL THEN 'custom' ELSE depth END AS name, coalesce(own_s, s) AS seconds, coalesce(own_n, n) AS passages, q AS questions FROM a JOIN p USING (depth)""")
def x26_research_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preset's budget with what a caller overrides; any override makes it a custom one."""
    n = F.col("conv_id")
    asked = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.element_at(F.array(*map(F.lit, BUDGETS)), (n % 3 + 1).cast("int")).alias("depth"), F.when(n % 4 == 0, 45).alias("own_s"), F.when(n % 5 == 0, 12).alias("own_n"))
    preset = lambda i: F.create_map(*(F.lit(x) for name, b in BUDGETS.items() for x in (name, b[i])))[F.col("depth")]
    name = F.when(F.col("own_s").isNotNull() | F.col("own_n").isNotNull(), "custom").otherwise(F.col("depth"))
    return asked.select("conv_id", name.alias("name"), F.coalesce("own_s", preset(0)).alias("seconds"), F.coalesce("own_n", preset(1)).alias("passages"), preset(2).alias("questions"))


@query("SELECT event_id, md5(props) AS version, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS nth FROM events QUALIFY lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM props")
def k14_setting_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of a setting: a version is kept only where it differs from the one before."""
    rows = order.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "props"), "user_id", ["ts", "event_id"], before="props")
    return rows.where(~F.col("props").eqNullSafe(F.col("before"))).select("event_id", F.md5("props").alias("version"), F.col("nth").cast("int").alias("nth"))
