"""Truths of the library's own operators on small inputs, and the oracle over the smallest tables."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpalith import catalogue
from corpalith.functions import answers as A
from corpalith.functions import text as T
from corpalith.functions import urls as U
from corpalith.operators import access, changes, chunking, embedding, glossary, mapping, ranking, reports, scope, writes
from corpalith.operators import collections as CO
from corpalith.operators import evidence as EV
from corpalith.streaming import events as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [r.asDict(True) for r in df.collect()]
    if name in catalogue.ORACLE_SQL:
        found = oracle.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        assert sorted(map(repr, map(plain, rows))) == sorted(map(repr, map(plain, want)))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def meta(spark, **over):
    row = {"doc_id": 1, "space": "s", "path": "/a/b", "title": "T", "labels": ["x"], "doc_type": "faq", "age_days": 10, "sensitivity": 1, "acl": "all-staff", "in_store": True} | over
    kinds = "doc_id long, space string, path string, title string, labels array<string>, doc_type string, age_days long, sensitivity int, acl string, in_store boolean"
    return spark.createDataFrame([tuple(row.values())], kinds)


S = scope.Scope


@pytest.mark.parametrize(
    ("rules", "over", "want"),
    [
        (S((("space", "s"),)), {}, None), (S((("space", "t"),)), {}, "no_matching_root"), (S((("space", "s"),)), {"space": None}, "no_matching_root"), (S((("path", "/a"),)), {}, None), (S((("path", "/a/"),)), {"path": "/ab"}, "no_matching_root"),
        (S((("label", "x"),), include=("/z",)), {}, "include_pattern_did_not_match"), (S((("label", "x"),), include=("/a",), exclude=("*DRAFT*",)), {"title": "a DRAFT b"}, "exclude_pattern_matched"),
        (S((("label", "x"),), exclude=("/a/?",)), {}, "exclude_pattern_matched"), (S((("space", "s"),), labels_any=("y",)), {}, "required_label_absent"), (S((("space", "s"),), labels_none=("x",)), {}, "forbidden_label_present"),
        (S((("space", "s"),), labels_any=("y",)), {"labels": None}, "required_label_absent"), (S((("space", "s"),), doc_types=("page",)), {}, "doc_type_not_in_scope"), (S((("space", "s"),), doc_types=("page",)), {"doc_type": None}, None),
        (S((("space", "s"),), oldest_days=5), {}, "updated_before_window"), (S((("space", "s"),), newest_days=50), {}, "updated_after_window"), (S((("space", "s"),), oldest_days=5, newest_days=50), {"age_days": None}, None),
        (S((("space", "s"),), ceiling=0), {}, "above_sensitivity_ceiling"), (S((("path", "/[!a]/*"),)), {}, "no_matching_root"),
    ],
)
def test_scope_rules(spark, rules, over, want):
    assert meta(spark, **over).select(scope.exclusion_rule(rules)).first()[0] == want


def test_scope_needs_a_root():
    with pytest.raises(ValueError):
        S(())


def test_roles_and_gates(spark):
    rule = access.RoleRule
    reason = lambda rules, **over: meta(spark, **over).select(access.role_reason(rules)).first()[0]
    assert reason([]) == "no role rules"
    assert reason([rule("deny")]) == "no allow list; not denied"
    assert reason([rule("allow", space="s"), rule("deny", label="x")]) == "denied by rule on label x"
    assert reason([rule("deny", space="s", label="y"), rule("allow", space="s")]) == "allowed by rule on space s"
    assert reason([rule("allow", space="t")]) == "outside this role's allow list"
    gate = lambda groups=(), rules=(), **over: access.gates(meta(spark, **over), S((("space", "s"),)), list(groups), list(rules)).first().dropped_by
    assert gate() is None and gate(in_store=False, acl="hr") == "stale_index" and gate(acl="hr", space="t") == "forbidden" and gate(["hr"], acl="hr") is None
    assert gate(["service"], acl="hr", space="t") == "no_matching_root" and gate(age_days=1095) == "archive_tier" and gate(rules=[rule("deny", space="s")]) == "role_rule"
    ages = spark.createDataFrame([(None,), (179,), (180,), (365,), (1095,)], "age long")
    assert [r[0] for r in ages.select(access.staleness(F.col("age"))).collect()] == ["unknown_age", "fresh", "ageing", "stale", "expired"]


def test_text(spark):
    assert one(spark, T.stem, "policies", "boxes", "cats", "ies", "was") == ["policy", "box", "cat", "ies", "was"]
    assert one(spark, T.question_kind, "Hello!", "What can you tell me about surveys", "what can you tell me about survey budgets in detail per region", "", None) == ["social", "scope", "content", "content", "content"]
    assert one(spark, T.declines, "The passages do not mention it.", "The policy does not cover flood damage.", "I could not find anything.", "It is fine. The documents describe the rest.", None, "The information provided does not say.") == [True, False, True, False, False, True]
    assert one(spark, T.content_terms, "Tell me how the refund-policy works for it") == [["refund-policy", "works"]]
    assert one(spark, T.sensitive_classes, "a@b.co and +1 (168) 555-5254", "token = \"dfd1944d2e84f15e\"") == [["email", "phone"], ["secret"]]
    assert one(spark, T.redacted, "a@b.co!") == ["[email]!"]


def test_trimmed_lists(spark):
    assert one(spark, mapping.COERCIONS["csv_list"], "a, 1x , 2 2 ,") == [["a", "1x", "2 2"]]
    line = "10 green bottles are hanging on the wall of the house by the sea"
    assert one(spark, T.summary, "short\n " + line + " 1 ") == [line + " 1"]


def test_urls(spark):
    assert one(spark, U.normalise, "HTTP://www.A.com:443//x//y/?utm_source=1&b=2&a=1#f", "a.com/x", "https://a.com") == ["a.com/x/y?a=1&b=2", "a.com/x", "a.com"]
    assert one(spark, U.extract, "see https://a.com/x. and (http://b.org) https://a.com/x") == [["https://a.com/x", "http://b.org"]]


def test_ranking(spark):
    fused = ranking.fuse(spark.createDataFrame([(1, "a", 5, 1), (1, "b", 5, 2), (1, "a", 6, 2), (1, "b", 7, 1)], "question_id int, channel string, doc_id int, rank int"))
    assert [(r.doc_id, r.rank) for r in fused.orderBy("rank").collect()] == [(5, 1), (7, 2), (6, 3)]
    asked = spark.createDataFrame([(1, "the refund window"), (2, "the of"), (3, "window refund")], "question_id int, text string")
    docs = spark.createDataFrame([(7, "refund window is long\nfor a refund"), (8, "nothing here"), (9, None)], "doc_id int, text string")
    hits = spark.createDataFrame([(q, d) for q in (1, 2, 3) for d in (7, 8, 9)], "question_id int, doc_id int")
    got = {(r.question_id, r.doc_id): r.rerank_score for r in ranking.rerank(hits, asked, docs).collect()}
    held = 0.55 + 0.15 * min(1, 2 / (1 + 6 / 120)) + 0.15 * 3 / 7 + 0.15  # 2 of 6 words, at 3 of 7 places, and in the first line
    assert got == {(1, 7): min(1, round(held + 0.25, 6)), (3, 7): round(held, 6)} | {(q, d): 0.0 for q in (1, 2, 3) for d in (7, 8, 9) if (q, d) not in ((1, 7), (3, 7))}
    assert [r.doc_id for r in ranking.lexical(docs.withColumn("title", F.lit("a Refund")), asked, 5).where("question_id = 1").collect()] == [7]
    good = ranking.grounded(spark.createDataFrame([("refund policies", "our policy on refunds"), ("the", "x"), ("flood damage", "fire")], "question string, evidence string")).collect()
    assert [(r.coverage, r.covered) for r in good] == [(1.0, True), (1.0, True), (0.0, False)]
    ranked = spark.createDataFrame([(1, d, p, 0.5, i) for i, (d, p) in enumerate([(1, "a"), (1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, None), (2, "e")])], "question_id int, doc_id int, same string, score double, rank int")
    assert [(r.doc_id, r.same) for r in ranking.select_passages(ranked, 0.1).orderBy("marker").collect()] == [(1, "a"), (1, "b"), (1, "c"), (2, "e")]


def test_changes(spark):
    long = " ".join(f"w{i}" for i in range(60))
    old = spark.createDataFrame([(1, "a b"), (2, "x\ny"), (3, long), (4, "gone"), (5, "A b.")], "doc_id int, text string")
    new = spark.createDataFrame([(1, "a b"), (2, "y\nx"), (3, long + " more"), (6, "new"), (5, "a B")], "doc_id int, text string")
    got = {r.doc_id: (r.verdict, r.similarity) for r in changes.verdicts(old, new).collect()}
    assert got == {1: ("identical", None), 2: ("reordered", None), 3: ("changed", round(56 / 57, 4)), 4: ("gone", None), 5: ("cosmetic", None), 6: ("new", None)}
    kept = changes.insert_or_ignore(old, spark.createDataFrame([(1, "z"), (9, "z"), (9, "z")], "doc_id int, text string"), ["doc_id"])
    assert kept.count() == 6
    assert changes.replace_children(old, new.where("doc_id = 1"), "doc_id").count() == 5


def test_chunks(spark):
    page = "<h1>A</h1><p>one</p><h2>B</h2><p>" + "word " * 300 + "</p><table><tr><td>x</td></tr></table><p>tail &amp; end</p><script>no</script>"
    blocks = chunking.parse_html(page)
    assert [b[0] for b in blocks] == ["heading", "paragraph", "heading", "paragraph", "table", "paragraph"]
    got = chunking.chunk(blocks)
    assert got[0][:2] == ("A", "# A\n\none") and [c[0] for c in got[1:]] == ["A > B"] * (len(got) - 1) and got[-1][1].endswith("tail & end")
    assert chunking.chunk([("heading", 1, "A"), ("heading", 2, "B"), ("paragraph", 0, "text")]) == [("A > B", "## B\n\ntext", "", "## B\n\ntext")]  # a heading alone is no chunk
    steps = [x for i in range(3) for x in (("heading", 2, f"Step {i}"), ("paragraph", 0, f"Do {i}."))]
    assert [c[:2] for c in chunking.chunk(steps)] == [("Step 0", "## Step 0\n\nDo 0.\n\n## Step 1\n\nDo 1.\n\n## Step 2\n\nDo 2.")]  # runts merge across headings
    long = [("heading", 1, "H"), *(("paragraph", 0, "word " * 150) for _ in range(4))]
    assert [bool(c[2]) for c in chunking.chunk(long)] == [False, True] and all(c[3].startswith("# H") and len(c[3]) <= 3600 for c in chunking.chunk(long))
    docs = spark.createDataFrame([(1, "p one\n\np two"), (2, None), (3, "")], "doc_id long, text string")
    a = sorted(map(tuple, chunking.chunks(docs, "doc_id", "text").collect()))
    assert a == sorted(map(tuple, chunking.chunks(docs.repartition(3), "doc_id", "text").collect())) and [r[0] for r in a] == [1]


def test_mapping(spark):
    raw = spark.createDataFrame([("2026-01-02", "1"), ("bad", "x"), (None, "3")], "d string, n string")
    got = {r.target: r for r in mapping.validate(raw, {"d": ("d", "date_iso"), "n": ("n", "int")}).collect()}
    assert (got["d"].present, got["d"].parsed, got["d"].blocking, got["n"].parsed) == (2, 1, True, 2)
    assert raw.limit(1).select(mapping.COERCIONS["date_iso"](F.col("d"))).first()[0] == dt.date(2026, 1, 2)


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = E.tumbling(E.read(spark, str(tmp_path / "in"), 10))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    want = E.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    assert sorted(map(repr, spark.table("tumbling").collect())) == sorted(map(repr, want))


def test_evidence(spark):
    kinds = spark.createDataFrame([(None, "Refund Policy", ""), (None, "x", "You must. It shall. They should."), ("faq", "Refund Policy", ""), (None, "x", "must")], "m string, t string, b string")
    got = [r[0].asDict() for r in kinds.select(EV.classify(F.col("m"), F.col("t"), F.col("b"))).collect()]
    assert [(g["doc_type"], g["confidence"]) for g in got] == [("policy", 0.85), ("specification", 0.65), ("faq", 1.0), ("page", 0.3)]
    assert [c[:3] for c in EV.claims_of("An overdraft fee of $35 is assessed. Give 10 days past due notice by 15 April 2024. Last updated 3 years ago.")] == [("currency", "currency overdraft fee", "35"), ("days", "days past due", "10")]
    text = "The notice period for ending a contract is {} days before the end of term"
    rows = [(1, 1, None, text.format(5)), (1, 2, None, text.format(7)), (1, 3, "state-a", text.format(5)), (1, 4, "state-b", text.format(7)), (2, 5, None, text.format(9))]
    found = EV.conflicts(EV.claims(spark.createDataFrame(rows, "question_id long, doc_id long, scope string, passage string")))
    assert sorted((r.doc_a, r.doc_b) for r in found.collect()) == [(1, 2), (1, 4), (2, 3)]
    cases = [("answers", "", "a", True), ("refuses", "", "a", True), ("says", "B  c", "x b C.", True), ("does_not_say", "b", "b", True), ("cites", "Doc", "a", False), ("cites_first", "two", "a", True), ("odd", "", "", True)]
    df = spark.createDataFrame([(i, *c, ["my doc", "two"]) for i, c in enumerate(cases)], "case_id int, kind string, value string, answer string, grounded boolean, cited array<string>")
    assert [r.failure for r in EV.check(df).orderBy("case_id").collect()] == [None, "answered", None, "said", None, "not first", "unknown expectation"]


def test_url_ladder(spark):
    frame = lambda rows: ("key", spark.createDataFrame(rows, "by string, n long, doc_id long"))
    keys = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    got = {r.key: (r.doc_id, r.rung, r.outcome) for r in CO.resolve(keys, {"exact": frame([("a", 1, 1), ("b", 2, 1)]), "title": frame([("a", 1, 9), ("c", 1, 3)])}).collect()}
    assert got == {"a": (1, "exact", "accepted"), "b": (None, "exact", "ambiguous"), "c": (None, "title", "ambiguous"), "d": (None, None, "unresolved")}


def test_figures_and_verdicts(spark):
    said = lambda answer, sources="", asked="": one(spark, lambda c: A.supported(c, F.lit(sources), F.lit(asked)), answer)[0]
    assert one(spark, A.figures, "1,284 and 42% and 3.50 and 7.") == [["1284", "42", "3.5", "7"]]
    assert said("1284 in all [page].", "we have 1,284").removed == [] and said("42% [d1].", "42 of them").removed == []
    bad = said("There are 32 [page]. It rose [1].", "30")
    assert bad.removed == ["There are 32 [page]."] and bad.kept == "It rose [1]." and bad.survives
    assert not said("There are 32 [page].", "30").survives and said("In 32 cases [page].", "", "why 32?").removed == [] and said("32 [1].").removed == []
    verdict = lambda text: one(spark, lambda c: A.verdict(c, F.lit(2), F.lit(True), F.lit(1)), text)[0].reason
    assert [verdict(t) for t in ("a [1]", "a [3]", "a [page]", "a [d2]", "a", None, "I could not find it [1]")] == [None, "invented_citation", None, "fabricated_data", "uncited", "uncited", "declined"]
    assert one(spark, A.labelled_date, "updated soon. Updated: 3rd March 2020", "Updated: 31/02/2020", "Issued 2020-01-02, last reviewed 5 May 2021", None, "updated " + "x" * 50 + " 2020-01-01") == [
        dt.date(2020, 3, 3), None, dt.date(2021, 5, 5), None, None]
    assert one(spark, A.page_context, "a\x00b", None)[0].text == "a b"
    long = one(spark, A.page_context, "word " * 400)[0]
    assert long.truncated and len(long.text) <= 1200 and long.text.endswith("word")
    assert one(spark, A.single_shot, "Compare a and b", "short question", "where is " + "x " * 20, "tell " * 9) == [False, True, True, False]
    assert one(spark, lambda c: A.fetches_live(c, F.lit("k"), F.lit(True)), "what is my total", "what is tax", None) == [True, False, False]
    assert one(spark, lambda c: A.origin_allowed(c, []), None, "https://a") == [True, False]


def test_glossary_and_vectors(spark):
    docs = spark.createDataFrame([(2, "Value Added Tax (VAT) and VAT."), (1, "VAT (value of a thing)"), (3, "NPS NPS"), (4, "the NPS"), (5, "NPS POST"), (6, None)], "doc_id long, text string")
    got = {r.term: (r.expansion, r.documents, r.occurrences) for r in glossary.discover(docs).collect()}
    assert got == {"VAT": ("value of a thing", 2, 3), "NPS": (None, 3, 4)}
    stored = spark.createDataFrame([("VAT", "kept", "confirmed"), ("OLD", "x", "proposed")], "term string, expansion string, status string")
    assert {(r.term, r.expansion, r.status, r.documents) for r in glossary.refreshed(stored, glossary.discover(docs)).collect()} == {("VAT", "kept", "confirmed", 2), ("OLD", "x", "proposed", 0), ("NPS", None, "proposed", 3)}
    terms = {"POA": ["power of attorney", "durable POA"], "port": [], "IT": ["information technology"]}
    assert one(spark, lambda c: glossary.expanded(c, terms), "a POA", "important it is", "IT and a power of attorney", None) == [["power of attorney", "durable POA"], [], ["information technology", "POA", "durable POA"], []]
    cells = embedding.embed(spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")).collect()
    assert {r.id for r in cells} == {1, 4} and abs(sum(r.weight**2 for r in cells if r.id == 1) - 1) < 1e-4
    fields = spark.createDataFrame([("k", i, f) for i, f in enumerate(("documentNumber", "docTitle", "lastModified", "tags", "readGroups", "other"))], "kb string, place int, field string")
    assert {(r.target, r.field, r.coercion) for r in mapping.suggest(fields).collect()} == {
        ("doc_id", "documentNumber", "string"), ("title", "docTitle", "string"), ("updated_at", "lastModified", "date_iso"), ("labels", "tags", "csv_list"), ("acl_principals", "readGroups", "string_list")}


def test_writes_and_reports(spark):
    turns = spark.createDataFrame([(1, 5, "b"), (1, 4, "a"), (2, 0, "c")], "thread_id int, place int, text string")
    stored = spark.createDataFrame([(1, 0, "first"), (1, 1, "second")], "thread_id int, ordinal int, text string")
    assert {tuple(r) for r in writes.append_turns(stored, turns).collect()} == {(1, 2, "a", "first"), (1, 3, "b", "first"), (2, 0, "c", "c")}
    titles = lambda *t: reports.common_suffix(spark.createDataFrame([(x,) for x in t], "title string")).collect()
    assert titles("a | S", "b | S", "c | S", "d")[0].suffix == " | S" and titles("a | S", "b | S") == [] and titles("a | S", "b", "c") == []
    empty = spark.createDataFrame([], "doc_id long, age_days long, ok boolean")
    assert [r.passed for r in reports.probe(empty, F.col("ok"), F.col("ok")).collect()] == [False, False, None, None, None]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ranking.knn(vectors, vectors.where("vec_id = 0"), 2).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    use = reports.term_use(spark.createDataFrame([(1, "port Port"), (2, "important")], "doc_id int, text string"), spark.createDataFrame([("port",), ("zz",)], "term string"))
    assert {tuple(r) for r in use.collect()} == {("port", 1, 2), ("zz", 0, 0)}
