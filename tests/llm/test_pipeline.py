import random

import corpus_pipeline
import pytest

WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak willow yew zelkova ash beech cherry".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with junk, a copy, a near copy, a repeated line and a test item."""
    rng = random.Random(3)
    text = lambda n: "\n".join(" ".join(rng.choice(WORDS) for _ in range(14)) + "." for _ in range(n))
    docs = {i: text(rng.randint(3, 8)) for i in range(120)}
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    passage = " ".join(rng.choice(WORDS) for _ in range(55))
    for i in range(60, 90):
        docs[i] = " ".join(w.upper() + "!!" for w in docs[i].split())
    docs[100] = docs[10]
    docs[101] = docs[11] + "\n" + item
    docs[102] = docs[12] + "\n" + passage
    docs[103] = docs[13] + " extra\n" + text(3) + "\n" + passage
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 90), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, item, passage


def test_run(spark, corpus):
    folder, docs, item, passage = corpus
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert not set(range(60, 90)) & set(kept) and 100 not in kept and 101 not in kept
    assert sum(passage in r.text for r in kept.values()) == 1
    clean = set(range(60)) | set(range(90, 100)) | set(range(104, 120))
    assert clean <= set(kept) and all(kept[i].text == docs[i] for i in clean - {13})
    assert all(0 < r.taken for r in kept.values())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, none, corpus, stage):
    got = stage(spark, odd, corpus[0])
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert got.columns == list(corpus_pipeline.COLUMNS)
    assert got.count() <= odd.count()
    assert stage(spark, none, corpus[0]).count() == 0


def test_near_copies(spark, corpus):
    rng = random.Random(9)
    words = [rng.choice(WORDS) for _ in range(400)]
    near = [*words[:200], "other", *words[201:]]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, " ".join(reversed(words)), "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, corpus[0]).collect()) == [1, 3]


ROW = "doc_id long, text string, lang string, source string, n_chars long"


def some_rows():
    """Texts a (as repeated rows, under another id and without an id), b (sharing an id with a copy of a) and one without an id."""
    rng = random.Random(21)
    a, b, c = (" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(3))
    return a, b, c, [(1, a, "en", "s", 1)] * 3 + [(2, a, "en", "s", 1), (2, b, "en", "s", 1), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1)]


def test_one_row_of_each_text_stays(spark, corpus):
    a, b, c, rows = some_rows()
    got = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, ROW), corpus[0]).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (2, b), (0, c)])


def test_items_go_by_their_text(spark, corpus):
    a, b, _, _ = some_rows()
    docs = spark.createDataFrame([(1, f"{a} {corpus[2]}", "en", "s", 1), (1, b, "en", "s", 1), (None, f"{b} {corpus[2]}", "en", "s", 1), (None, a, "en", "s", 1), (3, None, "en", "s", 1)], ROW)
    got = corpus_pipeline.decontaminate_stage(spark, docs, corpus[0]).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, b), (0, a), (3, "")])


def test_mix_keeps_repeated_rows_apart(spark, corpus):
    rows = spark.createDataFrame(some_rows()[3], ROW)
    want = corpus_pipeline.mixing.mix(rows).where("taken > 0")
    got = corpus_pipeline.mixing_stage(spark, rows, corpus[0])
    assert sorted(r.taken for r in got.collect()) == sorted(r.taken for r in want.collect())


def test_short_lines_that_repeat_go(spark, corpus):
    """Exact repeats go whatever their length, also without blanks between words; near ones of few words and blank lines stay."""
    long = "这是一个没有空格的长句子" * 4
    rows = [(1, f"Read more\n\n{long}\nfirst", "en", "s", 1), (2, f"read  more\n\n{long}\nsecond", "en", "s", 1), (3, "Read less\n \nthird", "en", "s", 1)]
    got = corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, ROW), corpus[0]).collect()
    assert {r.doc_id: r.text for r in got} == {1: rows[0][1], 2: "\nsecond", 3: rows[2][1]}
