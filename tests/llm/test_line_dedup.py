import random

from corpalith.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, least=6):
    seen, out = [], {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        for n, line in enumerate(lines):
            words = line.lower().split()
            if words:
                if words in seen or len(words) >= least and any(len(w) >= least and distance(words, w) <= 1 for w in seen):
                    out.setdefault(i, set()).add(n)
                seen.append(words)
    return {i: (len(out.get(i, ())), "\n".join(x for n, x in enumerate(t.split("\n")) if n not in out.get(i, ()))) for i, t in docs}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(4, 40))] for _ in range(30)]
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                at = rng.randrange(len(line))
                line[at : at + rng.choice((0, 1))] = rng.choice(([], ["Zz"], [rng.choice(words)]))
            lines.append(rng.choice((" ", "  ", "\t")).join(line))
        docs.append((i, "\n".join(lines)))
    got = {r.doc_id: (r.n_lines_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_many_variants_of_one_line(spark):
    line = "page {} of the report on the state of everything".split("{}")
    docs = spark.createDataFrame([(i, f"{line[0]}{i}{line[1]}") for i in range(300)], "doc_id long, text string")
    assert [r.doc_id for r in line_dedup.dedup_lines(docs).where("n_lines_dropped = 0").collect()] == [0]


def test_odd_rows(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "n_lines_dropped"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert [(r.text, r.n_lines_dropped) for r in rows if r.doc_id == 2] == [("", 1)]
    assert {r.n_lines_dropped for r in rows if r.doc_id != 2} == {0}  # repeated rows are one document
    assert line_dedup.dedup_lines(none).count() == 0


def test_short_lines_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "short line\nshort line\n\n好的好的", 7, "k", [1]), (2, "好的好的\nlast", 7, "k", [1])], "doc_id long, text string, n_lines_dropped int, __gone string, lines array<int>")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "__gone", "lines", "n_lines_dropped"]
    assert sorted((r.doc_id, r.text, r.n_lines_dropped) for r in got.collect()) == [(1, "short line\n\n好的好的", 1), (2, "last", 1)]


def test_shuffled_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"page {i % 7} of the report on everything\nown line {i}") for i in range(60)], "doc_id long, text string")
    want = sorted(line_dedup.dedup_lines(docs).collect())
    monkeypatch.setattr("corpalith.llm.common.BROADCAST_BYTES", 0)
    assert sorted(line_dedup.dedup_lines(docs).collect()) == want
