import random

from pyspark.sql import functions as F

from corpalith.operators import chunking, packing

ROW = "doc_id long, text string"


def made(seed=4, n=60):
    """Texts with headings of all levels, lines of all lengths, and sentences that end near the overlap."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 40)):
            words = " ".join(rng.choice(["word", "été", "a", "policy.", "fee", "💡", "limit. The"]) for _ in range(rng.choice([1, 3, 12, 60, 300, 900])))
            lines.append(rng.choice(["# ", "## ", "###", "###### ", "####### "]) + words[:30] if rng.random() < 0.25 else rng.choice(["", "  ", "\t"]) + words)
            if rng.random() < 0.2:
                lines.append(rng.choice(["", " ", "#", "## ", "　"]))
        out.append((i, "\n".join(lines)))
    return out


def test_as_the_plain_fold(spark):
    rows = made() + [(100, None), (101, ""), (102, "# only a heading"), (103, "\n\n"), (104, "one"), (105, "# a\n# b\nx"), (106, "x" * 5000), (107, "# " + "h" * 2000 + "\nbody")]
    got = {}
    for r in packing.chunks(spark.createDataFrame(rows, ROW), "doc_id", F.col("text")).orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append((r.heading_path, r.text, r.overlap, r.parent))
        assert r.ordinal == len(got[r.id]) - 1 and r.n_tokens == max(1, len(r.text) // 4)
    want = {i: chunking.chunk(chunking.parse_text(text or "")) for i, text in rows}
    assert got == {i: c for i, c in want.items() if c}
    assert sum(map(len, got.values())) > 300 and any(c[2] for chunks in got.values() for c in chunks)


def test_pages_as_lines(spark):
    page = "<head><title>t</title></head><H1 class=x>One</h1><script>var a = '<p>';</script><p>first<b>bold</b></p><h3>Deep</h3><ul><li>item</li></ul><!-- <p>no</p> -->last"
    df = spark.createDataFrame([(1, page), (2, None)], "doc_id long, html string").select("doc_id", packing.marked(F.col("html")).alias("text"))
    lines = [" ".join(x.split()) for x in df.where("doc_id = 1").first().text.split("\n")]
    assert [x for x in lines if x] == ["# One", "first bold", "### Deep", "item", "last"]
    rows = packing.packed(df, "doc_id", F.col("text")).orderBy("id").collect()
    assert [(g.section, g.path, g.first, g["last"]) for g in rows[0].groups] == [(1, ["One"], 1, 2), (2, ["One", "Deep"], 3, 5)]
    assert rows[1].blocks == [] and rows[1].chunks == []


def test_a_very_long_text_takes_time_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(1, "\n".join(f"line {i} of a long text with some words in it" for i in range(n)))], ROW)
        began = time.perf_counter()
        assert packing.chunks(df, "doc_id", F.col("text")).agg(F.sum(F.length("text"))).first()[0] > 40 * n
        return time.perf_counter() - began

    seconds(100)
    small, large = seconds(2000), seconds(20_000)
    assert large < 40 * max(small, 0.5)


def test_chunk_rows_leave_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(chunking, "HELD", 100)
    rows = [(i, "x" * 30, None) for i in range(50)]
    frames = list(chunking._frames(iter(rows), ["id", "text", "none"]))
    assert len(frames) > 10 and max(map(len, frames)) <= 4
    assert [tuple(r)[:2] for f in frames for r in f.itertuples(index=False)] == [r[:2] for r in rows]
    assert list(chunking._frames(iter(()), ["id"])) == []
