import pyarrow as pa
from pyspark.sql import functions as F

from corpalith.llm import common, queries, suffix_lm


def test_small_batches_bring_all_rows(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    before = spark.conf.get(common.BATCH)
    with common.small_batches(spark, 100_000):
        got = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 200_000
    assert spark.conf.get(common.BATCH) == before


def test_the_suffix_tree_bounds_what_enters_and_leaves_python(spark, monkeypatch, tmp_path):
    """Every step of op10 runs on small batches, and what a task gives leaves in frames."""
    spark.createDataFrame([(i, f"a b c {i % 7} " * 9) for i in range(60)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name in ("tokenise", "fit", "score"):
        def step(*a, f=getattr(suffix_lm, name), **k):
            seen.append(spark.conf.get(common.BATCH))
            return f(*a, **k)

        monkeypatch.setattr(suffix_lm, name, step)
    assert queries.op10_suffix_tree(spark, str(tmp_path)).count() == 60
    assert seen == [str(common.BATCH_BYTES)] * 3
    rows = suffix_lm.ROWS * 2 + 5
    cut = list(suffix_lm._cut(pa.RecordBatch.from_arrays([pa.array(range(rows))], names=["n"])))
    assert [b.num_rows for b in cut] == [suffix_lm.ROWS, suffix_lm.ROWS, 5] and pa.Table.from_batches(cut)["n"].to_pylist() == list(range(rows))
