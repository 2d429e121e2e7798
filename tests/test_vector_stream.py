import pytest
from pyspark.sql import functions as F

from corpalith.streaming import vectors as VS

ROW = "chunk_id string, text string"


def state(table):
    return {(r.chunk_id, r.model): (r.text_hash, tuple(map(tuple, r.cells))) for r in table.current().collect()}


def wanted(spark, chunks, model="m1"):
    rows = VS.embedded(spark.createDataFrame(list(chunks.items()), ROW), model).collect()
    return {(r.chunk_id, model): (r.text_hash, tuple(map(tuple, r.cells))) for r in rows}


def test_a_replayed_batch_leaves_one_copy(spark, tmp_path):
    """A stream in three files; the last batch runs again by itself, as after a failure between its writing and its commit."""
    table = VS.VectorTable(spark, str(tmp_path / "table"))
    assert state(table) == {}
    parts = [[("a", "refund policy"), ("b", "wire fee")], [("b", "wire fee"), ("c", None), ("a", "refund policy changed")], [("d", "limit"), ("b", "fee"), (None, "lost"), ("d", "limit")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, ROW).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    put = VS.sink(table, "m1")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = wanted(spark, {"a": "refund policy changed", "b": "fee", "c": None, "d": "limit"})
    assert state(table) == want
    before = sorted(map(str, table.rows().collect()))
    for batch in (2, 1, 2, 0):
        put(spark.createDataFrame(parts[batch], ROW), batch)
    assert state(table) == want and len(before) == table.rows().count()


def test_only_what_wants_a_vector_is_embedded(spark, tmp_path):
    table = VS.VectorTable(spark, str(tmp_path))
    first = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "")], ROW)
    VS.sink(table, "m1")(first, 0)
    now = spark.createDataFrame([("a", "one"), ("b", "two more"), ("c", None), ("e", "new")], ROW)
    assert sorted(r.chunk_id for r in VS.wanting(now, table.current(), "m1").collect()) == ["b", "e"]
    assert VS.wanting(now, table.current(), "m2").count() == 4


def test_pruning_drops_orphans_and_retired_models(spark, tmp_path, monkeypatch):
    table = VS.VectorTable(spark, str(tmp_path))
    VS.sink(table, "m1")(spark.createDataFrame([("a", "one"), ("gone", "two")], ROW), 0)
    VS.sink(table, "m2")(spark.createDataFrame([("a", "one"), ("b", "three"), ("gone", "two")], ROW), 1)
    there = spark.createDataFrame([("a",), ("b",), ("never",)], "chunk_id string")
    held = state(table)
    with monkeypatch.context() as m:  # a pruning that ends before the new generation is named changes nothing
        m.setattr(VS.VectorTable, "_path", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.prune(there, "m2")
    assert state(table) == held
    assert table.prune(there, "m2") == {"orphans": 2, "retired": 1}
    assert state(table) == wanted(spark, {"a": "one", "b": "three"}, "m2") and table.generation() == 1
    assert table.prune(there, "m2") == {"orphans": 0, "retired": 0}
    VS.sink(table, "m2")(spark.createDataFrame([("b", "four")], ROW), 7)
    assert state(table) == wanted(spark, {"a": "one", "b": "four"}, "m2")
    assert table.prune(there.where(F.lit(False)), "m2")["orphans"] == 2 and state(table) == {}
