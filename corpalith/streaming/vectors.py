"""Vectors of chunks kept up to date from a stream of chunks: a sink that may see a batch again, and pruning.

A table of vectors is a folder of generations. Each batch of a stream writes a folder of its own inside the
current generation, named by the batch's id, so a batch that is replayed after a failure replaces what it
wrote before. Pruning writes what is still wanted as the next generation, and names it the current one last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpalith.operators import embedding
from corpalith.sources.kept import kept

ROW = "chunk_id string, text_hash string, cells array<struct<bucket int, weight double>>, model string, batch long"
#: The batch under which a pruned generation holds what it took over: before every batch of a stream.
TAKEN_OVER = -1


def _latest(rows: DataFrame) -> DataFrame:
    latest = F.row_number().over(Window.partitionBy("chunk_id", "model").orderBy(F.col("batch").desc(), "text_hash"))
    return rows.withColumn("__nth", latest).where("__nth = 1").drop("__nth")


class VectorTable:
    """(chunk_id, text_hash, cells, model, batch) under ``folder``; of a chunk and model the row of the latest batch counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def generation(self) -> int:
        """The current generation: the highest one that was named, 0 before any was."""
        files = self._files()
        named = files.globStatus(self._path("named-*")) or []
        return max((int(x.getPath().getName().rpartition("-")[2]) for x in named), default=0)

    def _batches(self, generation: int) -> str:
        return f"{self.folder}/generation-{generation}"

    def rows(self) -> DataFrame:
        """Every row of the current generation; none if there is no batch yet."""
        where = self._batches(self.generation())
        if not self._files().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{where}/batch-*/_SUCCESS")):
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(f"{where}/batch-*")

    def current(self) -> DataFrame:
        """The row of the latest batch for each chunk and model."""
        return _latest(self.rows())

    def put(self, vectors: DataFrame, batch: int) -> None:
        """Write the vectors of one batch, in place of what the same batch may have written before."""
        rows = vectors.withColumn("batch", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").parquet(f"{self._batches(self.generation())}/batch-{batch}")

    def prune(self, chunks: DataFrame, model: str) -> dict[str, int]:
        """Keep the vectors of ``model`` whose chunk is among ``chunks(chunk_id)``; says how many went for want of a chunk, and with a retired model.

        Must not run beside a stream that writes. A pruning that fails before the end leaves the table as it was.
        """
        now = self.generation()
        there = chunks.select(F.col("chunk_id").alias("c")).distinct()
        held = self.current().join(there, F.col("chunk_id") == F.col("c"), "left")
        counts = held.agg(F.count_if(F.col("c").isNull()).alias("orphans"), F.count_if(F.col("c").isNotNull() & (F.col("model") != model)).alias("retired")).first()
        wanted = held.where((F.col("model") == model) & F.col("c").isNotNull()).drop("c", "batch").withColumn("batch", F.lit(TAKEN_OVER).cast("long"))
        wanted.write.mode("overwrite").parquet(f"{self._batches(now + 1)}/batch-{TAKEN_OVER}")
        self._files().create(self._path(f"named-{now + 1}"), True).close()
        self._files().delete(self._path(f"generation-{now}"), True)
        return counts.asDict()


def embedded(chunks: DataFrame, model: str) -> DataFrame:
    """(chunk_id, text_hash, cells, model) of ``chunks(chunk_id, text)``; a chunk that comes twice keeps its greater text, one without words has no cells."""
    once = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    cells = embedding.embed(once, "chunk_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bucket", "weight"))).alias("cells"))
    rows = once.join(cells, F.col("chunk_id") == F.col("id"), "left")
    return rows.select("chunk_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("cells", F.array().cast("array<struct<bucket int, weight double>>")).alias("cells"), F.lit(model).alias("model"))


def wanting(chunks: DataFrame, current: DataFrame, model: str) -> DataFrame:
    """The ``chunks(chunk_id, text)`` that have no vector of ``model`` for the text they have now."""
    held = current.where(F.col("model") == model).select(F.col("chunk_id").alias("h_id"), F.col("text_hash").alias("h_hash"))
    same = (F.col("chunk_id") == F.col("h_id")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("h_hash"))
    return chunks.join(held, same, "left_anti")


def sink(table: VectorTable, model: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` of a stream of chunks: vectors for those that want one.

    A replayed batch sees the table as it was before it, so it writes the same again. What it writes is
    checkpointed first, as the folder that it replaces may be among those that are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        current = _latest(table.rows().where(F.col("batch") < number))
        table.put(kept(embedded(wanting(batch, current, model), model)), number)

    return write
