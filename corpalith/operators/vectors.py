"""An inverted-file index of vectors: lists around centroids, a few of which are probed for each query.

Centroids are fitted on a bounded sample; every vector is assigned to the list of its nearest one.
A query meets the vectors of the lists whose centroids are nearest to it, scored exactly. How many
lists that takes is measured: for a bounded sample of queries all lists are searched, and the places
of the true neighbours' lists give the recall of every number of probes. ``exact`` goes on with each
list that may still hold a nearer vector, by its reach.

Long lists are cut into parts and many queries of a list into blocks, so a task holds a bounded number
of both, however many equal vectors there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpalith.sources.kept import written

#: Vectors that centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 10
#: Lists at most, and bytes of their centroids at most: these go to every task.
LISTS, CENTROID_BYTES = 4096, 32 << 20
#: Vectors of a part, queries of a block.
PART, BLOCK = 8192, 2048
#: Queries that the number of probes is measured with, and the recall aimed at for them.
TUNING, RECALL = 200, 0.95


class Index(NamedTuple):
    """``vectors(vec_id, list, embedding)``, the lists' centroids (unit vectors), numbers of vectors and reaches.

    A list's reach is the largest angle of one of its vectors to its centroid; a list that holds a zero
    vector, which has no angle, reaches everywhere.
    """

    vectors: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    reach: np.ndarray

    def parts(self) -> np.ndarray:
        return np.maximum(1, -(-self.sizes // PART))


def usable(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, embedding) of the rows with an id and a vector of ``width`` finite numbers."""
    whole = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("vec_id").isNotNull() & (F.size("embedding") == width) & whole)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; zero rows stay."""
    x = x.astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit rows; a centroid that no row is nearest to stays where it is."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 1e-12, sums / np.where(size > 1e-12, size, 1), centroids)
    return centroids


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> Index | None:
    """An index of ``vectors(vec_id, embedding)``; None if there is no vector.

    The width is that of the first vector of the sample (the ``sample`` rows of least id hash); rows
    without an id, of another width or with numbers that aren't finite are left out. Repeated rows are
    indexed as they are. Without ``lists`` there are as many as the square root of the rows, within bounds.
    """
    known = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    first = known.orderBy(F.xxhash64("vec_id"), "vec_id").select(F.size("embedding").alias("width")).first()
    if first is None:
        return None
    width = first["width"]
    rows = usable(vectors, width)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    if not len(chosen):
        return None
    # A zero vector has no direction to fit.
    fitted = unit(_matrix(chosen["embedding"], width))
    fitted = fitted[(fitted != 0).any(axis=1)]
    n = lists or min(math.isqrt(rows.count()), LISTS)
    n = max(1, min(n, CENTROID_BYTES // (8 * width), len(fitted)))
    centroids = fit_centroids(fitted, n) if len(fitted) else np.zeros((1, width))
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(_matrix(batch.column(1), width))
            cosines = x @ shared.value.T
            near = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(x)), near], -1, 1))
            angle[~(x != 0).any(axis=1)] = np.pi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(angle)], names=["vec_id", "embedding", "list", "angle"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"vec_id {kind}, embedding array<float>, list int, angle double")
    # By ranges of lists, so that probing few lists reads few row groups; a long list spans several ranges.
    placed = written(placed.repartitionByRange("list", F.xxhash64("vec_id")).sortWithinPartitions("list"))
    sizes, reach = np.zeros(n, np.int64), np.zeros(n)
    for row in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect():  # one row for each list
        sizes[row["list"]], reach[row["list"]] = row["n"], row["reach"]
    return Index(placed.select("vec_id", "list", "embedding"), centroids, sizes, reach)


def _probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, query, list, place, bound): each query's ``probes`` nearest lists, by place from 1.

    ``bound`` is the most that a vector of the list can score. A zero query scores 0 everywhere, so only
    all lists are enough for it.
    """
    width, shared = index.centroids.shape[1], queries.sparkSession.sparkContext.broadcast((index.centroids, index.reach, index.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, reach, sizes = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # few at a time, as each makes ``probes`` rows
                batch = whole.slice(at, 256)
                x = unit(_matrix(batch.column(1), width))
                cosines = np.where(sizes > 0, x @ centroids.T, -2.0)
                order = np.argsort(-cosines, axis=1, kind="stable")[:, :probes]
                near = np.take_along_axis(cosines, order, axis=1)
                angle = np.arccos(np.clip(near, -1, 1)) - reach[order]
                bound = np.where((x != 0).any(axis=1)[:, None], np.cos(np.clip(angle, 0, np.pi)), 1.0)
                bound[near < -1.5] = -2.0  # empty lists
                rows = np.repeat(np.arange(len(x)), order.shape[1])
                columns = [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *map(pa.array, (order.ravel().astype(np.int32), np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(x)), bound.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query", "list", "place", "bound"])

    asked = usable(queries, width).toDF("query_id", "query")
    kind = asked.schema["query_id"].dataType.simpleString()
    return asked.mapInArrow(run, f"query_id {kind}, query array<float>, list int, place int, bound double").where("bound > -2")


def _numbers(values: np.ndarray) -> Column:
    """``values[list]`` as a column."""
    return F.element_at(F.lit(values.tolist()), F.col("list") + 1)


def _scored(index: Index, probed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, place): the best ``k`` of each query in each part of a probed list, by score and id.

    Cosines in double precision, rounded to six decimals; a zero vector scores 0. A query does not meet
    the vector of its own id.
    """
    width = index.centroids.shape[1]
    parts = index.parts()
    asked = np.zeros(len(parts), np.int64)
    for row in probed.groupBy("list").count().collect():  # one row for each list
        asked[row["list"]] = row["count"]
    blocks = np.maximum(1, -(-asked // BLOCK))
    left = probed.withColumn("block", F.pmod(F.xxhash64("query_id"), _numbers(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _numbers(parts) - 1)))
    right = index.vectors.where(F.col("list").isin(np.flatnonzero(asked).tolist())) if (asked == 0).any() else index.vectors
    right = right.withColumn("part", F.pmod(F.xxhash64("vec_id"), _numbers(parts))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _numbers(blocks) - 1)))
    names = ["query_id", "vec_id", "score", "place"]

    def meet(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, query_ids = vectors["vec_id"].combine_chunks(), queries["query_id"].combine_chunks()
        if not len(ids) or not len(query_ids):
            return pa.Table.from_arrays([query_ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.int32())], names=names)
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        ids = ids.take(pa.array(order))
        x, own = unit(_matrix(vectors["embedding"], width)[order]), ids.to_numpy(zero_copy_only=False)
        places, out = queries["place"].to_numpy(), []
        for at in range(0, len(query_ids), 256):
            some = query_ids.slice(at, 256)
            scores = np.round(unit(_matrix(queries["query"].slice(at, 256), width)) @ x.T, 6) + 0.0
            scores[some.to_numpy(zero_copy_only=False)[:, None] == own] = -np.inf
            # Vectors are in the order of their ids, so a stable sort settles ties by id.
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(some)), best.shape[1])
            score, best = np.take_along_axis(scores, best, axis=1).ravel(), best.ravel()
            there = np.isfinite(score)
            out.append(pa.Table.from_arrays([some.take(pa.array(rows[there])), ids.take(pa.array(best[there])), pa.array(score[there]), pa.array(places[at + rows[there]])], names=names))
        return pa.concat_tables(out)

    kinds = [probed.schema["query_id"].dataType.simpleString(), index.vectors.schema["vec_id"].dataType.simpleString()]
    keys = ["list", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double, place int")


def _best(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tuned_probes(index: Index, queries: DataFrame, k: int, recall: float = RECALL, sample: int = TUNING) -> int:
    """How many lists to probe: as many as find the share ``recall`` of the true neighbours of ``sample`` queries (those of least id hash)."""
    some = queries.where(F.col("vec_id").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    every = len(index.centroids)
    found = _best(_scored(index, _probed(index, some, every), k), k).select("place").toArrow()  # sample x k rows at most
    places = np.sort(found["place"].to_numpy())
    return int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) if len(places) else every


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` best of each of ``queries(vec_id, embedding)`` in its ``probes`` nearest lists, ties by id.

    Scores are exact cosines; vectors of lists that aren't probed are missed. Without ``probes`` their
    number is measured for ``recall``. Queries that the index could not hold itself are left out.
    """
    probes = probes or tuned_probes(index, queries, k, recall)
    return _best(_scored(index, written(_probed(index, queries, probes)), k), k).select("query_id", "vec_id", "score", "rank")


def exact(index: Index, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """As ``search``, without misses: after the first ``probes`` lists each list follows whose reach leaves room for a better score.

    Where vectors lie in clusters few lists follow; where they lie at random most do.
    """
    every = written(_probed(index, queries, len(index.centroids)))
    first = written(_best(_scored(index, every.where(F.col("place") <= probes), k), k).select("query_id", "vec_id", "score"))
    enough = first.groupBy(F.col("query_id").alias("q")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    rest = every.where(F.col("place") > probes).join(enough, F.col("query_id") == F.col("q"), "left")
    # A score rounds by up to half a millionth; a tie can still be won by a lesser id.
    rest = written(rest.where((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") >= F.col("least") - 1e-6)).select(every.columns))
    return _best(first.union(_scored(index, rest, k).select("query_id", "vec_id", "score")), k)
