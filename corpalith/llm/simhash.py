"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made once per document, distinct ones are compared exactly with numpy
exclusive-or and bit counts, and linked fingerprints are merged to components.

Comparing all tiles of N fingerprints costs N*N. Two fingerprints within ``radius`` bits agree
on at least ``bands - radius`` of any ``bands`` disjoint bit ranges, so tiles are cut inside
groups that agree on such a choice: no link is lost, and groups stay small because the number
of bands grows with the number of fingerprints. A group over ``tile`` rows is dealt to tiles by
population count, and a cell is made only for each pair of tiles whose population counts can be
within the radius, so no task holds more than two tiles. Inside a cell rows are ordered by
population count and pairs of smaller tiles beyond the radius are skipped as well. A cell gives
back a spanning star of each set it links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import durable, hot_join, like, slices
from corpalith.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a UTF-8 text as a signed integer; 0 if it has no word.

    A bit is 1 if it is set in more than half of the shingles' hashes, repeats included.
    """
    words = text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    hashed = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), [flat[a:b] for a, b in zip(starts, stops, strict=True)]), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(hashed[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(data, shingle, seed) for _, part in slices(batch, "text", 8 << 20) for data in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    picked = like(docs, id_col, text_col).toDF("id", "text")
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, fp long")


def masks(bands: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of ``bands - radius`` bands, as signed integers."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    whole = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(bands)]
    chosen = [sum(whole[i] for i in pick) for pick in combinations(range(bands), bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def bands_for(n: int, radius: int = RADIUS, fill: int = 2048) -> int:
    """The least number of bands for which a group holds about ``fill`` of ``n`` fingerprints or fewer."""
    for bands in range(radius + 1, 2 * radius + 5):
        if n >> min(63, 64 * (bands - radius) // bands) <= fill:
            return bands
    return 2 * radius + 4


def tile_pairs(fps: np.ndarray, radius: int, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices of fingerprints within the radius, tile by tile; tiles are ordered by population count, and pairs of tiles beyond the radius are skipped."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    x, pc = fps[order], counts[order].astype(np.int64)
    for i in range(0, len(x), tile):
        a, top = x[i : i + tile], pc[min(i + tile, len(x)) - 1]
        for j in range(i, len(x), tile):
            if pc[j] - top > radius:
                break
            p, q = np.nonzero(np.bitwise_count(a[:, None] ^ x[None, j : j + tile]) <= radius)
            keep = p + i < q + j
            yield order[p[keep] + i], order[q[keep] + j]


def linked(fps: np.ndarray, radius: int = RADIUS, tile: int = 512) -> np.ndarray:
    """For each fingerprint the index of a member that stands for its linked set."""
    label = np.arange(len(fps))
    for p, q in tile_pairs(fps, radius, tile):
        _merge(label, p, q)
    return label


def _merge(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Least label over links, in place; labels point to members, so later merges carry over."""
    while len(p):
        before = label.copy()
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, label[p], low)
        np.minimum.at(label, label[q], low)
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label[:] = label[label]
        if np.array_equal(before, label):
            return


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Cells arrive in order; a cell may go on in the next batch and is at most two tiles."""
    rest: np.ndarray | None = None
    names = ["k", "v", "lo", "hi", "fp", "rep"]

    def edges(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
        out_u, out_v = [], []
        for part in np.split(rows, cut):
            if len(part) > 1:
                reps = part[:, 5]
                label = linked(np.ascontiguousarray(part[:, 4]).view(np.uint64), radius)
                least = np.full(len(part), np.iinfo(np.int64).max)
                np.minimum.at(least, label, reps)
                roots = least[label]
                far = roots != reps
                out_u.append(reps[far])
                out_v.append(roots[far])
        return (np.concatenate(out_u), np.concatenate(out_v)) if out_u else (np.empty(0, np.int64), np.empty(0, np.int64))

    def batch_of(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["u", "v"])

    for batch in batches:
        rows = np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
        if rest is not None:
            rows = np.concatenate((rest, rows))
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
        cut = last[-1] + 1 if len(last) else 0
        rest = rows[cut:]
        if cut:
            yield batch_of(edges(rows[:cut]))
    if rest is not None and len(rest):
        yield batch_of(edges(rest))


def links(reps: DataFrame, n: int, radius: int = RADIUS, tile: int = 1024) -> DataFrame:
    """Spanning links (u, v) between the ``n`` distinct fingerprints ``reps(fp, rep)`` within the radius."""
    chosen = masks(bands_for(n, radius), radius)
    keyed = reps.select("fp", "rep", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in chosen))).alias("k", "v"))
    # Population counts of a range of radius + 1 can be near those of the same and the next range only.
    keyed = keyed.withColumn("range", F.floor(F.bit_count("fp") / (radius + 1)))
    ranges = keyed.groupBy("k", "v", "range").agg(F.count("*").alias("held")).withColumn("tiles", F.ceil(F.col("held") / tile))
    full = ranges.groupBy("k", "v").agg(F.sum("held").alias("held"), F.collect_list(F.struct("range", "tiles")).alias("ranges")).where("held > 1")
    dealt = hot_join(keyed, full.withColumnsRenamed({"k": "k2", "v": "v2"}), [("k", "k2"), ("v", "v2")])
    near = F.filter("ranges", lambda r: F.abs(r["range"] - F.col("range")) <= 1)
    number = lambda r, t: r * (1 << 40) + t
    tiles = F.flatten(F.transform(near, lambda r: F.transform(F.sequence(F.lit(0).cast("long"), r["tiles"] - 1), lambda t: number(r["range"], t))))
    mine = F.element_at(F.filter("ranges", lambda r: r["range"] == F.col("range")), 1)["tiles"]
    own = number(F.col("range"), F.pmod(F.xxhash64("fp", "k"), mine))
    one = F.col("held") <= tile
    dealt = dealt.withColumn("own", F.when(one, F.lit(0).cast("long")).otherwise(own))
    dealt = dealt.select("k", "v", "fp", "rep", "own", F.explode(F.when(one, F.array(F.lit(0).cast("long"))).otherwise(tiles)).alias("other"))
    cells = dealt.select("k", "v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "rep")
    cells = cells.repartition("k", "v", "lo", "hi").sortWithinPartitions("k", "v", "lo", "hi")
    return cells.mapInArrow(lambda batches: _compare(batches, radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): components of fingerprints within ``radius`` bits.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the least id reachable, the
    document's own included. Empty and null texts share fingerprint zero and are linked like any
    other. Repeated rows come out as often as they went in. Rows with a null id keep their
    fingerprint; their component_id is the least id that their fingerprint reaches, or null.
    Ids are integers.
    """
    made = durable(fingerprints(docs, id_col, text_col))
    reps = durable(made.groupBy("fp").agg(F.min("id").cast("long").alias("rep")).where("rep is not null"))
    found = components(links(reps, reps.count(), radius))
    roots = reps.join(found, reps.rep == found.node, "left").select(F.col("fp").alias("f"), F.coalesce("root", "rep").alias("component_id"))
    return hot_join(made, roots, [("fp", "f")], "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
