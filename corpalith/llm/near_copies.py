"""SimHash near-dedup at a similarity of shingle sets instead of a number of bits.

Two texts are near if their sets of shingles have a Jaccard similarity of ``threshold`` or more.
At 0.8 their SimHash fingerprints differ by 10 to 12 of 64 bits and by ``WIDE`` with a probability
of 1e-6 or less, far more than bands can be cut for. So texts meet in two ways. Fingerprints within
``RADIUS`` bits come into one component by the operator's own tiles (``simhash.links``), which miss
none; for the rest each distinct set gives ``BANDS`` keys of ``ROWS`` minima each, and texts that
share a key come into one component as well. A pair at similarity 0.8 beyond the radius shares none
with probability (1 - 0.8 ** 5) ** 30 = 7e-6. Inside a component fingerprints are compared tile by tile
(``simhash.tile_pairs``), and pairs within ``WIDE`` bits that are not yet linked are verified on
the shingles themselves, so every link is exact. A component of more than ``TILE`` texts or
``HELD`` shingles is dealt to tiles, so a task's memory does not grow with a component. There each
text is first compared with the component's least one, which goes to every tile, by fingerprint and
then by shingles. Most texts of a large component are copies of it and are settled by that; the rest, tile by tile, meets all texts
of the component, so no link is lost, and the work is that of the rest times the component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import dropped, durable, hot_join, like, slices, small, stored
from corpalith.llm.components import components
from corpalith.llm.simhash import RADIUS, tile_pairs
from corpalith.llm.simhash import links as fingerprint_links

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
SEED = 42
WIDE = 28
TILE, HELD = 512, 1 << 20
RUN = 1 << 20

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
_odd = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS + SHINGLE), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of k words, the whole text if it is shorter, none without words."""
    ids: dict[bytes, int] = {}
    put = ids.setdefault
    split = [np.fromiter((put(w, len(ids)) for w in text.lower().split()), np.int64) for text in texts]
    hashes = np.fromiter(map(_hash, ids), np.uint64, len(ids))
    out = []
    for words in split:
        h = hashes[words]
        n = len(h) - k + 1
        width = k if n > 0 else len(h)
        total = np.full(max(n, min(1, len(h))), np.uint64(width))
        for d in range(width):
            total = _mixed(total * _odd[2, d] + h[d : d + len(total)])
        out.append(np.unique(total))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys of sets that are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), np.uint64(band))
        for j in range(band * ROWS, (band + 1) * ROWS):
            key = _mixed(key * _odd[2, 0] + np.minimum.reduceat(_mixed(flat * _odd[0, j] + _odd[1, j]), starts))
        out[:, band] = key
    return out


def fingerprints_of(sets: list[np.ndarray]) -> np.ndarray:
    """The 64-bit SimHash of each set: a bit is 1 if more than half of the set's hashes have it."""
    out = np.zeros(len(sets), np.uint64)
    for i, held in enumerate(sets):
        if len(held):
            ones = np.unpackbits(held.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = np.packbits(ones * 2 > len(held), bitorder="little").view(np.uint64)[0]
    return out


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def near_sets(sets: list[np.ndarray], threshold: float = THRESHOLD, wide: int = WIDE, led: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of a member that stands for its linked sets. Those that ``led`` marks are linked already."""
    label = np.arange(len(sets))
    if led is not None and led.any():
        label[led] = np.flatnonzero(led)[0]
    for p, q in tile_pairs(fingerprints_of(sets), wide):
        while len(p):
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
            if not len(p):
                break
            one = p == p[0]  # the rest of a row's pairs at a time: most are linked by the first row
            mine = sets[p[0]]
            for other in q[one].tolist():
                if label[other] != label[p[0]] and _near(mine, sets[other], threshold):
                    label[label == label[other]] = label[p[0]]
            p, q = p[~one], q[~one]
    return label


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, hash of the set, its size, its fingerprint and its band keys; a text without words has no band."""
    for batch in batches:
        for at, held in slices(batch, "text", RUN):
            sets = shingle_sets(held)
            full = [s for s in sets if len(s)]
            bands = iter(band_keys(full).view(np.int64) if full else ())
            rows = [next(bands) if len(s) else np.empty(0, np.int64) for s in sets]
            whole = [_hash(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(held)), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fingerprints_of(sets).view(np.int64)), pa.array(rows, pa.list_(pa.int64()))],
                names=["key", "whole", "n", "fp", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, held in slices(batch, "text", RUN):
            sets = [s.tobytes() for s in shingle_sets(held)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(sets, pa.binary())], names=["key", "shingles"])


def _cells(batches: Iterator[pa.RecordBatch], *cell: str) -> Iterator[tuple[list, list[tuple]]]:
    """Cells of sorted rows, as (cell, [(key, shingles, mark)]); a cell may go on in the next batch."""
    now, rows = None, []
    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(n)).to_pylist() for n in (*cell, "key", "mark")]
        shingles = batch.column(names.index("shingles"))
        for row, (*this, key, mark) in enumerate(zip(*columns, strict=True)):
            if this != now:
                if rows:
                    yield now, rows
                now, rows = this, []
            rows.append((key, np.frombuffer(shingles[row].as_py(), np.uint64), mark))
    if rows:
        yield now, rows


def _led(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Whether each text of a tile is near the tile's first row, the component's leader: within ``WIDE`` bits, and then by its shingles."""
    for _, ((_, leader, _), *rows) in _cells(batches, "root", "own"):
        if rows:
            first, *prints = fingerprints_of([leader, *(held for _, held, _ in rows)])
            near = [bool(np.bitwise_count(first ^ fp) <= WIDE) and _near(leader, held, threshold) for fp, (_, held, _) in zip(prints, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(near)], names=["key", "near"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Spanning links of each cell, but those between texts that are marked as linked."""
    for _, rows in _cells(batches, "root", "lo", "hi"):
        rows = list({r[0]: r for r in rows}.values())
        if len(rows) > 1:
            ids, led = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows])
            label = near_sets([r[1] for r in rows], threshold, led=led)
            far = np.flatnonzero((label != np.arange(len(label))) & ~(led & led[label]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], names=["u", "v"])


def _links(sets: DataFrame, threshold: float) -> DataFrame:
    """(u, v): spanning links of the near texts of ``sets(key, root, tiles, own, shingles)``."""

    def compared(cells: DataFrame) -> DataFrame:
        dealt = cells.select("root", "lo", "hi", "key", "shingles", "mark").repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "key")
        return dealt.mapInArrow(lambda batches: _compare(batches, threshold), "u long, v long")

    zero, no = F.lit(0), F.lit(False).alias("mark")
    links = compared(sets.where("tiles = 1").select("*", zero.alias("lo"), zero.alias("hi"), no))
    large = sets.where("tiles > 1")
    if large.isEmpty():
        return links
    every = F.sequence(zero, F.col("tiles") - 1)
    leaders = large.where("key = root").select("root", F.explode(every).alias("own"), F.lit(-1).alias("turn"), "key", "shingles", no)
    tiles = leaders.union(large.select("root", "own", zero, "key", "shingles", no)).repartition("root", "own").sortWithinPartitions("root", "own", "turn")
    led = stored(tiles.mapInArrow(lambda batches: _led(batches, threshold), "key long, near boolean"))
    links = links.union(led.where("near").select("key", F.lit(None).cast("long")))
    marked = hot_join(large, led.select(F.col("key").alias("l_key"), F.col("near").alias("mark")), [("key", "l_key")]).drop("l_key")
    count = F.greatest(F.count("*") / TILE, F.sum(F.length("shingles") / 8) / HELD)
    rest = stored(marked.where("not mark").groupBy(F.col("root").alias("r")).agg(F.ceil(count).cast("int").alias("parts")))
    n = rest.count()
    if n:
        met = hot_join(marked, small(rest, n), [("root", "r")])
        parts = F.sequence(zero, F.col("parts") - 1)
        columns = ["root", "key", "shingles", "mark"]
        whole = met.select(*columns, F.col("own").alias("lo"), F.explode(parts).alias("hi"))
        alone = met.where("not mark").select(*columns, F.explode(every).alias("lo"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int").alias("hi"))
        links = links.union(compared(whole.union(alone)))
    roots = large.select("key", F.col("root").alias("r_root"))
    return links.join(roots, F.col("u") == F.col("key"), "left").select("u", F.coalesce("v", "r_root").alias("v"))


def near_copies(texts: DataFrame, key_col: str = "key", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, root): the components of near texts, by the least key of each; keys are longs that tell texts apart.

    Repeated keys are one text. Null texts and those without words are near each other.
    """
    picked = like(texts, key_col, text_col).toDF("key", "text")
    made = durable(picked.mapInArrow(_signatures, "key long, whole long, n long, fp long, bands array<long>").dropDuplicates(["key"]))
    reps = made.groupBy("whole").agg(F.min("key").alias("rep"))
    owners = durable(hot_join(made.select("key", "whole", "n"), reps.withColumnRenamed("whole", "w"), [("whole", "w")]).select("key", "rep", "n"))
    firsts = owners.where("key = rep").select(F.col("key").alias("k"))
    single = made.join(firsts, F.col("key") == F.col("k"), "left_semi")
    prints = single.where("n > 0").select(F.col("key").alias("rep"), "fp")
    held = durable(prints.groupBy("fp").agg(F.min("rep").alias("rep")))
    alike = fingerprint_links(held, held.count(), RADIUS)
    same = hot_join(prints, held.toDF("f", "v"), [("fp", "f")]).where("rep <> v").select(F.col("rep").alias("u"), "v")
    keyed = single.select(F.col("key").alias("rep"), F.explode("bands").alias("band"))
    leads = keyed.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead <> last").select(F.col("band").alias("b"), "lead")
    edges = hot_join(keyed, leads, [("band", "b")]).where("rep <> lead").select(F.col("rep").alias("u"), F.col("lead").alias("v")).union(alike).union(same).distinct()
    nodes = durable(hot_join(components(edges), owners.where("key = rep").select("key", "n"), [("node", "key")]).select("node", "root", "n"))

    tiles = F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / HELD)).cast("int")
    sized = nodes.groupBy("root").agg(tiles.alias("tiles")).withColumnRenamed("root", "r")
    placed = durable(hot_join(nodes, sized, [("root", "r")]).select("node", "root", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("own")))
    rows = placed.count()
    found = picked.join(small(placed.select("node"), rows), F.col("key") == F.col("node"), "left_semi")
    sets = found.mapInArrow(_sets, "key long, shingles binary").groupBy("key").agg(F.min("shingles").alias("shingles"))
    sets = stored(sets.join(small(placed, rows), F.col("key") == F.col("node")).select("key", "root", "tiles", "own", "shingles"))
    links = components(_links(sets, threshold))
    dropped(sets)
    return owners.join(links, owners.rep == links.node, "left").select("key", F.coalesce("root", "rep").alias("root"))
