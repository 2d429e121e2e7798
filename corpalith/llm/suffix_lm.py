"""Language-model scores from a probabilistic suffix tree over words.

The root is the add-one unigram model over every training token. A context of one to ``DEPTH``
words becomes a state if its shorter suffix is one and if its next-symbol distribution diverges
from the suffix's: the training log likelihood must gain ``GAIN`` nats or more. Symbols seen
``LEAST`` times or more after a state have probabilities of their own, smoothed towards the
suffix; all others share what is left in the suffix's proportions, so every state's distribution
sums to one. A token is scored by the longest state that is a suffix of what came before it.

All thresholds are absolute, so the tree grows with the corpus. A run of words is known by the
hash of its key: key(w0..wk) = mix(key(w0..wk-1), key(w1..wk)). Levels are counted in passes
over the tokenised table, and only where both shorter runs occur ``LEAST`` times (a run is never
more frequent than its parts): a bit table of bounded size says so, and its false positives only
cost counting, as counts are exact.

Along a text the ratios of states telescope, so its score is the root's plus one value for each
run of words: what the run gains as a pair of its state, plus what it costs as a state of the
next token. These values are one table, joined by a shuffle; runs that occur ``LOUD`` times are
broadcast, the ``HOT`` most frequent at most, so frequent runs make no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import dropped, like, slices, stored

DEPTH = 5
#: Levels up to this one are counted one by one; from it on repeats are long, and one pass counts the rest.
ALONE = 3
#: Least count of a state and of a symbol after it, gain of a state in nats, weight of the suffix in smoothing.
LEAST, GAIN, SMOOTHING = 8, 8.0, 20.0
#: Least count of a run of words in the broadcast table; its rows, and 64-bit words of a bit table (16 MB), at most.
LOUD, HOT, BITS = 16, 1_000_000, 1 << 21
RUN, HELD = 3 << 19, 1 << 20
#: Rows of a batch that leaves a task's Python.
ROWS = 1 << 17

#: The end token's hash stands apart from words: no word is empty.
_hash = partial(xxhash.xxh64_intdigest, seed=0)
END = np.uint64(_hash(b""))
#: Odd multipliers of the mixing.
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a run of words from those of the run without its last and without its first word."""
    x = (a + _C) * _A ^ b * _B
    x ^= x >> np.uint64(29)
    x *= _C
    return x ^ (x >> np.uint64(32))


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, code of every token, tokens of each text): A-Z lower-cased words, then the end token, which is code 0."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())))
    owner, words = pc.list_parent_indices(split).to_numpy(), split.flatten().dictionary_encode()
    found = [w.as_buffer() for w in words.dictionary]
    full = np.fromiter(map(len, found), np.int64, len(found)) > 0
    known = np.fromiter(map(_hash, found), np.uint64, len(found))
    codes = words.indices.to_numpy()
    there = full[codes] if len(codes) else np.zeros(0, bool)
    number = np.cumsum(full)
    sizes = np.bincount(owner[there], minlength=len(texts)) + 1
    out = np.zeros(int(sizes.sum()), np.int64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(sizes) - 1] = True
    out[~last] = number[codes[there]]
    return np.concatenate(([END], known[full])), out, sizes


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None) -> DataFrame:
    """(learn, rows, ids, sizes, hashes, codes): the texts as runs of about ``RUN`` bytes, written once for all passes.

    A run holds the distinct token hashes and, compressed, their codes in order. A null text is
    empty and has the end token only. ``learn`` says which rows are learned from (all, if it is
    not given; a null is no). ``rows`` tells repeated rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned = batch.column(2).to_numpy(zero_copy_only=False)
            for which in (True, False):
                chosen = batch.take(pa.array(np.flatnonzero(learned == which)))
                for first, held in slices(chosen, "text", RUN):
                    hashes, codes, sizes = word_codes(held)
                    part = chosen.slice(first, len(held))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), x) for x in (part.column(0), part.column(1), pa.array(sizes, pa.int64()))]
                    packed = pa.compress(codes.astype(_width(len(hashes))).tobytes(), "zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([which]), *lists, pa.array([hashes.tobytes()], pa.binary()), pa.array([packed], pa.binary())], names=names)

    said = F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True)
    marked = docs.select(said.alias("__learn"), *(F.col(f"`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (text_col, "text"))))
    picked = marked.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("__learn").alias("learn"), "text")
    names = ["learn", "rows", "ids", "sizes", "hashes", "codes"]
    return stored(picked.mapInArrow(run, f"learn boolean, rows array<long>, ids array<{picked.schema['doc_id'].dataType.simpleString()}>, sizes array<long>, hashes binary, codes binary"))


def _width(distinct: int) -> type:
    return np.uint16 if distinct <= 1 << 16 else np.uint32


@dataclass
class Run:
    """A run of texts: distinct hashes, their codes in order, the text and the place in it of each token."""

    hashes: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray

    def places(self) -> np.ndarray:
        starts = np.cumsum(self.sizes) - self.sizes
        return np.arange(len(self.codes)) - np.repeat(starts, self.sizes)


def _runs(batch: pa.RecordBatch) -> Iterator[Run]:
    hashes, codes, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("hashes", "codes", "sizes"))
    for i in range(batch.num_rows):
        known, lens = np.frombuffer(hashes[i].as_buffer(), np.uint64), sizes[i].values.to_numpy()
        width = np.dtype(_width(len(known)))
        got = pa.decompress(codes[i].as_buffer(), int(lens.sum()) * width.itemsize, "zstd")
        yield Run(known, np.frombuffer(got, width).astype(np.int64), lens)


def _grouped(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each distinct key, in order of the keys, and its count)."""
    order = np.argsort(keys)
    held = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(held)), bool), held[1:] != held[:-1])))
    n = np.diff(np.append(first, len(held))) if counts is None else np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return order[first], n


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of ``ROWS`` rows: the JVM holds a batch whole, outside its heap."""
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _bit(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of keys in a table of ``n`` words, a power of two: four bits of one word."""
    h = keys * _A
    h ^= h >> np.uint64(31)
    mask = np.zeros(len(keys), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << (h >> np.uint64(shift) & np.uint64(63))
    return (h >> np.uint64(24)) & np.uint64(n - 1), mask


def bit_table(keys: DataFrame, most: int = BITS) -> np.ndarray:
    """A bit table of ``keys(gram)``, 16 bits a key and ``most`` words at most; its parts are joined by a shuffle."""
    n = 1 << int(np.ceil(np.log2(max(1, min(most, keys.count() / 4)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n, np.uint64)
        for batch in batches:
            word, mask = _bit(batch.column(0).to_numpy().view(np.uint64), n)
            np.bitwise_or.at(held, word.astype(np.int64), mask)
        there = np.flatnonzero(held)
        for cut in range(0, len(there), ROWS):
            at = there[cut : cut + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].view(np.int64))], names=["word", "bits"])

    got = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    word, mask = _bit(keys, len(table))
    return table[word] & mask == mask


def _levels(run: Run, tables: list[np.ndarray], last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, key without the last word, key without the first) of the runs of words whose parts are in the tables, as far as these go."""
    key, ok, place = run.hashes[run.codes], _among(run.hashes, tables[0])[run.codes], run.places()
    for level in range(1, last + 1):
        at = np.flatnonzero(ok[1:] & ok[:-1] & (place[1:] >= level)) + 1
        before, after = key[at - 1], key[at]
        yield level, before, after
        made = mix(before, after)
        key, ok = np.zeros(len(key), np.uint64), np.zeros(len(key), bool)
        key[at], ok[at] = made, _among(made, tables[level]) if level < len(tables) else True


def _count_levels(train: DataFrame, tables: list[np.ndarray], last: int, least: int, total: int) -> DataFrame:
    """(level, gram, ctx, suf, n) of the runs of words that occur ``least`` times, of the levels from that of ``tables`` to ``last``.

    Counts are exact. Tasks sum what they hold and deal it by the key's first bits to parts of
    about 2^20 runs, as packed pieces; each part is then summed by itself.
    """
    shared = train.sparkSession.sparkContext.broadcast(tables)
    bits = max(8, int(np.ceil(np.log2(max(1, total >> 20)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(level: int) -> Iterator[pa.RecordBatch]:
            before, after = (np.concatenate(x) for x in zip(*held.pop(level), strict=True))
            key = mix(before, after)
            at, n = _grouped(key)
            before, after, part = before[at], after[at], (key[at] >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1])))
            ends = np.append(cut, len(part))
            pieces = [_packed(before[i:j], after[i:j], n[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(level << bits | part[cut]), pa.array(pieces, pa.binary())], names=["part", "piece"])

        for batch in batches:
            for run in _runs(batch):
                for level, before, after in _levels(run, shared.value, last):
                    if level >= len(shared.value) and len(before):
                        held.setdefault(level, []).append((before, after))
                if sum(len(x) for pairs in held.values() for x, _ in pairs) > HELD:
                    for level in list(held):
                        yield from flush(level)
        for level in list(held):
            yield from flush(level)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def summed() -> Iterator[pa.RecordBatch]:
            before, after, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key = mix(before, after)
            at, n = _grouped(key, n)
            at, n = at[n >= least], n[n >= least]
            yield from _cut(pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part >> bits, np.int32)), *(pa.array(x[at].view(np.int64)) for x in (key, before, after)), pa.array(n)], names=["level", "gram", "ctx", "suf", "n"]))

        for batch in batches:
            for now, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and now != part:
                    yield from summed()
                part = now
                held.append(_unpacked(piece.as_buffer()))
        if held:
            yield from summed()

    dealt = train.select("sizes", "hashes", "codes").mapInArrow(deal, "part long, piece binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(sum_up, "level int, gram long, ctx long, suf long, n long")


def _packed(before: np.ndarray, after: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs of keys with counts, ordered so that a key that is shared is written once."""
    order = np.argsort(before)
    before = before[order]
    first = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
    small = np.concatenate((np.diff(np.append(first, len(before))), n[order])).astype(np.uint32).tobytes()
    return np.array([len(first), len(before)], np.int64).tobytes() + before[first].tobytes() + after[order].tobytes() + pa.compress(small, "zstd", asbytes=True)


def _unpacked(piece: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(piece)
    keys, pairs = np.frombuffer(data[:16], np.int64).tolist()
    before, after = np.frombuffer(data[16 : 16 + 8 * keys], np.uint64), np.frombuffer(data[16 + 8 * keys : 16 + 8 * (keys + pairs)], np.uint64)
    small = np.frombuffer(pa.decompress(data[16 + 8 * (keys + pairs) :], 4 * (keys + pairs), "zstd"), np.uint32).astype(np.int64)
    return np.repeat(before, small[:keys]), after, small[keys:]


def _words(train: DataFrame) -> DataFrame:
    """(gram, n): how often every word, and the end, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                at, n = _grouped(keys, n)
                yield from _cut(pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(n)], names=["gram", "n"]))

        for batch in batches:
            for part in _runs(batch):
                held.append((part.hashes, np.bincount(part.codes, minlength=len(part.hashes))))
                if sum(len(x) for x, _ in held) > HELD:
                    yield from flush()
        yield from flush()

    words = train.select("sizes", "hashes", "codes").mapInArrow(run, "gram long, n long")
    return words.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class LM:
    """``values(gram, n, val)``: what each run of words adds to a text's score (natural logarithm), and a word's count;
    the number of training tokens, and of distinct ones; and ``states``, how many there are of each length."""

    values: DataFrame
    total: int
    distinct: int
    states: list[int]


def fit(tokens: DataFrame, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, smoothing: float = SMOOTHING, most: int = BITS) -> LM:
    """Learn from every row of ``tokens`` (of ``tokenise``) that is to be learned from. Without any, the model is the root alone."""
    train = tokens.where("learn")
    words = stored(_words(train))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    counted = words.where(F.col("n") >= least)
    known = counted.select("gram", "n", F.log((F.col("n") + 1) / F.lit(float(total + distinct + 1))).alias("lnq"))
    tables, values, states = [bit_table(counted.select("gram"), most)], [], []
    parts, counts = [words], []
    for level in range(1, depth + 1):
        if level <= ALONE:
            counts.append(stored(_count_levels(train, tables, level if level < ALONE else depth, least, total)))
        grams = counts[-1].where(F.col("level") == level)
        # A run counts if the run without its first word is one of a state, so states' suffixes are states.
        rows = grams.join(known.select(F.col("gram").alias("s"), F.col("lnq").alias("lnp")), F.col("suf") == F.col("s"))
        rows = rows.join(counted.select(F.col("gram").alias("c"), F.col("n").alias("cn")), F.col("ctx") == F.col("c"))
        own = (F.col("n") + smoothing * F.exp("lnp")) / (F.col("cn") + smoothing)
        rows = stored(rows.select("gram", "ctx", "n", "cn", "lnp", F.log(own).alias("lnq")))
        if len(counts) > 1:  # nothing reads the counts of the level below any more
            dropped(counts.pop(0))
        sums = rows.groupBy("ctx").agg(F.first("cn").alias("cn"), F.sum(F.exp("lnq")).alias("q"), F.sum(F.exp("lnp")).alias("p"), F.sum("n").alias("used"), F.sum(F.col("n") * (F.col("lnq") - F.col("lnp"))).alias("own"))
        rest = F.log(F.greatest(1 - F.col("q"), F.lit(1e-9)) / F.greatest(1 - F.col("p"), F.lit(1e-9)))
        kept = sums.select(F.col("ctx").alias("state"), "cn", rest.alias("rest"), F.col("own"), F.col("used")).where(F.col("own") + (F.col("cn") - F.col("used")) * F.col("rest") >= gain)
        kept = stored(kept.select("state", "cn", "rest"))
        states.append(kept.count())
        parts.append(kept)
        if not states[-1]:
            dropped(rows)
            break
        held = stored(rows.join(kept.select("state", "rest"), F.col("ctx") == F.col("state")).select("gram", "n", "lnq", (F.col("lnq") - F.col("lnp") - F.col("rest")).alias("val")))
        dropped(rows)
        parts.append(held)
        values += [held.select("gram", "n", "val"), kept.select(F.col("state").alias("gram"), F.col("cn").alias("n"), F.col("rest").alias("val"))]
        known, counted = held.select("gram", "n", "lnq"), grams.select("gram", "n")
        if level < min(depth, ALONE):
            tables.append(bit_table(counted.select("gram"), most))
    every = words.select("gram", "n", F.lit(0.0).alias("val"), F.col("n").alias("c"))
    for part in values:
        every = every.union(part.select("gram", "n", "val", F.lit(None).cast("long")))
    merged = stored(every.groupBy("gram").agg(F.max("n").alias("n"), F.sum("val").alias("val"), F.max("c").alias("c")))
    dropped(*counts, *parts)
    return LM(merged, total, distinct, states)


def _hottest(values: DataFrame, most: int) -> DataFrame:
    """The runs that occur ``LOUD`` times, or over the least count that leaves ``most`` of them or fewer."""
    bounded = F.least(F.col("n"), F.lit(1 << 16))
    bound = (1 << 16) + 1
    held = 0
    for n, runs in sorted(values.groupBy(bounded.alias("b")).agg(F.count("*").alias("runs")).collect(), reverse=True):
        held += runs
        if held > most or n < LOUD:
            break
        bound = n
    return values.where(bounded >= bound)


def score(tokens: DataFrame, lm: LM, hot: int = HOT, most: int = BITS) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``tokens``, repeated rows and null ids too.

    ``base_score`` is the unigram model's log10 probability, ``score`` the tree's.
    """
    sc = tokens.sparkSession.sparkContext
    top = _hottest(lm.values, hot).select("gram", "val", F.coalesce("c", F.lit(0)).alias("c")).toArrow()
    keys = top["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    loud = sc.broadcast((keys[order], top["val"].to_numpy()[order], top["c"].to_numpy()[order]))
    longer = sc.broadcast(bit_table(lm.values.where(F.col("val") != 0).select("gram"), most))
    depth = len(lm.states)
    names = ["row", "doc_id", "gram", "times", "n_tokens", "n_known", "logs", "gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vals, counts = loud.value
        logs = np.log10(counts + 1.0)

        def found(grams: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(grams), -1)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            return np.where(keys[at] == grams, at, -1)

        for batch in batches:
            for i, part in enumerate(_runs(batch)):
                row, ids = batch.column(1)[i].values, batch.column(2)[i].values
                n, place = len(part.sizes), part.places()
                doc = np.repeat(np.arange(n), part.sizes)
                hit = found(part.hashes)[part.codes]
                on = hit >= 0
                known = np.bincount(doc, on & (counts[hit] > 0), n) if len(keys) else np.zeros(n)
                base = np.bincount(doc[on], logs[hit[on]], n) if on.any() else np.zeros(n)
                gain = np.bincount(doc[on], vals[hit[on]], n) if on.any() else np.zeros(n)
                key, alive = part.hashes[part.codes], np.arange(len(part.codes))
                owners, grams = [doc[~on]], [key[~on]]
                for level in range(1, depth + 1):
                    key = np.concatenate((key[:1], mix(key[:-1], key[1:])))
                    alive = alive[place[alive] >= level]
                    alive = alive[_among(key[alive], longer.value)]  # a longer run's last words are in the table too
                    hit = found(key[alive])
                    on = hit >= 0
                    if on.any():
                        gain += np.bincount(doc[alive[on]], vals[hit[on]], n)
                    owners.append(doc[alive[~on]])
                    grams.append(key[alive[~on]])
                owner, gram = np.concatenate(owners), np.concatenate(grams)
                first, times = _grouped(mix(owner.astype(np.uint64), gram))
                # A text's own sums are a row that joins nothing: its times are none.
                yield pa.RecordBatch.from_arrays([row, ids, row, pa.array(np.zeros(n, np.int64)), pa.array(part.sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(gain)], names=names)
                for cut in range(0, len(first), 1 << 17):
                    at = first[cut : cut + (1 << 17)]
                    none, zero = np.zeros(len(at), np.int64), np.zeros(len(at))
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(owner[at])), pa.nulls(len(at), ids.type), pa.array(gram[at].view(np.int64)), pa.array(times[cut : cut + (1 << 17)]), pa.array(none), pa.array(none), pa.array(zero), pa.array(zero)], names=names)

    kind = tokens.schema["ids"].dataType.elementType.simpleString()
    parts = tokens.select("learn", "rows", "ids", "sizes", "hashes", "codes").mapInArrow(run, f"row long, doc_id {kind}, gram long, times long, n_tokens long, n_known long, logs double, gain double")
    table = lm.values.select(F.col("gram").alias("g"), "val", "c")
    joined = parts.join(table, F.col("gram") == F.col("g"), "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + times * F.log10(c + 1)).alias("logs"), F.sum(F.col("gain") + times * F.coalesce("val", F.lit(0.0))).alias("gain"),
    )
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(lm.total + lm.distinct + 1)))
    return sums.select("doc_id", "n_tokens", "n_known", base.alias("base_score"), (base + F.col("gain") / float(np.log(10))).alias("score"))
