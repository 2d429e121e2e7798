"""Language identification as inference over mixtures of languages.

A model has, for each language, smoothed frequencies of letter trigrams folded to a fixed number
of buckets, counted over every training text. A document is taken as a mixture: expectation-
maximisation estimates what share of its trigrams each language gave. Its set of languages is
grown from the best single one, by the others in the order of those shares (ties by name), while
the likelihood penalised by ``PENALTY`` * log(number of trigrams) for each language keeps rising,
and stops at the first set where it doesn't.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import like, slices

BUCKETS = 1 << 15
PENALTY = 2.0
#: Rounds of expectation-maximisation at most, and the change of a share that ends them.
ROUNDS, SETTLED = 50, 1e-3
RUN = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the distinct letter trigrams of each text.

    Runs of other characters count as one gap; a trigram needs a letter in its middle, so a text
    without letters has none and every letter is in the middle of one.
    """
    coded = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(c) + 2 for c in coded])
    points = np.zeros(int(sizes.sum()), np.uint32)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for s, c in zip(start.tolist(), coded, strict=True):
        points[s + 1 : s + 1 + len(c)] = c
    letter = _letters()[points]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] != 0) | (letter[:-1] != 0) | (owner[1:] != owner[:-1])
    letter, owner = letter[keep].astype(np.uint64), owner[keep]
    middle = np.flatnonzero(letter[1:-1] != 0) + 1
    h = letter[middle - 1] * np.uint64(0x9E3779B97F4A7C15) ^ letter[middle] * np.uint64(0xC2B2AE3D27D4EB4F) ^ letter[middle + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    bucket = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - (buckets.bit_length() - 1))
    key, count = np.unique(owner[middle].astype(np.uint64) * np.uint64(buckets) + bucket, return_counts=True)
    return (key // np.uint64(buckets)).astype(np.int64), (key % np.uint64(buckets)).astype(np.int64), count


@dataclass
class Model:
    """Languages in order, and a row of log frequencies for each bucket."""

    langs: list[str]
    logp: np.ndarray

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, list[tuple[str, float]]]]:
        """(language, score, mixture) of each text; ``und`` with score 0 if it has no letter or nothing was learned."""
        out: list[tuple[str, float, list[tuple[str, float]]]] = [("und", 0.0, [])] * len(texts)
        doc, bucket, count = trigrams(texts, len(self.logp))
        if not len(doc) or not self.langs:
            return out
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        ids = doc[cut]
        nth = np.repeat(np.arange(len(ids)), np.diff(np.append(cut, len(doc))))
        logp, count = self.logp[bucket], count.astype(float)
        total = np.add.reduceat(count, cut)
        top = logp.max(1)
        p = np.exp(logp - top[:, None])
        base = np.add.reduceat(count * top, cut)

        ends = np.append(cut, len(doc))

        def em(share: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares and log likelihoods of the texts ``which``; a text whose shares have settled takes no further part."""
            out, likelihood = share.copy(), np.zeros(len(which))
            alive = np.arange(len(which))
            while len(alive):
                sizes = (ends[1:] - cut)[which[alive]]
                at = np.repeat(cut[which[alive]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                starts, own = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(alive)), sizes)
                here, times, now = p[at], count[at], out[alive]
                for _ in range(ROUNDS if len(alive) < 64 else 8):
                    joint = here * now[own]
                    joint *= (times / joint.sum(1))[:, None]
                    new = np.maximum(np.add.reduceat(joint, starts, axis=0) / total[which[alive]][:, None], 1e-12)
                    moved, now = np.abs(new - now).max(1), new
                    rounds[which[alive]] += 1
                    if (moved < SETTLED).all():
                        break
                out[alive] = now
                likelihood[alive] = base[which[alive]] + np.add.reduceat(times * np.log((here * now[own]).sum(1)), starts)
                alive = alive[(moved >= SETTLED) & (rounds[which[alive]] < ROUNDS)]
            return out, likelihood

        size, every = len(self.langs), np.arange(len(ids))
        rounds = np.zeros(len(ids), np.int64)
        share, _ = em(np.full((len(ids), size), 1 / size), every)
        single = np.add.reduceat(logp * count[:, None], cut, axis=0)
        first = single.argmax(1)
        ahead = share.copy()
        ahead[every, first] = 2.0  # the best single language leads its sets
        order = np.argsort(-ahead, 1, kind="stable")
        best = np.zeros_like(share)
        best[every, first] = 1.0
        fee = PENALTY * np.log(total + 1)
        value = single.max(1) - fee
        rising = every
        for m in range(2, size + 1):
            if not len(rising):
                break
            start = np.full((len(rising), size), 1e-12)
            np.put_along_axis(start, order[rising, :m], 1 / m, 1)
            rounds[rising] = 0
            mixed, likelihood = em(start, rising)
            better = likelihood - m * fee[rising] > value[rising]
            best[rising[better]], value[rising[better]] = mixed[better], (likelihood - m * fee[rising])[better]
            rising = rising[better]
        pick = best.argmax(1)
        for i, d in enumerate(ids.tolist()):
            kept = [(self.langs[j], float(best[i, j])) for j in np.flatnonzero(best[i] > 1e-6)]
            out[d] = (self.langs[pick[i]], float(min(1.0, best[i, pick[i]])), sorted(kept, key=lambda x: (-x[1], x[0])))
        return out


def counts(docs: DataFrame, text_col: str, lang_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all rows with a language and a text; summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, held in slices(batch, "text", RUN):
                doc, bucket, n = trigrams(held, buckets)
                names = np.array(langs[first : first + len(held)], object)
                for lang in set(names.tolist()):
                    on = (names == lang)[doc]
                    sums.setdefault(lang, np.zeros(buckets))
                    sums[lang] += np.bincount(bucket[on], n[on], buckets)
        for lang, held_sums in sums.items():
            there = np.flatnonzero(held_sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(held_sums[there].astype(np.int64))], names=["lang", "bucket", "n"])

    picked = like(docs, text_col, lang_col).toDF("text", "lang").where("text is not null and lang is not null")
    return picked.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, buckets: int = BUCKETS) -> Model:
    """Learn from every row for which ``learn`` holds. The model's size is languages times buckets, whatever the number of rows."""
    rows = docs.where(learn) if learn is not None else docs
    got = counts(rows, text_col, lang_col, buckets).toPandas()
    langs = sorted(set(got["lang"]))
    table = np.zeros((buckets, len(langs)))
    for j, lang in enumerate(langs):
        part = got[got["lang"] == lang]
        table[part["bucket"].to_numpy(), j] = part["n"].to_numpy()
    table += 0.5
    return Model(langs, np.log(table / table.sum(0)).astype(np.float32))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture) of every row; ``score`` is the language's share of the mixture.

    Null texts and texts without letters are ``und`` with score 0 and an empty mixture.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            for first, held in slices(batch, "text", RUN):
                got = shared.value.predict(held)
                ids = batch.column(0).slice(first, len(held))
                mixture = pa.array([[{"lang": x, "share": s} for x, s in g[2]] for g in got], kind)
                yield pa.RecordBatch.from_arrays([ids, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), mixture], names=["doc_id", "lang_pred", "score", "mixture"])

    picked = like(docs, id_col, text_col).toDF("doc_id", "text")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, mixture array<struct<lang: string, share: double>>")
