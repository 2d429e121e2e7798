"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; every path to a node is a
conjunctive rule; a lasso logistic regression weighs the rules and most weights become zero. The
rest is compiled into one Spark column expression over the statistics, so scoring stays in the
JVM and needs no model files.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import like, slices, small

#: Labelled rows to learn from at most, the least by hash of the id.
SAMPLE = 20_000

STATS = ("stat_words", "stat_mean_word", "stat_upper", "stat_symbols", "stat_digits", "stat_distinct", "stat_longest", "stat_line_words")


COUNTS = ("n_words", "n_distinct", "n_longest", "n_chars", "n_spaces", "n_upper", "n_digits", "n_symbols", "n_lines")

#: Classes of code points, and punctuation that is no symbol.
OTHER, SPACE, UPPER, DIGIT, SYMBOL, END = range(6)
PLAIN = ".,;:'’()-"
RUN = 1 << 20


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point: white space, capitals, digits, symbols (neither letters, numbers nor plain punctuation), others."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] not in "LNZ" and chr(c) not in PLAIN:
            out[c] = SYMBOL
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[65:91], out[0xC0:0xD7], out[0xD8:0xDF], out[0x178] = UPPER, UPPER, UPPER, UPPER
    out[48:58] = DIGIT
    return out


def count_texts(texts: list[bytes]) -> np.ndarray:
    """A row of ``COUNTS`` for each UTF-8 text; all code points of a run are classified at once."""
    if not texts:
        return np.zeros((0, len(COUNTS)), np.int64)
    points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
    chars = np.array([len(p) for p in points])
    starts = np.cumsum(chars + 1) - chars - 1
    kind = np.full(int(chars.sum()) + len(texts), END, np.uint8)  # a text is followed by an end, so none is empty
    lines = np.ones(len(texts), np.int64)
    for i, (start, p) in enumerate(zip(starts.tolist(), points, strict=True)):
        kind[start : start + len(p)] = _classes()[p]
        lines[i] += np.count_nonzero(p == 10)
    inside = np.concatenate(([False], (kind != SPACE) & (kind != END)))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, width = edge[::2], edge[1::2] - edge[::2]
    owner = np.searchsorted(starts, first, side="right") - 1
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, width)
    by_class = [np.add.reduceat(kind == k, starts, dtype=np.int64) for k in (SPACE, UPPER, DIGIT, SYMBOL)]
    return np.column_stack([np.bincount(owner, minlength=len(texts)), [len(set(t.split())) for t in texts], longest, chars, *by_class, lines])


def _count_batch(text: pa.Array) -> pa.Array:
    parts = [count_texts(held) for _, held in slices(pa.RecordBatch.from_arrays([text], names=["text"]), "text", RUN)]
    table = np.concatenate(parts) if parts else count_texts([])
    return pa.StructArray.from_arrays([pa.array(table[:, i], pa.int64()) for i in range(len(COUNTS))], names=list(COUNTS))


def _ratios(n: Callable[[str], Column]) -> dict[str, Column]:
    """The model's inputs from the counts; shares of nothing are 0."""
    bare = n("n_chars") - n("n_spaces")
    ink, words = F.greatest(bare, F.lit(1)), F.greatest(n("n_words"), F.lit(1))
    return {
        "stat_words": F.log1p(n("n_words")),
        "stat_mean_word": bare / words,
        "stat_upper": n("n_upper") / ink,
        "stat_symbols": n("n_symbols") / ink,
        "stat_digits": n("n_digits") / ink,
        "stat_distinct": n("n_distinct") / F.pow(words, F.lit(0.75)),
        "stat_longest": F.least(n("n_longest"), F.lit(60)).cast("double"),
        "stat_line_words": F.log1p(n("n_words") / n("n_lines")),
    }


def with_statistics(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the model's inputs; a null text counts as empty.

    Texts are counted in Arrow batches, a bounded run at a time; an expression would copy each
    text once for every count.
    """
    count = F.arrow_udf(_count_batch, ", ".join(f"{c} long" for c in COUNTS))
    counted = docs.select(*keep, count(text).alias("__n"))
    names = [f"`{c}`" for c in counted.columns[: len(keep)]]
    return counted.select(*names, *(c.cast("double").alias(n) for n, c in _ratios(lambda name: F.col(f"__n.{name}")).items()))


@dataclass(frozen=True)
class Model:
    """Rules as ((statistic, above, bound), ...) with their weights."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        total = F.lit(self.bias)
        for parts, weight in self.rules:
            holds = F.lit(True)
            for name, above, bound in parts:
                holds = holds & ((F.col(name) > bound) if above else (F.col(name) <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, bins: list[np.ndarray], depth: int, least: int) -> list[tuple[tuple[tuple[int, bool, float], ...], np.ndarray, float]]:
    """(path, rows, leaf value) of every node but the root, by second-order gain."""
    nodes, level = [], [((), np.arange(len(x)))]
    for _ in range(depth):
        following = []
        for path, rows in level:
            best = (1e-9, None)
            g, h = grad[rows], hess[rows]
            for f, cuts in enumerate(bins):
                if not len(cuts):
                    continue
                at = np.searchsorted(cuts, x[rows, f], side="left")
                gs, hs, ns = (np.cumsum(np.bincount(at, w, len(cuts) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, float(cuts[k])))
            if best[1]:
                f, cut = best[1]
                high = x[rows, f] > cut
                for above in (False, True):
                    part = rows[high == above]
                    following.append(((*path, (f, above, cut)), part))
                    nodes.append((following[-1][0], part, float(-grad[part].sum() / (hess[part].sum() + 1))))
        level = following
    return nodes


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATS, trees: int = 30, depth: int = 3, lasso: float = 0.002, seed: int = 5) -> Model:
    """A sparse rule ensemble for 0/1 labels. With one class only, or no rows, the model is a constant."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes count alike
    quantiles = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 99))) for f in range(x.shape[1])]
    bins = [np.unique(np.round((q[1:] + q[:-1]) / 2, 6)) for q in quantiles]
    margin, found = np.zeros(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        drawn = rng.random(len(y)) < 0.7
        nodes = _grow(x, np.where(drawn, weight * (p - y), 0), np.where(drawn, weight * p * (1 - p), 0), bins, depth, max(3, len(y) // 200))
        for path, rows, _value in nodes:
            truth = np.zeros(len(y), bool)
            truth[rows] = True
            found.setdefault(truth.tobytes(), path)
        last = {path[:-1] for path, _, _ in nodes}
        for path, rows, value in nodes:
            if path not in last:
                margin[rows] += 0.3 * value
    paths = sorted(found.values(), key=lambda path: (len(path), path))
    if not paths:
        return Model(0.0, ())
    # One matrix of rows by rules is held; its standardised columns are never made as a whole, nor copied.
    truth = np.empty((len(x), len(paths)))
    for i, path in enumerate(paths):
        truth[:, i] = np.logical_and.reduce([(x[:, f] > c) == above for f, above, c in path])
    share = truth.mean(0)
    spread = np.maximum(np.sqrt(share * (1 - share)), 0.05)
    mean = share / spread
    gram = np.zeros((len(paths), len(paths)))
    for at in range(0, len(x), 1024):
        z = (truth[at : at + 1024] / spread - mean) * np.sqrt(weight[at : at + 1024])[:, None]
        gram += z.T @ z
    step = 4 / (np.linalg.eigvalsh(gram)[-1] / len(y) + weight.mean())
    w, b, v, vb, t = np.zeros(len(paths)), 0.0, np.zeros(len(paths)), 0.0, 1.0
    for _ in range(600):  # accelerated proximal gradient
        err = weight * (1 / (1 + np.exp(-(truth @ (v / spread) - mean @ v + vb))) - y) / len(y)
        new = v - step * (truth.T @ err / spread - mean * err.sum())
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        nb, nt = vb - step * err.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    used = np.flatnonzero(np.abs(w) > 1e-4)
    rules = tuple((tuple((names[f], above, c) for f, above, c in paths[i]), float(w[i] / spread[i])) for i in used)
    return Model(float(b - sum(w[i] * mean[i] for i in used)), rules)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows for which ``learn`` (over ``id``) holds: ``sample`` ids at most, chosen by a hash of the id.

    Rows without an id or with another label than 0 and 1 teach nothing. Of repeated ids one row
    counts, the one with the least statistics, and the greatest label, so at most ``sample`` rows
    reach the driver. No rows, or one class only, give a constant score.
    """
    rows = like(labels, label_id, label_col).toDF("id", "y").where("id is not null and y in (0, 1)")
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample).withColumnRenamed("id", "lid")
    texts = like(docs, id_col, text_col).toDF("id", "text")
    joined = texts.join(small(rows, sample), F.col("id") == F.col("lid"))
    told = with_statistics(joined, F.col("text"), [F.col("id"), F.col("y")]).groupBy("id").agg(F.min(F.struct("y", *STATS)).alias("row"))
    got = told.select("id", "row.*").toPandas().sort_values("id").reset_index(drop=True)
    return fit_rules(got[list(STATS)].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, repeated ones too; null and empty texts are scored as texts without words. Null ids stay null."""
    picked = like(docs, id_col, text_col).toDF("doc_id", "text")
    return with_statistics(picked, F.col("text"), [F.col("doc_id")]).select("doc_id", model.score().alias("score"))
