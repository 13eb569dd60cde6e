"""Document quality: histogram gradient-boosted trees over text statistics.

Training takes at most MAX_TRAIN labelled rows (a bounded sample in a fixed
hash order of ids); trees are grown level by level on quantile-binned features
and flattened into arrays (feature, threshold, leaf value), so that scoring is
`depth` vectorised numpy steps for each tree.

Defined cases: null text counts as empty; an empty text gets the score its
statistics (all zero) lead to; without usable labels every score is the share
of label 1, or 0.5; a null id is never learned from nor held out; an id with
several labels counts as label 1 if one of them is, an id with several texts has
the smallest statistics; of equal gains the first feature and cut are taken; equal
texts have equal scores; columns besides id, text and quality are not read.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
SYMBOLS = "$%&#*|!@<>{}[]=_~^\\/+"
PUNCTUATION = ".,;:?'\"()-"
_CLASSES = np.zeros((256, 9), np.float64)
for _c in range(256):
    _CLASSES[_c] = [
        97 <= _c <= 122, 65 <= _c <= 90, 48 <= _c <= 57, _c in (32, 9, 11, 12, 13), _c == 10,
        chr(_c) in PUNCTUATION, chr(_c) in SYMBOLS, _c >= 128, _c < 9 or 14 <= _c < 32,
    ]
_SHOWN = np.array([ord(c) for c in "$%&#*|!@."])
N_FEATURES = 9 + len(_SHOWN) + 9


def statistics(text: str | None) -> np.ndarray:
    """N_FEATURES numbers about the whole text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n = len(raw)
    out[:9] = counts @ _CLASSES / n
    k = 9 + len(_SHOWN)
    out[9:k] = counts[_SHOWN] / n
    words = text.split()
    m = len(words)
    if m:
        distinct = set(words)
        out[k : k + 9] = [
            math.log1p(n), math.log1p(m), n / m, len(distinct) / m,
            sum(map(operator.eq, words, words[1:])) / m,
            sum(map(len, distinct)) / len(distinct), max(map(len, distinct)),
            out[1] / (out[0] + out[1] + 1e-9), len(distinct) / math.sqrt(m),
        ]
    return out


def features(texts: pd.Series) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))


@dataclass
class Trees:
    """Complete binary trees of equal depth, flattened: node i has children
    2i+1 and 2i+2; rows with x <= threshold go left."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    inner, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return Trees(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T)], axis=1)
    nf = x.shape[1]
    margin = np.full(len(y), base)
    feats, thrs, leafs = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            flat = ((at[:, None] * nf + np.arange(nf)) * bins + binned).ravel()
            size = width * nf * bins
            hg = np.bincount(flat, np.repeat(g, nf), size).reshape(width, nf, bins).cumsum(2)
            hh = np.bincount(flat, np.repeat(h, nf), size).reshape(width, nf, bins).cumsum(2)
            sg, sh = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + l2) + (sg - hg) ** 2 / (sh - hh + l2) - sg**2 / (sh + l2)
            gain[(hh < least) | (sh - hh < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + k], t[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        at = node - inner
        value = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        margin += value[at]
        feats.append(f), thrs.append(t), leafs.append(value)
    return Trees(base, depth, np.array(feats), np.array(thrs), np.array(leafs))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Trees:
    """Learn labels.quality from rows outside the held-out fold."""
    spark = docs.sparkSession
    common.ship(spark)
    picked = (
        labels.where(F.col("quality").isin(0, 1) & (common.id_bucket("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(common.hash_order("doc_id"), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # max_rows ids at most

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["quality"].astype("int32"), "x": list(features(pdf["text"]))})

    # One row an id, combined where the rows are: max_rows rows at most.
    got = rows.mapInPandas(stats, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, N_FEATURES))
    return train(x, got["y"].to_numpy(np.float64))


def with_score(docs: DataFrame, model: Trees, out: str = "score") -> DataFrame:
    """docs with a column of quality scores from text alone."""
    common.ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(features(texts)))

    return docs.withColumn(out, score(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at least `threshold`, with their own columns."""
    kept = with_score(docs, fit(docs, labels), "__quality")
    return kept.where(F.col("__quality") >= threshold).drop("__quality")


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    model = fit(docs, labels)
    return with_score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(common.id_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
