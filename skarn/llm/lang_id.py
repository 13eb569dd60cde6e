"""Language identification with a byte convolutional network in numpy.

A text is cut into fixed windows of WINDOW bytes (the last is padded with byte
0).  Each byte has an embedding; filters of several widths slide over the
window, are rectified and max-pooled, and a softmax layer gives language
probabilities.  A document's log-probabilities are the mean over all its
windows, weighted by their bytes, so whole texts count.

All widths run as one matrix product: narrow filters are padded with zero
weights to the widest.  Back-propagation touches only the winning position of
each filter.

Training takes at most MAX_TRAIN labelled documents in a fixed hash order of
ids, and of all windows of their whole texts at most MAX_WINDOWS: turn by turn one
of each document, in a fixed hash order.

Defined cases: null text or text without a letter is `und` with score 0; when
nothing can be learned every text is `und`; a null id is never learned from nor
held out; rows that repeat count once in training and get equal predictions; of
equal probabilities the language first in the alphabet is taken; columns besides
id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
MAX_TRAIN, MAX_WINDOWS, EPOCHS, RATE = 4_000, 12_000, 4, 0.01
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
WIDEST = max(WIDTHS)
#: Windows handled at once, so that activations stay in the processor's cache.
BATCH = 48


def _mask() -> np.ndarray:
    mask = np.zeros((WIDEST, len(WIDTHS), FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[:w, k] = 1
    return np.repeat(mask.reshape(WIDEST, 1, -1), EMBED, 1).reshape(WIDEST * EMBED, -1)


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # WIDEST * EMBED x filters of all widths
    bias: np.ndarray
    dense: np.ndarray  # filters x languages
    out: np.ndarray

    def pooled(self, windows: np.ndarray):
        """Patches, pooled activations and winning positions."""
        e = self.embed[windows]
        n, width = windows.shape
        steps = width - WIDEST + 1
        view = np.lib.stride_tricks.sliding_window_view(e, WIDEST, axis=1)  # n, steps, EMBED, WIDEST
        patches = np.ascontiguousarray(view.swapaxes(2, 3)).reshape(n * steps, -1)
        act = (patches @ self.conv).reshape(n, steps, -1)
        return patches, act

    def logits(self, windows: np.ndarray) -> np.ndarray:
        _, act = self.pooled(windows)
        return np.maximum(act.max(1) + self.bias, 0) @ self.dense + self.out

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.logits(windows[k : k + BATCH]) for k in range(0, len(windows), BATCH)])
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts) -> tuple[list[str], list[float]]:
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> None:
            logs = self.log_probs(np.concatenate([w for _, w, _ in held]))
            at = 0
            for k, w, weight in held:
                z = weight @ logs[at : at + len(w)] / weight.sum()
                at += len(w)
                p = np.exp(z - z.max())
                p /= p.sum()
                best = int(p.argmax())
                pred[k], score[k] = self.langs[best], float(min(1.0, max(0.0, p[best])))

        for k, text in enumerate(texts):
            if not self.langs or not text or not LETTER.search(text):
                continue
            held.append((k, *windows_of(text)))
            n += len(held[-1][1])
            if n >= 4096:
                flush()
                held, n = [], 0
        if held:
            flush()
        return pred, score


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text and the number of bytes in each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = -(-len(raw) // WINDOW)
    flat = np.zeros(n * WINDOW, np.uint8)
    flat[: len(raw)] = raw
    weight = np.full(n, WINDOW, np.float32)
    weight[-1] = len(raw) - (n - 1) * WINDOW
    return flat.reshape(n, WINDOW), weight


def train(windows: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    mask = _mask()
    nf = mask.shape[1]
    net = Net(
        langs, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(nf, np.float32),
        rng.normal(0, 0.2, (nf, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    if not len(y):
        return net
    names = ("embed", "conv", "bias", "dense", "out")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    share = np.bincount(y, minlength=len(langs)) / len(y)
    weight = 1 / np.sqrt(np.maximum(share, 1e-3))
    step = 0
    steps = windows.shape[1] - WIDEST + 1
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            idx = order[k : k + BATCH]
            w, n = windows[idx], len(idx)
            patches, act = net.pooled(w)
            at = act.argmax(1)  # n x nf
            top = np.take_along_axis(act, at[:, None], 1)[:, 0] + net.bias
            hidden = np.maximum(top, 0)
            z = hidden @ net.dense + net.out
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p
            d[np.arange(n), y[idx]] -= 1
            d *= (weight[y[idx]] / weight[y[idx]].sum())[:, None]
            grad = {"dense": hidden.T @ d, "out": d.sum(0)}
            dh = (d @ net.dense.T) * (top > 0)
            grad["bias"] = dh.sum(0)
            rows = (np.arange(n)[:, None] * steps + at).ravel()
            won = patches[rows].reshape(n, nf, -1)
            grad["conv"] = np.einsum("nfp,nf->pf", won, dh) * mask
            de = np.einsum("nf,pf->nfp", dh, net.conv).reshape(n, nf, WIDEST, EMBED)
            where = w[np.arange(n)[:, None, None], at[:, :, None] + np.arange(WIDEST)]
            ge = np.zeros_like(net.embed)
            np.add.at(ge, where.ravel(), de.reshape(-1, EMBED))
            grad["embed"] = ge
            step += 1
            for name in names:
                g = grad[name]
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                scale = RATE / (1 - 0.9**step)
                getattr(net, name)[...] -= scale * m[name] / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, max_rows: int = MAX_TRAIN, max_windows: int = MAX_WINDOWS) -> Net:
    """Learn lang from documents outside the held-out fold."""
    common.ship(docs.sparkSession)
    picked = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.id_bucket("doc_id", FOLDS) != HELD_OUT))
        .select("doc_id").orderBy(common.hash_order("doc_id"), "doc_id").limit(max_rows).distinct()
    )
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").join(F.broadcast(picked), "doc_id")  # max_rows ids at most

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                if LETTER.search(text):
                    w, _ = windows_of(text)
                    yield pd.DataFrame({"doc_id": doc, "k": np.arange(len(w)), "lang": lang, "w": [x.tobytes() for x in w]})

    some = rows.mapInPandas(cut, "doc_id long, k long, lang string, w binary").distinct()
    some = some.withColumn("h", F.xxhash64(F.lit("window"), "doc_id", "k", "w"))
    # Turn by turn a window of every document, so that long ones do not outweigh others.
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "lang"))
    got = some.withColumn("turn", turn).where(F.col("turn") <= max_windows).orderBy("turn", "h", "lang").limit(max_windows).toPandas()
    langs = sorted(set(got["lang"]))
    windows = np.stack([np.frombuffer(w, np.uint8) for w in got["w"]]) if len(got) else np.zeros((0, WINDOW), np.uint8)
    return train(windows, np.array([langs.index(x) for x in got["lang"]], np.int64), langs)


def predict(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document, from text alone."""
    common.ship(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pred, score = net.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    held = F.coalesce(common.id_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), guess("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
