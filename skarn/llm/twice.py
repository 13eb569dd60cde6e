"""Bits seen twice, in segments that are dealt by number.

Each task notes, for each segment its keys fall in, the bits it set once and
twice; segments meet by number, and a bit counts as seen twice if all tasks
together set it twice.  The work of a task and of a segment does not grow with
the input; the number of segments does.

A filter that no executor holds is asked the other way round: the keys are dealt
to shards of the filter, each key with what its owner is known by, and those whose
bits are set come out.  A shard of which many keys are asked, because many texts
hold one of them, is copied, and its questions are dealt to the copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENT = 1 << 16
BYTES = SEGMENT // 8
SCHEMA = "seg long, asked long, once binary, twice binary"
#: Bits of a shard, questions that one copy of a shard answers, and questions that
#: a task holds before it deals them.
SHARD, QUESTIONS, HELD = 1 << 23, 1 << 21, 1 << 20


def notes(positions: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows (segment, positions, bits set, bits set more than once) of a task."""
    pos, counts = np.unique(positions, return_counts=True)
    seg, start = np.unique(pos >> 16, return_index=True)
    stop = np.append(start[1:], len(pos))
    low = pos.astype(np.uint16)
    asked = np.add.reduceat(counts, start) if len(pos) else counts
    for k in range(0, len(seg), 512):
        rows = range(k, min(k + 512, len(seg)))
        yield pd.DataFrame({
            "seg": seg[rows.start : rows.stop].astype(np.int64),
            "asked": asked[rows.start : rows.stop].astype(np.int64),
            "once": [low[start[i] : stop[i]].tobytes() for i in rows],
            "twice": [low[start[i] : stop[i]][counts[start[i] : stop[i]] > 1].tobytes() for i in rows],
        })


def _merge(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count, asked = np.zeros(SEGMENT, np.uint8), 0
    for pdf in pdfs:
        asked += int(pdf["asked"].sum())
        for column in ("once", "twice"):
            for blob in pdf[column]:
                at = np.frombuffer(blob, np.uint16)  # distinct in a blob
                count[at] = np.minimum(count[at] + 1, 2)
    yield pd.DataFrame({"seg": [key[0]], "asked": [asked], "once": [b""], "twice": [np.packbits(count > 1, bitorder="little").tobytes()]})


def merged(parts: DataFrame) -> DataFrame:
    """seg, asked, twice: positions noted in each segment, and its bits seen twice."""
    return parts.groupBy("seg").applyInPandas(_merge, SCHEMA).select("seg", "asked", "twice")


def collected(parts: DataFrame, bits: int) -> np.ndarray:
    """All segments joined; for a number of bits whose size has been checked."""
    out = np.zeros(bits // 8, np.uint8)
    for row in merged(parts).toLocalIterator(True):
        out[row.seg * BYTES : (row.seg + 1) * BYTES] = np.frombuffer(row.twice, np.uint8)
    return out


def has(filt: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether each position's bit is set."""
    return ((filt[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1).astype(bool)


QUESTION = "shard long, keys binary, owners binary"


def questions(batches: Iterator[tuple[np.ndarray, np.ndarray]], place: Callable[[np.ndarray], np.ndarray]) -> Iterator[pd.DataFrame]:
    """Rows of QUESTION for batches of keys (uint64) and as many owners, which are
    records; place() gives each key's positions, all of them in one shard."""

    def dealt() -> pd.DataFrame:
        keys, owners = np.concatenate([k for k, _ in held]), np.concatenate([o for _, o in held])
        shard = place(keys)[:, 0] // SHARD
        order = np.argsort(shard, kind="stable")
        keys, owners = keys[order], owners[order]
        number, start = np.unique(shard[order], return_index=True)
        ends = list(zip(start, [*start[1:], len(keys)]))
        return pd.DataFrame({"shard": number, "keys": [keys[a:b].tobytes() for a, b in ends], "owners": [owners[a:b].tobytes() for a, b in ends]})

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for keys, owners in batches:
        if len(keys):
            held.append((keys, owners))
            size += len(keys)
        if size >= HELD:
            yield dealt()
            held, size = [], 0
    if held:
        yield dealt()


def answered(asked: DataFrame, segments: DataFrame, place: Callable[[np.ndarray], np.ndarray], owner: np.dtype, schema: str) -> DataFrame:
    """key and the owner's fields of each question whose bits were all seen twice;
    segments as merged() gives them, written, as they are read several times."""
    per = SHARD // SEGMENT
    segments = segments.withColumn("shard", F.floor(F.col("seg") / per).cast("long"))
    load = segments.groupBy("shard").agg(F.sum("asked").alias("load")).where(F.col("load") > QUESTIONS)
    hot = common.materialise(load.select("shard", F.ceil(F.col("load") / QUESTIONS).cast("int").alias("copies")), "hot")
    one = F.coalesce("copies", F.lit(1))
    copied = segments.join(hot, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), one - 1))).select("shard", "copy", "seg", "twice")
    asked = asked.join(hot, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("owners"), one).cast("int")).select("shard", "copy", "keys", "owners")

    def answer(group: tuple[Any, ...], questions: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SHARD // 8, np.uint8)
        for seg, blob in zip(filt["seg"], filt["twice"]):
            at = int(seg) % per * BYTES
            bits[at : at + BYTES] = np.frombuffer(blob, np.uint8)
        out = []
        for keys, owners in zip(questions["keys"], questions["owners"]):
            key = np.frombuffer(keys, np.uint64)
            yes = np.flatnonzero(has(bits, place(key) % SHARD).all(axis=1))
            own = np.frombuffer(owners, owner)[yes]
            out.append(pd.DataFrame({"key": key[yes].view(np.int64), **{name: own[name] for name in owner.names}}))
        if not out:
            return pd.DataFrame({"key": np.zeros(0, np.int64), **{name: np.zeros(0, owner[name]) for name in owner.names}})
        return pd.concat(out, ignore_index=True)

    by = ["shard", "copy"]
    return asked.groupBy(*by).cogroup(copied.groupBy(*by)).applyInPandas(answer, f"key long, {schema}")
