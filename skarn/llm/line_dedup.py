"""Line deduplication with two Bloom filters.

Pass 1 reads every text and builds, in each task, two filters: bits of line keys
seen once and bits of keys seen twice.  Segments of the filters meet by segment
number; a bit counts as seen twice if some task saw it twice or two tasks saw it
at all, so the merged filter has no false negatives.  Pass 2 emits only keys that
the second filter suspects; they alone are shuffled, as exact strings, to be
counted and to find the document that keeps them.  Pass 3 joins the confirmed
keys back by document and rewrites the texts.

The filter has 8 bits or more for every line, at every size, so the share of
lines suspected by chance stays below 5 %.  Up to HELD_BITS every executor holds
it; beyond that the hashes of lines (16 bytes each, with the document) are dealt
to its shards, and a shard with a hot line to several tasks.

Defined cases: a null or empty text is one empty line; keys under `min_chars`
code points always stay; a document that repeats a key counts once for it; rows
with the same doc_id count as one document and are decided alike; all rows with
a null doc_id are one document that ranks below all others (the smallest long
counts as null); other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, twice

MIN_CHARS, MIN_DOCS = 20, 3
#: A filter of so many bits is held by every executor; beyond that the hashes of
#: lines are dealt to its segments.
MIN_BITS, HELD_BITS = 1 << 20, 1 << 28
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, A-Z lower-cased line; None if it is too short to count."""
    key = line.strip(STRIP)
    n = len(key)
    if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return key.lower()  # bytes.lower() changes A-Z only


def keys_of(text: str | None, min_chars: int) -> set[bytes]:
    if not text:
        return set()
    raw = text.encode("utf-8", "surrogatepass").split(b"\n")
    keys = {line_key(x, min_chars) for x in raw}
    keys.discard(None)
    return keys


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    low = np.uint64(twice.SEGMENT - 1)
    seg = ((h >> np.uint64(32)) & np.uint64(bits // twice.SEGMENT - 1)) * np.uint64(twice.SEGMENT)
    return np.stack([seg | (h & low), seg | ((h >> np.uint64(16)) & low)], axis=1).astype(np.int64)


def probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Two bit positions for each key, in one segment."""
    return _places(_hashes(keys), bits)


def _filters(bits: int, min_chars: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        for pdf in batches:
            for text in pdf["text"]:
                keys = keys_of(text, min_chars)
                if keys:
                    found.append(probes(list(keys), bits).ravel())
            if len(found) > 200:
                found = [np.concatenate(found)]
        if found:
            yield from twice.notes(np.concatenate(found))
        del found
        common.trim()

    return build


def twice_filter(docs: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """The two filters of each task, for keys seen once and twice."""
    return docs.select("text").mapInPandas(_filters(bits, min_chars), twice.SCHEMA)


def filter_bits(lines: int) -> int:
    return max(MIN_BITS, 1 << max(0, 8 * lines - 1).bit_length())


def _suspects_here(texts: DataFrame, filt: np.ndarray, bits: int, min_chars: int) -> DataFrame:
    """doc_id, line: the suspected keys of each text, by a filter that every
    executor holds."""
    shared = texts.sparkSession.sparkContext.broadcast(filt)

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for pdf in batches:
            rows, keys = [], []
            for row, text in enumerate(pdf["text"]):
                own = keys_of(text, min_chars)
                keys.extend(own)
                rows.extend([row] * len(own))
            if not keys:
                continue
            at = np.flatnonzero(twice.has(held, probes(keys, bits)).all(axis=1))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[[rows[i] for i in at]], "line": [keys[i] for i in at]})

    return texts.mapInPandas(suspects, "doc_id long, line binary")


_OWNER = np.dtype([("__id", "<i8")])


def _suspects_dealt(texts: DataFrame, segments: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """The same where the filter is too large to be held: the keys' hashes, not
    the keys, are dealt to its shards, and suspected ones return to their texts by
    doc_id."""

    def place(hashes: np.ndarray) -> np.ndarray:
        return _places(hashes, bits)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].to_numpy(), pdf["text"]):
                keys = _hashes(list(keys_of(text, min_chars)))
                yield keys, np.full(len(keys), doc_id, np.int64).view(_OWNER)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from twice.questions(hashed(batches), place)

    asked = texts.mapInPandas(ask, twice.QUESTION)
    found = twice.answered(asked, segments, place, _OWNER, "__id long")
    found = found.groupBy("__id").agg(F.collect_set("key").alias("hashes"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, keys = [], []
            for row, (text, hashes) in enumerate(zip(pdf["text"], pdf["hashes"])):
                own = list(keys_of(text, min_chars))
                if own:
                    at = np.isin(_hashes(own).view(np.int64), hashes)
                    own = [k for k, yes in zip(own, at) if yes]
                keys.extend(own)
                rows.extend([row] * len(own))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[rows], "line": keys})

    held = texts.join(found, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "hashes")
    return held.mapInPandas(keep, "doc_id long, line binary")


def suspected(texts: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """doc_id, line: the keys that may occur in two documents."""
    parts = twice_filter(texts, bits, min_chars)
    if bits <= HELD_BITS:
        return _suspects_here(texts, twice.collected(parts, bits), bits, min_chars)
    return _suspects_dealt(texts, common.materialise(twice.merged(parts), "segments"), bits, min_chars)


def _rewriter(min_chars: int):
    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    def rewrite(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        total, dropped, digest, kept = [], [], [], []
        for text, drop in zip(texts, drops):
            raw = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            n, stay = len(raw), raw
            if drop is not None and len(drop):
                gone = {bytes(x) for x in drop}
                stay = [x for x in raw if line_key(x, min_chars) not in gone]
            new = b"\n".join(stay)
            total.append(n)
            dropped.append(n - len(stay))
            digest.append(hashlib.sha256(new).hexdigest())
            kept.append(new.decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"n_lines": total, "n_dropped": dropped, "kept_sha256": digest, "kept_text": kept})

    return rewrite


def _rewritten(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """docs with a struct column __ld of the rewriter's fields."""
    spark = docs.sparkSession
    common.ship(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    found = common.materialise(suspected(texts, filter_bits(lines), min_chars), "lines")
    # Exact confirmation: the distinct documents of each suspected key.
    repeats = (
        found.groupBy("line", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("line").agg(F.count("one").alias("docs"), F.max("doc_id").alias("owner"))
        .where(F.col("docs") >= min_docs)
        .select("line", "owner")
    )
    # Written, so that the join below deals both sides anew and a line that many
    # documents hold can be split over tasks.
    repeats = common.materialise(repeats, "repeats")
    drops = (
        found.join(repeats, "line")
        .where("doc_id <> owner")
        .groupBy("doc_id").agg(F.collect_set("line").alias("__ld_keys"))
        .withColumnRenamed("doc_id", "__ld_id")
    )
    joined = docs.join(drops, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == drops["__ld_id"], "left")
    return joined.withColumn("__ld", _rewriter(min_chars)(docs["text"], drops["__ld_keys"])).drop("__ld_id", "__ld_keys")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and kept_text for each row."""
    return _rewritten(docs.select("doc_id", "text"), min_chars, min_docs).select("doc_id", "__ld.*")


def rewrite_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The same columns, of the same types, and rows with repeated lines gone from
    text (and from n_chars, where that column exists)."""
    out = _rewritten(docs, min_chars, min_docs)
    new = {"text": F.col("__ld.kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__ld.kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
