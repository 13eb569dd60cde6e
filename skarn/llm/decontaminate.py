"""Benchmark decontamination by template windows, in DataFrame functions alone.

Numbers, units after numbers and names become typed placeholders, so that a
question asked with other values has the same template.  Every K consecutive
template tokens of an item, one of which is a plain word at least, are hashed and
joined by equality with the windows of all documents.  A text holds an item if it
has at least COVERAGE of the item's windows along one alignment and its slots are
consistent there: a value of the item always stands for the same value of the
text.  An alignment is a range of 2 * DRIFT shifts (place in the text less place in
the item), so that up to DRIFT words may be put in or left out; the ranges overlap
by half, and of an item's alignments in a text the one with most windows counts
(the first of equal ones).

Windows of documents are never shuffled while the benchmark's windows are few
enough to broadcast (BROADCAST_ROWS, counted first); beyond that both sides are
dealt by hash.

Defined cases: null, blank and placeholder-only items match nothing; an item of
fewer than LEAST plain words is too common a phrase to mark a text, and only a
text that is nothing else holds it; null or blank texts hold nothing; a text is
judged by itself, also where other rows have its doc_id or the id is null, and
rows with the same id and text are one; items that repeat are matched each under
its own id; columns besides id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

K, COVERAGE, CONSISTENT = 5, 0.5, 0.75
#: Words by which an alignment may drift, and plain words an item needs.
DRIFT, LEAST = 8, 5
BROADCAST_ROWS = 2_000_000
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Placeholders: a token that stands for a value starts with one of these.
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
#: Unit words that may follow a number.
UNITS = "km|cm|mm|m|kg|mg|g|lbs?|oz|ft|inch(?:es)?|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|lit(?:er|re)s?|ml|l|hours?|hrs?|h|minutes?|mins?|seconds?|secs?|s|days?|weeks?|months?|years?|percent|dollars?|euros?|pounds?|cents?|usd|eur|mph|kmh|degrees?"
NUMBER_AND_UNIT = rf"(?i)([0-9][0-9.,:/]*)\s*({UNITS}|%)(?![\p{{L}}\p{{N}}])"
PRICE = r"([$€£])\s*([0-9])"
NUMBER_ALONE = r"(?<![\x01\p{L}\p{N}.,:/])([0-9])"
#: A capitalised word that does not start a sentence.
NAME_WORD = r"(?<=[^.!?:;\s]\s)(\p{Lu}[\p{Ll}\p{M}]+)(?![\p{L}])"
PUNCTUATION = r"(?<![0-9])[^\p{L}\p{M}\p{N}\x01-\x03]+|[^\p{L}\p{M}\p{N}\x01-\x03]+(?![0-9])"


def tokens(text: Column) -> Column:
    """Template tokens of a text; placeholders keep their value after the mark."""
    out = F.regexp_replace(text, NAME_WORD, NAME + "$1")
    has_digit = F.rlike(text, F.lit("[0-9]"))
    numbered = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, NUMBER_AND_UNIT, f" {NUMBER}$1 {UNIT}$2 "), PRICE, f" {UNIT}$1 {NUMBER}$2"), NUMBER_ALONE, f" {NUMBER}$1")
    out = F.when(has_digit, numbered).otherwise(out)
    out = F.trim(F.regexp_replace(F.lower(out), PUNCTUATION, " "))
    return F.when(out != "", F.split(out, " +")).otherwise(F.array().cast("array<string>"))


def _window(h: Column, k: int) -> Column:
    """Hashes of all complete runs of k tokens."""
    runs = F.transform(h, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(h, i + j) for j in range(1, k)]))
    return F.slice(runs, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))


def _hashed(df: DataFrame) -> DataFrame:
    mark = lambda w: F.when(w < "\x04", F.substring(w, 1, 1)).otherwise(w)
    return df.withColumn("h", F.transform("tokens", lambda w: F.xxhash64(mark(w))))


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, matched (item windows found), windows (of the item),
    n_slots (values of the item in them), n_consistent, verbatim: a row for each
    item a text holds."""
    return _leaks(docs, items, coverage).drop("text_hash")


def _leaks(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    plain = lambda w: w >= "\x04"
    own = items.where("item_id is not null and text is not null").select("item_id", F.col("text").alias("item_text")).distinct()
    own = own.select("item_id", tokens(F.col("item_text")).alias("tokens"))
    own = own.withColumn("plain", F.size(F.filter("tokens", plain))).where("plain > 0")
    own = _hashed(own).withColumn("len", F.least(F.size("tokens"), F.lit(K)))
    own = common.materialise(own.withColumn("key", F.xxhash64("item_id", "tokens")), "items")
    lengths = sorted(r[0] for r in own.select("len").distinct().collect())  # K numbers at most
    wins = None
    for k in lengths:
        part = own.where(F.col("len") == k).select("key", "tokens", F.posexplode(_window(F.col("h"), k)).alias("ipos", "win"))
        part = part.where(F.exists(F.slice("tokens", F.col("ipos") + 1, k), plain)).drop("tokens")
        wins = part if wins is None else wins.unionAll(part)
    if wins is None:
        return docs.limit(0).select(F.col("doc_id").cast("long").alias("doc_id")).selectExpr("doc_id", "0L text_hash", "cast(null as bigint) item_id", "0L matched", "0L windows", "0L n_slots", "0L n_consistent", "true verbatim")
    wins = common.materialise(wins, "windows")
    sizes = own.select("key", "item_id", F.size("tokens").alias("n_tokens"), "plain").join(wins.groupBy("key").agg(F.count("*").alias("windows")), "key")
    few = wins.count() <= BROADCAST_ROWS
    wins = wins.groupBy("win", "key").agg(F.collect_list("ipos").alias("ipos"))
    wins = F.broadcast(wins) if few else wins

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    hashed = _hashed(texts.select("doc_id", "text_hash", tokens(F.col("text")).alias("tokens"))).select("doc_id", "text_hash", F.size("h").alias("n_doc"), "h")
    all_windows = F.concat(*[F.transform(_window(F.col("h"), k), lambda w, i: F.struct(i.alias("dpos"), w.alias("win"))) for k in lengths]) if len(lengths) > 1 else None
    if all_windows is None:
        each = hashed.select("doc_id", "text_hash", "n_doc", F.posexplode(_window(F.col("h"), lengths[0])).alias("dpos", "win"))
    else:
        each = hashed.select("doc_id", "text_hash", "n_doc", F.inline(all_windows))
    hits = each.join(wins, "win").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_hash", "n_doc", "key", "dpos", F.explode("ipos").alias("ipos"))
    hits = common.materialise(hits.withColumn("shift", F.col("dpos") - F.col("ipos")).drop("dpos"), "hits")

    at = ["doc_id", "text_hash", "key"]
    band = F.floor(F.col("shift") / DRIFT)
    banded = hits.withColumn("band", F.explode(F.array(band, band - 1)))
    counted = banded.groupBy(*at, "band", "ipos").agg(F.max("n_doc").alias("n_doc")).groupBy(*at, "band").agg(F.count("*").alias("matched"), F.max("n_doc").alias("n_doc"))
    best = counted.groupBy(*at).agg(F.max(F.struct("matched", (-F.col("band")).alias("back"), "n_doc")).alias("best"))
    held = best.select(*at, "best.matched", (-F.col("best.back")).alias("band"), "best.n_doc").join(sizes, "key")
    alone = (F.col("n_doc") == F.col("n_tokens")) & (F.col("matched") == F.col("windows"))
    held = held.where((F.col("matched") >= coverage * F.col("windows")) & ((F.col("plain") >= LEAST) | alone))
    held = common.materialise(held.select(*at, "item_id", "matched", "windows", "band"), "held")
    # Slots: item values against text values, along the alignment.
    marked = own.select("key", "len", F.transform("tokens", lambda w: F.when(w < "\x04", w)).alias("slots")).where(F.exists("slots", lambda w: w.isNotNull()))
    near = banded.join(held.select(*at, "band"), [*at, "band"], "left_semi").join(F.broadcast(marked) if few else marked, "key")
    spots = near.select(*at, "shift", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + F.col("len") - 1)).alias("at"), "slots")
    spots = spots.select(*at, "shift", "at", F.get("slots", F.col("at")).alias("value")).where("value is not null").distinct()
    spots = common.materialise(spots, "spots")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    none = F.lit(0).cast("long")
    # No item of the benchmark has slots more often than not: then no text is read again.
    if spots.isEmpty():
        return held.select(real, "text_hash", "item_id", "matched", "windows", none.alias("n_slots"), none.alias("n_consistent"), F.lit(True).alias("verbatim"))
    readers = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(spots.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi")
    readers = readers.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", tokens(F.col("text")).alias("doc_tokens"))
    seen = spots.join(readers, ["doc_id", "text_hash"]).select(*at, "at", "value", F.struct("shift", F.get("doc_tokens", F.col("at") + F.col("shift")).alias("v")).alias("doc"))
    # A slot has one value, that of its first shift.
    seen = seen.groupBy(*at, "at", "value").agg(F.min("doc").alias("doc")).withColumn("v", F.col("doc.v"))
    slots = (
        seen.groupBy(*at, "value").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        .groupBy(*at).agg(
            F.count("value").alias("n_slots"), F.count(F.when(F.col("low").eqNullSafe(F.col("high")), 1)).alias("n_consistent"),
            F.min(F.col("low").eqNullSafe(F.col("value")) & F.col("high").eqNullSafe(F.col("value"))).alias("verbatim"),
        )
    )
    out = held.join(slots, at, "left")
    out = out.select(real, "text_hash", "item_id", "matched", "windows", F.coalesce("n_slots", none).alias("n_slots"), F.coalesce("n_consistent", none).alias("n_consistent"), F.coalesce("verbatim", F.lit(True)).alias("verbatim"))
    return out.where(F.col("n_consistent") >= CONSISTENT * F.col("n_slots"))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark item, with their own columns."""
    bad = _leaks(docs, items, COVERAGE).select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__leak_id"]) & (F.xxhash64(docs["text"]) == bad["__leak_hash"]), "left_anti")
