"""Document fingerprints by winnowing, in DataFrame functions alone.

Words are hashed, each K consecutive words give a k-gram hash, and from every
WINDOW consecutive k-grams the smallest hash is chosen, the rightmost of equal
ones; texts of fewer than SHORT k-grams keep all of them, so that short near
copies stay alike.  Chosen hashes are kept with their positions.  Two texts that
share WINDOW + K - 1 consecutive words share a hash.

An entry is one long: HASH_BITS of the hash, then the position counted from the
largest downwards, so that `least` picks the smallest hash and, among equal
ones, the rightmost.

Defined cases: null or blank text has an empty fingerprint; fewer than K words
give one k-gram of all of them; two empty fingerprints are alike (1.0), one empty
and one not are unlike (0.0); rows of one id follow each other by the hash of their
text, then by the text; null ids come last (the smallest long counts as null);
the next of a single document is itself; columns besides id and text are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 4, 4
#: Texts of fewer k-grams keep all of them.
SHORT = 32
POSITION_BITS, HASH_BITS = 27, 36
LAST_POSITION = (1 << POSITION_BITS) - 1
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def _complete(col: Column, width: int) -> Column:
    """The entries that start a complete run of `width`, or the first alone."""
    n = F.size(col)
    return F.slice(col, 1, F.greatest(n - (width - 1), F.least(n, F.lit(1))))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<bigint> column `out`: the entries of column `text`.

    Each step is a column of its own, so that no step is evaluated twice."""
    t = [f"__w{i}_{out}" for i in range(5)]
    df = df.withColumn(t[0], F.trim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WS_CHARS)))
    words = F.when(F.col(t[0]) == "", F.array().cast("array<string>")).otherwise(F.split(t[0], WS))
    df = df.withColumn(t[1], F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(t[1])
    grams = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, K)]))
    df = df.withColumn(t[2], _complete(grams, K))
    packed = F.transform(
        F.col(t[2]),
        lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 64 - HASH_BITS), POSITION_BITS).bitwiseOR(F.lit(LAST_POSITION).cast("long") - i),
    )
    df = df.withColumn(t[3], packed)
    p = F.col(t[3])
    df = df.withColumn(t[4], F.transform(p, lambda x, i: F.least(x, *[F.get(p, i + k) for k in range(1, WINDOW)])))
    chosen = F.when(F.size(p) < SHORT, p).otherwise(_complete(F.col(t[4]), WINDOW))
    return df.withColumn(out, F.array_distinct(chosen)).drop(*t)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, POSITION_BITS)))


def positions(fingerprint: Column) -> Column:
    """Word positions of the entries, from 0."""
    return F.transform(fingerprint, lambda x: F.lit(LAST_POSITION).cast("long") - x.bitwiseAND(F.lit(LAST_POSITION).cast("long")))


def as_string(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.hex(x)), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


#: Neighbours: rows in a bucket, and most buckets of each of the two levels.
BUCKET_ROWS, COARSE, FINE = 1_500, 1_000, 1_000
#: Stands for a null doc_id, which comes last.
NO_ID = -(1 << 63)
_LAST = (1 << 63) - 1


def _bounds(values: list[int]) -> list[int]:
    """Sorted cuts at quantiles; a value that fills several is cut out alone."""
    repeated = {a for a, b in zip(values, values[1:]) if a == b}
    return sorted({*values, *(v + 1 for v in repeated if v < _LAST)})


def _at(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value))


def with_bucket(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with their order o, hash and bucket q, s, h, which grows
    with (o, hash): o grows as doc_id falls.  q and s are quantiles of o at two
    levels, h a range of hashes of texts where one id fills more than a bucket, so
    buckets are of like size however ids are spread, repeated or null."""
    docs = docs.select("doc_id", "text", F.bitwise_not(F.coalesce("doc_id", F.lit(NO_ID))).alias("o"), F.xxhash64("text").alias("hash"))
    rows = docs.count()
    coarse = max(1, min(COARSE, int((rows / BUCKET_ROWS) ** 0.5)))
    fine = max(1, min(FINE, -(-rows // (coarse * BUCKET_ROWS))))
    share = lambda n: [k / n for k in range(1, n)]
    outer = _bounds(docs.agg(F.percentile_approx("o", share(coarse), 100_000)).first()[0] or []) if coarse > 1 else []
    q = _at(F.array(*map(F.lit, outer)).cast("array<bigint>"), F.col("o")) if outer else F.lit(0)
    docs = docs.withColumn("q", q)
    # COARSE * FINE numbers at most.
    inner = docs.groupBy("q").agg(F.count("*").alias("n"), (F.percentile_approx("o", share(fine), 100_000) if fine > 1 else F.array().cast("array<bigint>")).alias("at")).collect()
    table = []
    for r in inner:
        at = list(r["at"] or [])
        cuts = _bounds(at)
        alone = [max(1, round(at.count(c) / fine * r["n"] / BUCKET_ROWS)) if c + 1 in cuts or c == _LAST else 1 for c in cuts]
        table.append({"__q": r["q"], "cuts": cuts, "parts": [1, *alone]})
    held = F.from_json(F.lit(json.dumps(table)), "array<struct<__q int, cuts array<bigint>, parts array<int>>>")
    cuts = docs.sparkSession.range(1).select(F.inline(held))
    docs = docs.join(F.broadcast(cuts), F.col("q") == F.col("__q")).withColumn("s", _at(F.col("cuts"), F.col("o")))
    place = (F.col("hash") / F.lit(2.0**64) + 0.5) * F.get("parts", F.col("s"))
    return docs.withColumn("h", F.least(F.floor(place), F.get("parts", F.col("s")) - 1).cast("int")).drop("__q", "cuts", "parts")


def with_next(docs: DataFrame, prepare, carried: list[str]) -> DataFrame:
    """prepare(docs) with next_<c> of the columns `carried`: each column of the next
    document in descending doc_id (hash of the text, then text among equal ids;
    null ids last), and after the last of the first.

    Rows are dealt to buckets of neighbours and sorted there.  The first row of
    each bucket also goes, as a ghost, to the end of the bucket before it; so one
    shuffle finds every neighbour."""
    bucket = ["q", "s", "h"]
    docs = with_bucket(docs)
    firsts = docs.groupBy(*bucket).agg(F.min(F.struct("o", "hash")).alias("first"))
    by_s = Window.partitionBy("q").orderBy("s", "h")
    tops = firsts.groupBy("q").agg(F.min("first").alias("top"))  # as many rows as coarse buckets
    by_q = Window.orderBy("q")
    after = tops.select(F.col("q").alias("of"), F.lead("top").over(by_q).alias("following"), F.first("top").over(by_q).alias("start"))
    links = (
        firsts.withColumn("sibling", F.lead("first").over(by_s)).join(F.broadcast(after), F.col("q") == F.col("of"))
        .select(*[F.col(c).alias(f"g{c}") for c in bucket], F.coalesce("sibling", "following", "start").alias("ghost"))
        .select("gq", "gs", "gh", F.col("ghost.o").alias("go"), F.col("ghost.hash").alias("ghash"))
    )
    links = F.broadcast(links)  # COARSE * FINE rows, and one for each BUCKET_ROWS rows of one id
    own = docs.select("doc_id", "text", "o", "hash", *bucket, F.lit(0).alias("ghost_row"))
    ghosts = docs.join(links, (F.col("o") == F.col("go")) & (F.col("hash") == F.col("ghash"))).select("doc_id", "text", "o", "hash", *[F.col(f"g{c}").alias(c) for c in bucket], F.lit(1).alias("ghost_row")).distinct()
    order = Window.partitionBy(*bucket).orderBy("ghost_row", "o", "hash", "text")
    out = prepare(own.unionAll(ghosts))
    return out.select("doc_id", "ghost_row", *carried, *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("ghost_row = 0").drop("ghost_row")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(texts, lambda df: with_fingerprint(df, "text", "fp"), ["text", "fp"])
    n, m = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    near = near.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)))
    near = near.select("doc_id", n.cast("long").alias("n_chars"), "edited", "fp", hashes(F.col("next_fp")).alias("next_h"), hashes(F.col("fp")).alias("h"))
    near = with_fingerprint(near, "edited", "edited_fp").withColumn("edited_h", hashes(F.col("edited_fp")))
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("edited_h")).alias("near_edited"), likeness(F.col("h"), F.col("next_h")).alias("near_next"),
    )
