"""N-gram Jaccard join with several global token orders.

A document's tokens are the 64-bit hashes of its distinct K-word shingles.  Two
documents link at a Jaccard similarity of SIMILAR percent or more.

1. Documents of equal token sets form a class, which is one node from here on.
2. Sets fall in ranges of size that overlap by the factor 0.75, so that any two
   sets that can link meet in one range.  In range c order A (a hash) gives each
   set a prefix of p + f tokens, p = n - ceil(s n) + 1, of which linking sets
   share f + 1 at least; the smallest sets put all tokens forward.  A filter of
   bits seen twice, of a third of a bit or more for each byte of text, finds the
   tokens that can occur in two classes: only they are indexed.  Up to HELD_BITS
   (some 1.6 GB of text) every executor holds it; beyond that the tokens put forward
   are dealt to its shards, once for all texts of one set that a task reads.
3. Order B (exact document frequency, rare first) ranks the tokens put forward,
   and the f most frequent are left out: of f + 1 common tokens the rarest is
   still there.  Classes that share no such token have no partner and drop out,
   as do those that have only a short passage in common with many others.
4. For the rest, order B ranks the whole sets, and the classical prefix of p
   tokens is indexed.  Passages that many documents share come last in that
   order and do not pair them; a set with more than a quarter of tokens of its
   own is not indexed at all.  A token pairs two sets only if it can be the
   first that they share: what follows its places in both must suffice, and
   parity bits of the two sets must not differ in more places than they may.
5. In each token's group all members are compared with one hub (in STARS rounds):
   a member with few tokens of its own, as that is the nearest to what a family
   of copies has in common.  What links is joined into components; then members of
   one group that are still in different components are compared.  Members of
   one component never are, nor are two members that both have the token so late
   that not even a set like their own could link by it.
6. A compared pair must also share a prefix token under order C (another hash)
   before its whole sets are intersected.  That count is exact.

Texts are read three times, and sets are built only for classes left after 3.

Defined cases: as the contract of the query states for short, empty and null
texts; rows of one doc_id are separate documents with one id and take the
smallest component among themselves only if their texts link; a null doc_id
ranks last and stays null (as does the largest long); columns besides id and text
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, twice

K, SIMILAR = 5, 75
#: The first range has sets up to SMALL tokens, each further one up to STEP times
#: as many; SPARE tokens are left out in the second, twice as many in each next.
SMALL, STEP, SPARE = 86, 4, 24
#: Words of 64 bits in a set's parity.
PARITY = 4
#: Rounds in which each token's group is compared with one hub, before the rest.
STARS = 1
MIN_BITS, HELD_BITS = 1 << 20, 1 << 29
NO_ID = (1 << 63) - 1
#: Texts hashed together; bounds the working arrays of a worker.
BATCH_BYTES = 1 << 18
#: A table of so many ids is broadcast; beyond that Spark shuffles both sides.
BROADCAST_IDS = 1_000_000

_U = np.uint64
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | _U(1)
_, _SALT_A, _SALT_C = (int(x) for x in _rng.integers(1, 1 << 62, 3))
_power = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _power
    while len(_power) < n:
        _power = np.concatenate([_power, _power * (_power[-1:] * _ODD[5])])
    return _power


def _hash_texts(raw: list[bytes]) -> list[np.ndarray]:
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[joined]
    word = ~space
    starts = np.flatnonzero(word & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(raw)
    stops = np.flatnonzero(space & np.concatenate([[False], word[:-1]]))
    length = stops - starts
    at = np.flatnonzero(word)
    first = np.cumsum(length) - length
    inside = np.arange(len(at)) - np.repeat(first, length)
    value = _BYTE[joined[at]] * _powers(int(length.max()) + 1)[inside]
    h = mix(np.add.reduceat(value, first) ^ (length.astype(np.uint64) * _ODD[6]))
    doc = np.searchsorted(ends, starts, "right")
    per = np.bincount(doc, minlength=len(raw))
    n = len(h)
    if n >= K:
        s = np.full(n - K + 1, _U(K))
        for j in range(K):
            s = s * _ODD[7] + h[j : n - K + 1 + j] * _ODD[j]
        s = mix(s)
    out, at_word = [], 0
    for count in per.tolist():
        if count >= K:
            out.append(np.unique(s[at_word : at_word + count - K + 1]))
        elif count:
            short = _U(count)
            with np.errstate(over="ignore"):
                for j in range(count):
                    short = short * _ODD[7] + h[at_word + j] * _ODD[j]
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at_word += count
    return out


def shingles(texts) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield from _hash_texts(held)
            held, size = [], 0
    if held:
        yield from _hash_texts(held)


def prefix_length(n: int) -> int:
    return n - -(-SIMILAR * n // 100) + 1


def prefix(n: Column) -> Column:
    return n - F.ceil(n * SIMILAR / 100) + 1


def range_of(n: int) -> int:
    """The first range that has sets of n tokens."""
    c = 0
    while n > SMALL * STEP**c:
        c += 1
    return c


def spare(c: int) -> int:
    return SPARE << (c - 1)


def _put(tokens: np.ndarray, c: int) -> np.ndarray:
    """Keys that a set puts forward in range c."""
    ranked = mix(tokens ^ mix(np.array([_SALT_A + c], np.uint64)))
    p = prefix_length(len(tokens)) + spare(c) if c else len(tokens)
    return np.partition(ranked, p - 1)[:p] if p < len(tokens) else ranked


def forward(tokens: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The first range of a set, the keys it puts forward there, and those in the
    next range if it belongs there too."""
    n, none = len(tokens), np.zeros(0, np.uint64)
    c = range_of(n)
    return c, _put(tokens, c) if n else none, _put(tokens, c + 1) if 100 * n > SIMILAR * SMALL * STEP**c else none


def put_forward(n: Column, c: Column) -> tuple[Column, Column]:
    """How many tokens are put forward, and how many of them count."""
    f = (SPARE * F.pow(F.lit(2), c - 1)).cast("long")
    put = F.least(n, prefix(n) + f)
    return F.when(c == 0, n).otherwise(put), F.when(c == 0, prefix(n)).otherwise(put - f)


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys & _U(bits - 1)).astype(np.uint32 if bits <= 1 << 32 else np.int64)


def _positions(bits: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        for pdf in batches:
            for tokens in shingles(pdf["text"]):
                for keys in forward(tokens)[1:]:
                    if len(keys):
                        found.append(_places(keys, bits))
            if len(found) > 200:
                found = [np.concatenate(found)]
        if found:
            yield from twice.notes(np.concatenate(found))
        del found
        common.trim()

    return build


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, comp: the smallest node each node of the edges a-b reaches, by
    alternating large-star and small-star steps until nothing changes."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = common.materialise(edges.select("a", "b").distinct(), name)
    before = mark(e)
    while True:
        near = both(e)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(low, "u")
        last = e
        small = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(low.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()
        e = common.materialise(small, name)
        common.discard(last)
        now = mark(e)
        if now == before:
            break
        before = now
    # At the end every edge goes from a component's smallest node.
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp"))


def _compatible() -> Column:
    """Whether two sets that have this key as their first common one in order B
    can link: their sizes, what can follow the key's places in both, and their
    parities, which differ in no more bits than the sets do in tokens."""
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    sizes = 100 * F.least("n", "n2") >= SIMILAR * F.greatest("n", "n2")
    differ = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"s{k}b"))) for k in range(PARITY)), F.lit(0))
    both = F.col("n") + F.col("n2")
    return sizes & ((100 + SIMILAR) * left >= SIMILAR * both) & ((100 + SIMILAR) * differ <= (100 - SIMILAR) * both)


def _early(n: str, place: str) -> Column:
    """Whether two sets of this size can link that have their first common token
    at this place.  Of two sets that _compatible() lets pass one is early: what
    follows in both is at most the mean of what follows in each."""
    return (100 + SIMILAR) * (F.col(n) - F.col(place)) >= 2 * SIMILAR * F.col(n)


def _signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _node(signature: bytes) -> int:
    """The number of a class in the graph of links."""
    return int.from_bytes(signature[:8], "little", signed=True)


def _parity(tokens: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY bits whether an odd number of tokens fall on it."""
    bits = 64 * PARITY
    odd = np.bincount((tokens.view(np.uint64) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: order C first, then the exact count."""
    x = sets.select(F.col("rep").alias("a"), F.col("n").alias("xn"), F.col("tokens").alias("xt"))
    y = sets.select(F.col("rep").alias("b"), F.col("n").alias("yn"), F.col("tokens").alias("yt"))
    first = lambda tokens, n: F.slice(tokens, F.lit(1), prefix(F.col(n)).cast("int"))
    both = F.when(F.arrays_overlap(first("xt", "xn"), first("yt", "yn")), F.size(F.array_intersect("xt", "yt"))).otherwise(0)
    out = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.col("xn") + F.col("yn")).alias("total"))
    return out.where(100 * F.col("both") >= SIMILAR * (F.col("total") - F.col("both"))).select("a", "b")


def _rare_first(index: DataFrame, owner: list[str], put: Column, most: Column) -> DataFrame:
    """Rows of an index (key, rep, n) whose key is among the `most` rarest of the
    `put` keys of its owner.  Keys of one owner alone come first in the order;
    they have no rows in the result, but count in the others' `place` (from 0)."""
    df = index.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy(*owner)
    ranked = index.join(df, "key").withColumn("rank", F.row_number().over(own.orderBy("df", "key"))).withColumn("repeated", F.count("*").over(own))
    return ranked.withColumn("place", put - F.col("repeated") + F.col("rank") - 1).where(F.col("place") < most)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    real = lambda c: F.when(c != NO_ID, c)
    return _joined(docs).select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "doc_id")).alias("component_id"))


def _index_here(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n, sig), classes (sig, rep, first) and the index
    (rep, n, range, key) of keys that may be put forward by two classes, by a filter
    that every executor holds."""
    parts = docs.select("text").mapInPandas(_positions(bits), twice.SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(twice.collected(parts, bits))

    def profile_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filt = shared.value

        def suspects(keys: np.ndarray) -> np.ndarray:
            return _as_long(keys[twice.has(filt, _places(keys, bits).astype(np.int64))])

        for pdf in batches:
            n, sig, ranges, own, up = [], [], [], [], []
            for tokens in shingles(pdf["text"]):
                c, a, b = forward(tokens)
                n.append(len(tokens))
                sig.append(_signature(tokens))
                ranges.append(c)
                own.append(suspects(a))
                up.append(suspects(b))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "n": n, "sig": sig, "rep": list(map(_node, sig)), "range": ranges, "own": own, "up": up})
        common.trim()

    profile = common.materialise(docs.mapInPandas(profile_of, "doc_id long, text_hash long, n long, sig binary, rep long, range int, own array<long>, up array<long>"), "profile")
    reps = profile.where("n > 0").groupBy("sig").agg(F.first("rep").alias("rep"), F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("range").alias("range"), F.first("own").alias("own"), F.first("up").alias("up"))
    reps = common.materialise(reps, "reps")
    whole, profile = profile, common.materialise(profile.select("doc_id", "text_hash", "n", "sig"), "rows")
    common.discard(whole)
    index = reps.select("rep", "n", "range", F.explode("own").alias("key")).unionAll(reps.select("rep", "n", (F.col("range") + 1).alias("range"), F.explode("up").alias("key")))
    index = common.materialise(index, "index")
    whole, reps = reps, common.materialise(reps.select("sig", "rep", "first"), "classes")
    common.discard(whole)
    return profile, reps, index


_OWNER = np.dtype([("rep", "<i8"), ("n", "<i4"), ("range", "i1")])


def _index_dealt(docs: DataFrame, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same where the filter is too large to be held."""

    def place(keys: np.ndarray) -> np.ndarray:
        return _places(keys, bits).astype(np.int64)[:, None]

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        met: set[int] = set()
        for pdf in batches:
            for tokens in shingles(pdf["text"]):
                rep = _node(_signature(tokens))
                if rep in met:
                    continue
                met.add(rep)
                c, *keys = forward(tokens)
                for up, key in enumerate(keys):
                    owners = np.empty(len(key), _OWNER)
                    owners["rep"], owners["n"], owners["range"] = rep, len(tokens), c + up
                    yield key, owners

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from twice.questions(put(batches), place)
        common.trim()

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = list(shingles(pdf["text"]))
            sig = list(map(_signature, sets))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text_hash": pdf["text_hash"], "n": list(map(len, sets)), "sig": sig, "rep": list(map(_node, sig))})
        common.trim()

    parts = docs.select("text").mapInPandas(_positions(bits), twice.SCHEMA)
    segments = common.materialise(twice.merged(parts), "segments")
    found = twice.answered(docs.select("text").mapInPandas(ask, twice.QUESTION), segments, place, _OWNER, "rep long, n int, range byte")
    found = common.materialise(found, "found")
    common.discard(segments)
    # A class may have asked in several tasks.
    index = found.groupBy("rep", "range", "key").agg(F.first("n").cast("long").alias("n"))
    index = common.materialise(index.select("rep", "n", F.col("range").cast("int").alias("range"), "key"), "index")
    common.discard(found)
    profile = common.materialise(docs.mapInPandas(rows_of, "doc_id long, text_hash long, n long, sig binary, rep long"), "rows")
    reps = profile.where("n > 0").groupBy("sig").agg(F.first("rep").alias("rep"), F.min("doc_id").alias("first"))
    return profile, common.materialise(reps, "classes"), index


def _joined(docs: DataFrame) -> DataFrame:
    """doc_id (NO_ID for null), text_hash, n of each row, the node of its component
    (null for an empty set) and the component's smallest id."""
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(MIN_BITS, 1 << (size // 3).bit_length())
    profile, reps, index = (_index_here if bits <= HELD_BITS else _index_dealt)(docs, bits)

    # Classes that can have a partner at all.
    live = _rare_first(index, ["rep", "range"], *put_forward(F.col("n"), F.col("range"))).select("key", "rep")
    shared_keys = live.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    live = live.join(shared_keys, "key", "left_semi").select("rep").distinct()
    live = common.materialise(reps.select("rep", "first").join(live, "rep", "left_semi"), "live")
    common.discard(index)
    nodes, firsts = live.select("rep"), live.select("first")
    if live.count() <= BROADCAST_IDS:
        nodes, firsts = F.broadcast(nodes), F.broadcast(firsts)

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plain = list(shingles(pdf["text"]))
            tokens = [_as_long(t[np.argsort(mix(t ^ _U(_SALT_C)))]) for t in plain]
            parity = np.stack([_parity(t) for t in tokens]) if len(tokens) else np.zeros((0, PARITY), np.int64)
            yield pd.DataFrame({"rep": [_node(_signature(t)) for t in plain], "n": [len(t) for t in tokens], "tokens": tokens, **{f"s{k}": parity[:, k] for k in range(PARITY)}})
        common.trim()

    readers = docs.join(firsts, F.col("doc_id") == F.col("first"), "left_semi")
    sets = readers.mapInPandas(sets_of, "rep long, n long, tokens array<long>" + "".join(f", s{k} long" for k in range(PARITY)))
    # Rows of one id with other texts are not of a live class; repeated rows are.
    sets = common.materialise(sets.join(nodes, "rep", "left_semi"), "sets")
    if sets.count() > live.count():
        whole, sets = sets, common.materialise(sets.dropDuplicates(["rep"]), "sets")
        common.discard(whole)

    # Order B on the whole sets of those: the classical prefix.
    index = sets.select("rep", "n", F.explode("tokens").alias("key"))
    kept = _rare_first(index, ["rep"], F.col("n"), prefix(F.col("n"))).select("key", "rep", "n", "place")
    signs = [f"s{k}" for k in range(PARITY)]
    kept = common.materialise(kept.join(sets.select("rep", *signs), "rep"), "kept")

    edges: DataFrame | None = None
    labels: DataFrame | None = None
    done: DataFrame | None = None
    for turn in range(STARS + 1):
        at = kept.withColumn("comp", F.col("rep")) if labels is None else kept.join(labels, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        mixed = at.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct((F.col("place") if turn % 2 == 0 else F.lit(0)).alias("o"), F.xxhash64(F.lit(turn), "rep").alias("h"), "rep", "n", "place", "comp", *signs)).alias("hub")).where("c0 <> c1")
        if turn < STARS:  # all members with one hub
            other = mixed.select("key", F.col("hub.rep").alias("rep2"), F.col("hub.n").alias("n2"), F.col("hub.place").alias("place2"), F.col("hub.comp").alias("comp2"), *[F.col(f"hub.{c}").alias(f"{c}b") for c in signs])
        else:  # members of different components; one of them has the token early
            at = common.materialise(at.join(mixed.select("key"), "key", "left_semi"), "open")
            other = at.select("key", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("comp").alias("comp2"), *[F.col(c).alias(f"{c}b") for c in signs])
        lead = at.where(_early("n", "place")) if turn == STARS else at
        pairs = lead.join(other, "key").where((F.col("comp") != F.col("comp2")) & _compatible())
        if turn == STARS:
            pairs = pairs.where((F.col("rep") < F.col("rep2")) | ~_early("n2", "place2"))
        pairs = pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = common.materialise(pairs, "pairs")
        found = common.materialise(_verified(pairs, sets), "edges")
        done = pairs if done is None else done.unionAll(pairs)
        if edges is not None and found.isEmpty():
            continue
        edges = found if edges is None else edges.unionAll(found)
        labels = components(edges, "labels").select(F.col("node").alias("rep"), "comp")
    common.discard(live, sets, kept)
    # A component's name is its smallest doc_id.
    member = labels.unionAll(labels.select(F.col("comp").alias("rep"), "comp").distinct())
    low = member.join(reps.select("rep", "first"), "rep").groupBy("comp").agg(F.min("first").alias("component"))
    named = member.join(low, "comp").select("rep", "comp", "component")
    classes = reps.select("sig", "rep", "first").join(named, "rep", "left").select("sig", F.coalesce("comp", "rep").alias("node"), F.coalesce("component", "first").alias("component"))
    return profile.select("doc_id", "text_hash", "n", "sig").join(classes, "sig", "left").drop("sig")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest id
    (of several texts with that id, that of the smallest hash; of rows alike in id
    and text, any one).  Rows without words stay."""
    rows = common.materialise(_joined(docs).where("n > 0").groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("copies")), "rows")
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("stays"))
    judged = rows.join(first, "node").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "copies", (F.struct("doc_id", "text_hash") == F.col("stays")).alias("stays"))
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("__id"), F.xxhash64(docs["text"]) == F.col("__hash")]
    kept = docs.join(judged.where("not stays"), key, "left_anti")
    several = judged.where("stays and copies > 1")
    if several.isEmpty():
        return kept
    one = docs.join(several, key).dropDuplicates(["__id", "__hash"]).select(docs.columns)
    return kept.join(several, key, "left_anti").unionByName(one)
