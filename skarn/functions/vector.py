"""Vector functions as column expressions, which stay in the JVM, and the kNN
join, which computes blocks of distances in numpy."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries, which is broadcast.
BLOCK_ROWS = 20_000
#: Pairs of a task, as long as there are fewer tasks than shuffle partitions.
TASK_PAIRS = 20_000_000


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _same_size(a: Column, b: Column, value: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("vector dimensions differ: "), F.size(a), F.lit(" and "), F.size(b)))
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(bad.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, v: s + v * v))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; an error if the dimensions differ, null for null."""
    squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return _same_size(a, b, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0.0 if either vector is zero."""
    length = norm(a) * norm(b)
    return _same_size(a, b, F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def top_k(df: DataFrame, vector: str, query, k: int, key: str, metric: str = "l2") -> DataFrame:
    """The k rows nearest to one query vector (a list, or a column)."""
    q = query if isinstance(query, Column) else literal(query)
    if metric == "l2":
        return df.withColumn("distance", l2_distance(F.col(vector), q)).orderBy("distance", key).limit(k)
    return df.withColumn("similarity", cosine_similarity(F.col(vector), q)).orderBy(F.desc("similarity"), key).limit(k)


def knn_join(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query_key, neighbour_key, distance, rank: the k nearest rows of a stated
    query set, itself excluded; ties go to the smaller key, unknown distances
    come last.  Queries go in blocks of about BLOCK_ROWS, each sent to all tasks
    over the rows.  A task bounds distances by a matrix product, computes those
    within the bounds in order of dimensions (so as l2_distance does) and hands
    on k rows a query."""
    spark = rows.sparkSession
    kind, array = rows.schema[key].dataType, "array<double>"
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query_key"), F.col(key).cast(kind).alias("__same"), F.col(vector).cast(array).alias("__q"))
    name = queries.schema[key].dataType.simpleString()
    count = q.count()
    blocks = -(-count // BLOCK_ROWS) or 1
    # Tasks by the number of pairs: rows of a single file are one task otherwise.
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = min(most, 1 + rows.count() * count // TASK_PAIRS)
    # Within a task rows come by key, so the earlier of two ties is the smaller key.
    r = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("neighbour_key"), F.col(vector).cast(array).alias("__v"))
    r = r.repartition(parts, "neighbour_key").sortWithinPartitions("neighbour_key")
    schema = f"query_key {name}, neighbour_key {kind.simpleString()}, distance double"
    number = F.pmod(F.xxhash64("query_key"), F.lit(blocks))
    found = []
    for i in range(blocks):
        sent = spark.sparkContext.broadcast((q if blocks == 1 else q.where(number == i)).toArrow())
        found.append(r.mapInArrow(_nearest(sent, k), schema))
    order = Window.partitionBy("query_key").orderBy(F.asc_nulls_last("distance"), "neighbour_key")
    return reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix (NaN where unknown), their sizes (-1 for null
    vectors) and whether they are null or hold a null."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    flat = v.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    holes = np.zeros(len(size), bool)
    holes[np.repeat(np.arange(len(size)), np.maximum(size, 0))[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    out = np.full((len(size), max(int(size.max(initial=0)), 0)), np.nan)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out, size, holes | (size < 0)


def _nearest(sent, k: int):
    """The k nearest rows of each query among the batches of one task."""

    def run(batches):
        table = sent.value
        qkeys, same = table["query_key"].combine_chunks(), table["__same"].combine_chunks()
        unique = pc.unique(same)
        code = pc.index_in(same, value_set=unique).to_numpy(zero_copy_only=False)
        q, qsize, qnull = _matrix(table["__q"])
        m = len(q)
        # Of each query the best so far: class (1: unknown), distance, place in the task.
        kept = np.empty(0, [("q", "i8"), ("c", "i1"), ("d", "f8"), ("s", "f8"), ("at", "i8")])
        keys, start = [], 0
        for batch in batches:
            if not (m and len(batch)):
                continue
            x, xsize, xnull = _matrix(batch["__v"])
            for have in np.unique(xsize[xsize >= 0]):
                bad = np.unique(qsize[(qsize >= 0) & (qsize != have)])
                if len(bad):
                    raise ValueError(f"vector dimensions differ: {have} and {bad[0]}")
            mine = pc.fill_null(pc.index_in(batch["neighbour_key"], value_set=unique), -1).to_numpy(zero_copy_only=False)
            keys.append(batch["neighbour_key"])
            dims = max(x.shape[1], q.shape[1])
            if x.shape[1] != q.shape[1]:  # one side has no vector that is known
                x, qq = (np.full((len(a), dims), np.nan) if a.shape[1] != dims else a for a in (x, q))
            else:
                qq = q
            step, merged = max(1, (1 << 21) // len(x)), []
            for a in range(0, m, step):
                part = kept[np.searchsorted(kept["q"], a) : np.searchsorted(kept["q"], a + step)]
                merged.append(_merge(part, x, xnull, mine, qq[a : a + step], qnull[a : a + step], code[a : a + step], a, start, k))
            kept = np.concatenate(merged)
            start += len(x)
        if len(kept):
            every = pa.chunked_array(keys)
            distance = pa.array(kept["d"], mask=kept["c"] == 1)
            out = pa.table({"query_key": qkeys.take(pa.array(kept["q"])), "neighbour_key": every.take(pa.array(kept["at"])), "distance": distance})
            yield from out.combine_chunks().to_batches()

    return run


def _merge(kept, x, xnull, mine, q, qnull, code, first, start, k):
    """The best k of each query of a block, from those kept and a batch of rows."""
    m, slack = len(q), 8 * (x.shape[1] + 8) * np.finfo(float).eps
    count = np.bincount(kept["q"] - first, minlength=m)
    last = np.cumsum(count) - 1
    top = np.full(m, np.inf)
    full = count == k
    if full.any():
        worst = kept[last[full]]
        top[full] = np.where((worst["c"] == 0) & np.isfinite(worst["s"]), worst["s"] * (1 + 8 * np.finfo(float).eps), np.inf)
    with np.errstate(all="ignore"):
        known_x, known_q = np.isfinite(x).all(1) & ~xnull, np.isfinite(q).all(1) & ~qnull
        nx, nq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
        # Not a number: always computed.  Infinite: only while anything counts.
        nx = np.where(known_x, np.where(nx < 1e300, nx, np.nan), np.inf)
        nq = np.where(known_q, np.where(nq < 1e300, nq, np.nan), np.where(qnull, 0.0, np.nan))
        top[qnull & full] = -np.inf
        low = np.where(known_q[:, None], q, 0.0) @ np.where(known_x[:, None], x, 0.0).T
        low *= -2
        low += (nx * (1 - slack))[None, :]
        low += (nq * (1 - slack))[:, None]
        own = np.nonzero(mine >= 0)[0]
        hit = [(np.nonzero(code == mine[j])[0], j) for j in own]
        for i, j in hit:
            low[i, j] = np.inf
        open_ = np.nonzero(((low <= top[:, None]).sum(1) > 8 * k) & ~qnull)[0]
        if len(open_) and len(x) > k:
            nearest = np.partition(low[open_], k - 1, axis=1)[:, k - 1]
            widest = nx[np.isfinite(nx)].max(initial=0.0)
            bound = nearest + 2 * slack * (nq[open_] + widest)
            top[open_] = np.fmin(top[open_], bound * (1 + slack))
        mask = ~(low > top[:, None])
        if (wide := np.nonzero(qnull & ~full)[0]).size:
            # All distances of such a query are unknown: its first rows will do.
            mask[wide] &= np.cumsum(mask[wide], axis=1) <= k + len(own)
        for i, j in hit:
            mask[i, j] = False
        qi, xi = np.nonzero(mask)
        squares = np.zeros(len(qi))
        for a in range(0, len(qi), 100_000):
            u, v = x[xi[a : a + 100_000]], q[qi[a : a + 100_000]]
            d = np.ascontiguousarray((u - v).T)
            d *= d
            for row in d:
                squares[a : a + 100_000] += row
    new = np.empty(len(qi), kept.dtype)
    new["q"], new["c"], new["s"], new["at"] = qi + first, xnull[xi] | qnull[qi], squares, xi + start
    new["d"] = np.sqrt(squares)
    new["d"][new["c"] == 1] = 0.0
    every = np.concatenate([kept, new])
    every = every[np.lexsort((every["at"], every["d"], every["c"], every["q"]))]
    begin = np.searchsorted(every["q"], every["q"])
    return every[np.arange(len(every)) - begin < k]


#: SQL forms, which the dialect expands in place (so that they can stand in
#: ORDER BY, where Spark takes no SQL functions).
SQL_FUNCTIONS = {
    "l2_distance": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) = size(b) THEN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)) ELSE CAST(raise_error('vector dimensions differ') AS DOUBLE) END",
    "cosine_similarity": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN size(a) <> size(b) THEN CAST(raise_error('vector dimensions differ') AS DOUBLE) WHEN aggregate(a, 0D, (s, v) -> s + v * v) = 0 OR aggregate(b, 0D, (s, v) -> s + v * v) = 0 THEN 0D ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / (sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v))) END",
}
ALIASES = {"vector_l2_distance": "l2_distance", "vector_cosine_similarity": "cosine_similarity"}
