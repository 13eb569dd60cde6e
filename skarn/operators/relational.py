"""Operators that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key on one side of a dealt join that are not cut in pieces.
PIECE_ROWS = 10_000
#: Copies of a right row that an interval join repeats at once.
REPEATS = 1024


def int_div(a: Column, b: Column) -> Column:
    """Truncating integer division; null for a zero divisor."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return F.try_mod(a, b).cast("long")


def total(c: Column) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))


def with_rowid(df: DataFrame, order: list[str], name: str = "_rowid") -> DataFrame:
    """Dense row numbers from 1 in a global order, without one-task sorting: rows
    are range-partitioned and sorted, numbered in their partition, and shifted by
    the sizes of the partitions before (one small row for each)."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("__p").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    numbered = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return numbered.join(F.broadcast(shift), F.col("__p") == F.col("__of")).withColumn(name, F.col("__shift") + F.col("__r")).drop("__p", "__of", "__shift", "__r")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], ties: list[str] = (), bucket: str | None = None) -> DataFrame:
    """left with `values` of the latest right row of the same key at an earlier
    time (the largest by `ties` at one time): both sides are merged and the last
    value is carried along each key.

    With `bucket` (SQL over the time column that grows with it, such as
    date_trunc('day', ts)) a key is sorted in one task for each bucket; the last
    value before a bucket comes from one row for each bucket of the key."""
    cols = left.columns
    a = left.select("*", F.lit(1).alias("__left"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    b = right.select(*[F.col(c) if c in (key, time) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.lit(0).alias("__left"), *values)
    merged = a.unionByName(b).withColumn("__bucket", F.expr(bucket) if bucket else F.lit(0))
    # Left rows come first among equal times: only earlier right rows count.
    order = Window.partitionBy(key, "__bucket").orderBy(F.col(time), F.desc("__left"), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right_row = F.when(F.col("__left") == 0, F.struct(*values))
    out = merged.withColumn("__match", F.last(right_row, ignorenulls=True).over(order)).where("__left = 1")
    if bucket:
        ends = merged.where("__left = 0").groupBy(key, "__bucket").agg(F.max_by(F.struct(*values), F.struct(time, *ties)).alias("__end"))
        held = merged.select(key, "__bucket").distinct().join(ends, [key, "__bucket"], "left")
        before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        held = held.select(F.col(key).alias("__k"), F.col("__bucket").alias("__b"), F.last("__end", ignorenulls=True).over(before).alias("__before"))
        out = out.join(held, F.col(key).eqNullSafe(F.col("__k")) & F.col("__bucket").eqNullSafe(F.col("__b")), "left").withColumn("__match", F.coalesce("__match", "__before"))
    return out.select(*cols, *[F.col(f"__match.{v}").alias(v) for v in values])


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner equality join for few or hot keys, whose pairs outgrow the rows.
    A key of more than PIECE_ROWS rows on a side is cut there in pieces of about
    that size, and each piece of one side meets each of the other in its own part
    of a merge join.  Both sides are shuffled to all shuffle partitions: neither
    the split of the input nor the size of the rows says how much work they are."""
    sizes = [df.groupBy(*keys).agg(F.count("*").alias(f"__n{side}")) for df, side in ((left, "l"), (right, "r"))]
    # At most one row for PIECE_ROWS rows of the sides.
    hot = sizes[0].join(sizes[1], keys).where(F.greatest("__nl", "__nr") > PIECE_ROWS)
    hot = F.broadcast(hot.select(*keys, *[F.ceil(F.col(f"__n{side}") / PIECE_ROWS).cast("int").alias(f"__p{side}") for side in "lr"]))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = []
    for df, own, other in ((left, "l", "r"), (right, "r", "l")):
        piece = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"__p{own}", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"__p{other}", F.lit(1)) - 1))
        df = df.join(hot, keys, "left").withColumn(f"__s{own}", piece).withColumn(f"__s{other}", every).drop("__pl", "__pr")
        dealt.append(df.repartition(parts, *keys, "__sl", "__sr"))
    return dealt[0].join(dealt[1].hint("merge"), [*keys, "__sl", "__sr"]).drop("__sl", "__sr")


def interval_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, on: list[str] = ()) -> DataFrame:
    """Pairs of a left row and a right row whose interval [low, high] holds the
    left row's point, and which agree in `on`.  Intervals are dealt to the bins of
    `width` they touch, a point to its one bin: an equality join.  Equal right
    rows are joined once and repeated at the end, one after the other, where a
    file holds them as one run."""
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    a = left.withColumn("__bin", at(point))
    b = right.where(F.col(low) <= F.col(high)).groupBy(*right.columns).agg(F.count("*").alias("__n"))
    # No more than REPEATS at once, so that no array is large.
    chunks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(REPEATS).cast("long")), lambda i: F.least(F.lit(REPEATS), F.col("__n") - i).cast("int"))
    b = b.withColumn("__n", F.explode(chunks)).withColumn("__bin", F.explode(F.sequence(at(low), at(high))))
    pairs = dealt_join(a, b, [*on, "__bin"]).where(F.col(point).between(F.col(low), F.col(high)))
    return pairs.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__bin", "__n")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equality join in which the left rows of each key are spread over
    `salts` tasks and the right rows repeated for each: for hot keys on the left,
    where adaptive skew handling is not to be relied on.  Both sides are shuffled
    and merged: Spark's size of the right side leaves out the repeats, and would
    have it broadcast `salts` times larger than it thinks."""
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a salted join keeps left rows: inner, left, left_semi or left_anti")
    return a.join(b.hint("merge"), [key, "__salt"], how).drop("__salt")
