"""Joins and numberings without a built-in form: as-of joins, range selection, dense numbers, tails and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.session import materialize


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the right row of its key that is newest at or before it.

    One sort per key over both sides together: the last right row seen is carried forward.  No pair is formed, so
    a hot key costs a sort of its rows.  Right rows tied in time go by ``take``, the greatest last.  Left rows with
    a null time or no earlier right row get nulls; null keys meet nothing.
    """
    cols = left.columns
    a = left.select(*key, F.col(left_at).alias("__t"), F.lit(1).alias("__side"), F.struct(*cols).alias("__l"), F.lit(None).cast(right.select(F.struct(*take).alias("r")).schema["r"].dataType).alias("__r"))
    b = right.filter(F.col(right_at).isNotNull()).select(*key, F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*take).alias("__r"))
    by = W.partitionBy(*key).orderBy(F.col("__t").asc_nulls_first(), "__side", "__r").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__r", ignorenulls=True).over(by))
    usable = F.lit(True)
    for k in key:
        usable = usable & F.col(k).isNotNull()
    out = both.filter("__side = 1")
    return out.select(*[F.col("__l")[c].alias(c) for c in cols], *[F.when(usable & F.col("__t").isNotNull(), F.col("__last")[c]).alias(c) for c in take])


def in_ranges(df: DataFrame, number: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows whose number lies in any of the inclusive ranges, once each; null numbers lie in none."""
    hit: Column = F.lit(False)
    for lo, hi in ranges:
        hit = hit | F.col(number).between(lo, hi)
    return df.filter(F.coalesce(hit, F.lit(False)))


def tail(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    w = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def dense_numbers(df: DataFrame, key: str, name: str = "number", start: int = 0) -> DataFrame:
    """Rows numbered without gaps in order of a unique ``key``.

    Rows are range-partitioned and sorted once; only one count per partition reaches the driver, never all rows
    one task.
    """
    spread = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    fixed = materialize(spread, "numbered")
    sizes = sorted((r["__part"], r["count"]) for r in fixed.groupBy("__part").count().collect())
    offsets, total = [], start
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    base = F.create_map(*[F.lit(x) for po in offsets for x in po])
    return fixed.withColumn(name, (F.col("__in") + base[F.col("__part")]).cast("bigint")).drop("__part", "__in")


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """One page of the ordered rows with the total number of rows and where the next page starts, null on the last."""
    total = df.agg(F.count("*").alias("total"))
    rest = F.when(F.col("total") > offset + size, offset + size)
    return df.orderBy(*order).offset(offset).limit(size).crossJoin(F.broadcast(total)).withColumn("next_offset", rest)
