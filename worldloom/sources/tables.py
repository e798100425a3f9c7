"""Parquet tables of a world and the rule for repeated deliveries.

A record may be delivered several times for one dump; the row with the greatest ``loaded_at``
per key counts.  Rows tied at that time are identical, so any of them may be taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT_KEY = ("snapshot_id", "id")
MEMBER_KEY = ("snapshot_id", "oid", "name")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: tuple[str, ...] | list[str], payload: dict[str, Column] | list[str], order: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the payload of the row with the greatest ``order``.

    The payload is evaluated before the shuffle, so hand in hashes where only equality is needed.
    A null order counts as older than any time.  Rows whose key holds nulls form keys of their own.
    """
    cols = payload if isinstance(payload, dict) else {c: F.col(c) for c in payload}
    slim = df.select(*key, F.coalesce(F.col(order).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("__at"), F.struct(*[c.alias(n) for n, c in cols.items()]).alias("__row"))
    return slim.groupBy(*key).agg(F.max_by("__row", "__at").alias("__row")).select(*key, *[F.col("__row")[n].alias(n) for n in cols])


def live_dumps(dumps: DataFrame) -> list[int]:
    """Numbers of the live dumps in order of ``taken_at``.  One row per dump: bounded by the number of checkpoints, not by their content."""
    rows = dumps.filter((F.col("world") == "live") & F.col("snapshot_id").isNotNull()).select("snapshot_id", "taken_at").distinct().orderBy(F.col("taken_at").asc_nulls_first(), "snapshot_id").collect()
    return [r.snapshot_id for r in rows]


def mirror_dump(dumps: DataFrame) -> int | None:
    """Number of the newest mirror dump."""
    rows = dumps.filter((F.col("world") == "mirror") & F.col("snapshot_id").isNotNull()).select("snapshot_id", "taken_at").distinct().orderBy(F.col("taken_at").desc_nulls_last(), F.desc("snapshot_id")).limit(1).collect()
    return rows[0].snapshot_id if rows else None
