"""Structured Streaming forms: census files and dump deliveries that arrive over time.

Each micro-batch runs the batch operators; state is kept in tables, so a restarted stream goes on where its
checkpoint says, and a batch that runs twice writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worldloom.functions.values import value_hash
from worldloom.sources import census


def census_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of census files as they appear in a folder."""
    return spark.readStream.schema(census.SCHEMA).option("maxFilesPerTrigger", 100).json(folder).filter("object IS NOT NULL")


def activity(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per window and type; rows later than ``late`` are left out, windows close when they are past."""
    e = events.filter("ts IS NOT NULL").withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_deliveries(properties: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest delivery of every property hash while deliveries stream in.

    Each batch is merged with the version the batch before wrote and writes the next one, so a batch that runs again
    writes the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slim = batch.select("snapshot_id", "oid", "name", value_hash("value_json").alias("h"), "loaded_at")
        before = _current(spark, path, number)
        every = slim if before is None else slim.unionByName(before)
        newest = every.groupBy("snapshot_id", "oid", "name").agg(F.max_by(F.struct("h", "loaded_at"), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp"))).alias("r"))
        newest.select("snapshot_id", "oid", "name", "r.h", "r.loaded_at").write.mode("overwrite").parquet(f"{path}/version={number}")

    return properties.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The table as the batch before left it."""
    if before == 0:
        return None
    return spark.read.parquet(f"{path}/version={before - 1}")


def current(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The table after batch ``version``."""
    return spark.read.parquet(f"{path}/version={version}")
