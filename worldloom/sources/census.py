"""Censuses: JSON lines written block by block by a walk over a live world, resumable at any block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "object bigint, name string, owner bigint, parent bigint, location bigint, n_verbs int, n_properties int, n_children int, n_contents int, fertile boolean, player boolean"
SCHEMA = f"{ROW}, block_first bigint, block_last bigint, seq bigint"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and finished blocks of a census file; of several rows of an object the last written (``seq``) counts.

    Lines that are no JSON are left out; a block line has ``block_first`` and ``block_last``.
    """
    good = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    cols = [c.split()[0] for c in ROW.split(", ")]
    rows = good.filter("object IS NOT NULL").groupBy("object").agg(F.max_by(F.struct(*[c for c in cols if c != "object"]), F.coalesce("seq", F.lit(-1))).alias("r")).select("object", "r.*")
    return rows, good.filter("block_first IS NOT NULL").select("block_first", "block_last").distinct()


def resume_at(blocks: DataFrame, first: int) -> DataFrame:
    """One row ``next``: where a walk goes on after its last finished block."""
    return blocks.agg(F.coalesce(F.max("block_last") + 1, F.lit(first).cast("bigint")).alias("next"))


def append(rows: DataFrame, path: str) -> None:
    """Append rows or block marks."""
    rows.write.mode("append").json(path)


def rank(rows: DataFrame, fertile_only: bool = False, include_players: bool = False, min_verbs: int = 0) -> DataFrame:
    """Candidates worth reading in full: fertile first, then by verbs, children and number."""
    r = rows.filter(F.coalesce("n_verbs", F.lit(0)) >= min_verbs)
    if fertile_only:
        r = r.filter("fertile")
    if not include_players:
        r = r.filter(~F.coalesce(F.col("player"), F.lit(False)))
    return r.orderBy(F.desc(F.coalesce("fertile", F.lit(False))), F.desc("n_verbs"), F.desc("n_children"), "object")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Whole-object records of a folder of JSON files, one object a file."""
    return spark.read.option("multiLine", "true").json(path)


def incomplete(rows: DataFrame) -> DataFrame:
    """Objects whose parent was never read: a world built from these rows would miss ancestors."""
    known = rows.select(F.col("object").alias("parent"))
    return rows.filter("parent >= 0").join(known, "parent", "left_anti").select("object", "parent")
