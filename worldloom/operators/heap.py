"""Correspondence of heap instances between two dumps.

Waifs have no lasting number, so they are paired by where they are found: an instance of the older dump and one of
the newer correspond when a path from paired ground reaches both, and neither is reached together with another.
Pairs found become ground for the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worldloom.session import count_rows, materialize


def correspond(anchors_old: DataFrame, anchors_new: DataFrame, inner_old: DataFrame, inner_new: DataFrame) -> DataFrame:
    """``old_id, new_id`` of instances that correspond one to one.

    ``anchors(place, id)``: instances by the place that holds them, ``inner(src, place, dst)``: instances held by
    instances.  Each round keeps proposals whose both ends have one partner only; conflicting ends are left out
    and stay out.  The loop ends when a round finds nothing new.
    """
    first = anchors_old.select("place", F.col("id").alias("old_id")).join(anchors_new.select("place", F.col("id").alias("new_id")), "place").select("old_id", "new_id").distinct()
    proposed = materialize(first, "pairs-0")
    pairs = materialize(_bijective(proposed), "bijective-0")
    r, known = 0, count_rows(proposed)
    while True:
        r += 1
        a = inner_old.select(F.col("src").alias("old_id"), "place", F.col("dst").alias("old_dst"))
        b = inner_new.select(F.col("src").alias("new_id"), "place", F.col("dst").alias("new_dst"))
        more = pairs.join(a, "old_id").join(b, ["new_id", "place"]).select(F.col("old_dst").alias("old_id"), F.col("new_dst").alias("new_id")).distinct()
        grown = materialize(proposed.union(more).distinct(), f"pairs-{r}")
        now = count_rows(grown)
        if now == known:
            return pairs
        known, proposed, pairs = now, grown, materialize(_bijective(grown), f"bijective-{r}")


def _bijective(p: DataFrame) -> DataFrame:
    one_old = p.groupBy("old_id").agg(F.count("*").alias("n")).filter("n = 1").select("old_id")
    one_new = p.groupBy("new_id").agg(F.count("*").alias("n")).filter("n = 1").select("new_id")
    return p.join(one_old, "old_id", "left_semi").join(one_new, "new_id", "left_semi").select("old_id", "new_id")
