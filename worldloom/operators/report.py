"""Reports of events: ids, canonical order, byte spans, bundles on disk, and reading them back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.operators.inspect import World


def identified(events: DataFrame, identity: list[str]) -> DataFrame:
    """Events with ``occurrence`` among equal identities and ``event_id``, the digest of identity and occurrence.

    The digested text joins the identity's parts with a separator that cannot occur in escaped parts, so ids are
    the same in every run and order of rows.
    """
    rest = [c for c in events.columns if c not in identity]
    occ = F.row_number().over(W.partitionBy(*identity).orderBy(*rest) if rest else W.partitionBy(*identity).orderBy(F.lit(1))) - 1
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("||"))), F.lit("~"))
    e = events.withColumn("occurrence", occ)
    return e.withColumn("event_id", F.sha2(F.concat_ws(" | ", *[part(c) for c in identity], F.col("occurrence").cast("string")), 256))


def spans(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Event lines as JSON with their byte span in the group's file: ``line, start, size``."""
    cols = [c for c in events.columns]
    line = events.withColumn("line", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    size = F.octet_length("line") + 1
    by = W.partitionBy(group).orderBy(*order)
    return line.withColumn("size", size.cast("bigint")).withColumn("start", F.sum("size").over(by) - F.col("size"))


def externalized(events: DataFrame, text: str, longest: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Long texts moved out under their digest: the events with ``{text}_digest``, and distinct payloads."""
    digest = F.sha2(F.col(text), 256)
    far = F.length(text) > longest
    payloads = events.filter(far).select(digest.alias("digest"), F.col(text).alias("payload")).dropDuplicates(["digest"])
    return events.withColumn(f"{text}_digest", F.when(far, digest)).withColumn(text, F.when(~F.coalesce(far, F.lit(False)), F.col(text))), payloads


def write_bundle(events: DataFrame, path: str, identity: list[str], partition: str | None = None) -> dict[str, int]:
    """Write a bundle: ordered events, and a manifest with counts and a digest over all event ids."""
    e = identified(events, identity)
    w = e.sortWithinPartitions(*identity, "occurrence").write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(f"{path}/events")
    back = events.sparkSession.read.parquet(f"{path}/events")
    sums = _sums(back)
    sums.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return sums.collect()[0].asDict()


def _sums(e: DataFrame) -> DataFrame:
    """Counts of a bundle and an order-free digest of its ids."""
    return e.agg(F.count("*").alias("n_events"), F.count_distinct("event_id").alias("n_ids"), F.coalesce(F.bit_xor(F.xxhash64("event_id")), F.lit(0)).alias("digest"))


def read_bundle(spark: SparkSession, path: str, identity: list[str]) -> DataFrame:
    """The events of a bundle after checking it: counts, digest, unique ids, and every id against its event."""
    e = spark.read.parquet(f"{path}/events")
    want = spark.read.json(f"{path}/manifest").collect()[0].asDict()
    got = _sums(e).collect()[0].asDict()
    again = identified(e.drop("occurrence", "event_id"), identity).select("event_id")
    if got != want or got["n_ids"] != got["n_events"] or not e.select("event_id").exceptAll(again).isEmpty():
        raise ValueError("the bundle differs from its manifest")
    return e


def _unified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from difflib import unified_diff

    for b in batches:
        out = []
        for oid, name, before, after in zip(b["oid"], b["name"], b["before"], b["after"]):
            old, new = ([] if x is None else [y or "" for y in x] for x in (before, after))
            lines = list(unified_diff(old, new, "before", "after", lineterm="", n=3))
            body = [x for x in lines if not x.startswith(("---", "+++", "@@"))]
            out.append((oid, name, "\n".join(lines), sum(x[:1] == "+" for x in body), sum(x[:1] == "-" for x in body)))
        yield pd.DataFrame(out, columns=["oid", "name", "diff", "n_added", "n_removed"])


def source_diffs(old: World, new: World) -> DataFrame:
    """Unified diffs of changed programs: ``oid, name, diff, n_added, n_removed``; new and lost verbs diff against nothing."""
    a = old.verbs.select("oid", "name", F.col("code").alias("before"))
    b = new.verbs.select("oid", "name", F.col("code").alias("after"))
    changed = a.join(b, ["oid", "name"], "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    return changed.mapInPandas(_unified, "oid bigint, name string, diff string, n_added int, n_removed int")


def markdown(diffs: DataFrame) -> DataFrame:
    """One Markdown page per object with its programs' diffs, by verb name."""
    part = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n```diff\n"), F.col("diff"), F.lit("\n```\n"))
    return diffs.groupBy("oid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("t")))), lambda x: x["t"]), "\n").alias("page"))
