"""What changed between consecutive full snapshots, and validity periods of attributes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.functions.values import code_hash, value_hash
from worldloom.sources.tables import latest


def _dump_index(dumps: list[int]):
    """Position of a dump among the ordered dumps, as a literal map; one entry per dump."""
    return F.create_map(*[F.lit(x) for i, s in enumerate(dumps) for x in (s, i)])[F.col("snapshot_id")]


def snapshot_changes(records: DataFrame, key: list[str], hash_col: str, dumps: list[int]) -> DataFrame:
    """Added, removed and changed records between consecutive dumps.

    ``records`` holds at most one row per dump and key.  Each key is windowed by dump position: ``lag`` of the
    hash reveals changes, gaps in the position reveal removals and returns.  Columns: ``*key, snapshot_id,
    change_type``; ``snapshot_id`` is the later dump.  Dumps not in ``dumps`` are ignored, null hashes equal each
    other only, null keys pair with null keys, and with fewer than two dumps the result is empty.
    """
    last = len(dumps) - 1
    if last < 1:
        return records.select(*key, "snapshot_id", F.lit("").alias("change_type")).limit(0)
    ix = records.filter(F.col("snapshot_id").isin(dumps)).select(*key, _dump_index(dumps).alias("__i"), F.col(hash_col).alias("__h"))
    w = W.partitionBy(*key).orderBy("__i")
    seen = ix.withColumns({"__p": F.lag("__i").over(w), "__ph": F.lag("__h").over(w), "__n": F.lead("__i").over(w)})
    arrived = (F.col("__i") > 0) & (F.col("__p").isNull() | (F.col("__p") < F.col("__i") - 1))
    changed = (F.col("__p") == F.col("__i") - 1) & ~F.col("__h").eqNullSafe(F.col("__ph"))
    gone = (F.col("__i") < last) & (F.col("__n").isNull() | (F.col("__n") > F.col("__i") + 1))
    events = F.array_compact(
        F.array(
            F.when(arrived, F.struct(F.col("__i").alias("i"), F.lit("added").alias("t"))),
            F.when(changed, F.struct(F.col("__i").alias("i"), F.lit("changed").alias("t"))),
            F.when(gone, F.struct((F.col("__i") + 1).alias("i"), F.lit("removed").alias("t"))),
        )
    )
    at = F.element_at(F.array(*[F.lit(s) for s in dumps]), F.col("e.i") + 1)
    return seen.filter(arrived | changed | gone).select(*key, F.explode(events).alias("e")).select(*key, at.alias("snapshot_id"), F.col("e.t").alias("change_type"))


def member_changes(properties: DataFrame, verbs: DataFrame, dumps: list[int]) -> DataFrame:
    """Changes of properties (typed value) and verbs (exact code) over consecutive dumps.

    Columns ``kind, snapshot_id, oid, name, change_type``.  Only hashes of values and programs are shuffled, and
    only once: all deliveries of a record are brought together by kind, object and name, where both the newest
    delivery per dump and the window over the dumps find them.
    """

    def slim(df: DataFrame, kind: str, h) -> DataFrame:
        at = F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
        return df.filter(F.col("snapshot_id").isin(dumps)).select(F.lit(kind).alias("kind"), "snapshot_id", "oid", "name", at.alias("at"), h.alias("h"))

    key = ["kind", "oid", "name"]
    every = slim(properties, "property", value_hash("value_json")).unionByName(slim(verbs, "verb", code_hash("code"))).repartition(*key)
    newest = every.groupBy(*key, "snapshot_id").agg(F.max_by(F.struct("h"), "at").alias("r")).select(*key, "snapshot_id", F.col("r.h").alias("h"))
    out = snapshot_changes(newest, key, "h", dumps)
    return out.select("kind", "snapshot_id", "oid", "name", "change_type")


def _merge_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the co-partitioned, key-sorted dumps and close a version when the payload changes or a dump is missing.

    Rows arrive sorted by key, dump position and newest delivery first.  Only the open version is carried from
    batch to batch; nothing of a history is held back.
    """
    schema = pa.schema([("key", pa.int64()), ("key_null", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])
    open_: tuple | None = None  # key, null key, first, last, hash, hash
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        null = np.asarray(b.column(0).is_null().to_numpy(zero_copy_only=False))
        key = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        pos, h1, h2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        if open_ is not None:  # the open version goes in front as its last row
            k, kn, first, last, a, c = open_
            key, null, pos = np.r_[k, key], np.r_[kn, null], np.r_[last, pos]
            h1, h2 = np.r_[a, h1], np.r_[c, h2]
        same_key = (key[1:] == key[:-1]) & (null[1:] == null[:-1])
        repeat = np.r_[False, same_key & (pos[1:] == pos[:-1])]
        key, null, pos, h1, h2 = (x[~repeat] for x in (key, null, pos, h1, h2))
        same_key = (key[1:] == key[:-1]) & (null[1:] == null[:-1])
        goes_on = same_key & (pos[1:] == pos[:-1] + 1) & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        starts = np.flatnonzero(np.r_[True, ~goes_on])
        ends = np.r_[starts[1:] - 1, len(key) - 1]
        firsts = pos[starts].astype(np.int32)
        if open_ is not None:
            firsts[0] = open_[2]
        z = ends[-1]
        open_ = (key[z], bool(null[z]), int(firsts[-1]), int(pos[z]), h1[z], h2[z])
        if len(starts) > 1:
            e, f = ends[:-1], firsts[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[e]), pa.array(null[e]), pa.array(f, pa.int32()), pa.array(pos[e].astype(np.int32))], schema=schema)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_[0]], pa.int64()), pa.array([open_[1]]), pa.array([open_[2]], pa.int32()), pa.array([open_[3]], pa.int32())], schema=schema)


def attribute_versions(objects: DataFrame, dumps: list[int], attributes: tuple[str, ...] = ("name", "owner", "location", "parents"), key: str = "id", with_values: bool = False) -> DataFrame:
    """Validity periods: one row per longest run of consecutive dumps in which the attributes stay the same.

    Columns ``key, first_snapshot_id, last_snapshot_id``; with ``with_values`` also the attributes.  Dumps are
    co-partitioned by key and sorted by key and time; each partition is merged as a stream.  Superseded and
    repeated deliveries are skipped in the same pass.  Null equals null; null and empty lists are the same; an
    absence closes a version.  Empty input or no dumps give no rows.
    """
    if not dumps:
        return objects.select(F.col(key), F.lit(0).alias("first_snapshot_id"), F.lit(0).alias("last_snapshot_id")).limit(0)
    types = dict(objects.dtypes)
    # Null elements are spelled apart: a hash of an array skips nulls.
    parts = [F.transform(F.coalesce(F.col(a), F.array().cast(types[a])), lambda x: F.coalesce(x.cast("string"), F.lit("~"))) if types[a].startswith("array") else F.col(a) for a in attributes]
    nulls = F.concat(*[F.when(F.col(a).isNull() & F.lit(not types[a].startswith("array")), "1").otherwise("0") for a in attributes])
    sizes = [F.size(F.coalesce(F.col(a), F.array().cast(types[a]))) for a in attributes if types[a].startswith("array")]
    slim = objects.filter(F.col("snapshot_id").isin(dumps)).select(
        F.col(key).cast("bigint").alias("key"), _dump_index(dumps).alias("pos"), F.xxhash64(nulls, *sizes, *parts).alias("h1"), F.xxhash64(F.lit(97), nulls, *sizes, *parts).alias("h2"), "loaded_at"
    )
    sorted_ = slim.repartition("key").sortWithinPartitions("key", "pos", F.col("loaded_at").desc_nulls_last()).drop("loaded_at")
    runs = sorted_.mapInArrow(_merge_versions, "key bigint, key_null boolean, first int, last int")
    at = F.array(*[F.lit(s) for s in dumps])
    out = runs.select(F.when(~F.col("key_null"), F.col("key")).alias(key), F.element_at(at, F.col("first") + 1).alias("first_snapshot_id"), F.element_at(at, F.col("last") + 1).alias("last_snapshot_id"))
    if not with_values:
        return out
    values = latest(objects.filter(F.col("snapshot_id").isin(dumps)), ("snapshot_id", key), list(attributes)).withColumnsRenamed({"snapshot_id": "__s", key: "__k"})
    return out.join(values, (F.col("first_snapshot_id") == F.col("__s")) & F.col(key).eqNullSafe(F.col("__k")), "left").drop("__s", "__k")
