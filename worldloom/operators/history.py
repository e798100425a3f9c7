"""Timelines over the chain of dumps: pairs, as-of resolution, presence of a target, and timelines of one record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from worldloom.functions.values import canonical
from worldloom.session import exists
from worldloom.sources.tables import MEMBER_KEY, latest


def chain_pairs(dumps: DataFrame) -> DataFrame:
    """Consecutive live dumps: ``old_id, new_id, hours``.  One row per dump, so one window holds them all."""
    by = W.orderBy("taken_at", "snapshot_id")
    d = dumps.filter("world = 'live'").select(F.lag("snapshot_id").over(by).alias("old_id"), F.col("snapshot_id").alias("new_id"), ((F.unix_timestamp("taken_at") - F.unix_timestamp(F.lag("taken_at").over(by))) / 3600).cast("bigint").alias("hours"))
    return d.filter("old_id IS NOT NULL")


def dump_at(rows: DataFrame, at: str, dumps: DataFrame) -> DataFrame:
    """``rows`` with ``snapshot_id``: the newest live dump taken at or before the time ``at``, null before the first.

    The dumps, one row each, travel as one literal array.
    """
    known = [(r.taken_at, r.snapshot_id) for r in dumps.filter("world = 'live' AND taken_at IS NOT NULL").orderBy("taken_at", "snapshot_id").collect()]
    if not known:
        return rows.withColumn("snapshot_id", F.lit(None).cast("int"))
    all_ = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in known])
    return rows.withColumn("snapshot_id", F.array_max(F.filter(all_, lambda d: d["t"] <= F.col(at)))["s"])


def presence(properties: DataFrame, dumps: list[int], target: int) -> DataFrame:
    """When a target object appears in or disappears from a property's value: ``oid, name, snapshot_id, transition``.

    Canonical spellings make a reference to the target a fixed text that cannot occur inside a string.
    """
    mark = f'{{"type":"obj","value":"{target}"}}'
    has = F.coalesce(F.contains(canonical("value_json"), F.lit(mark)), F.lit(False))
    p = latest(properties.filter(F.col("snapshot_id").isin(dumps)), MEMBER_KEY, {"has": has}).filter("has").select("oid", "name", "snapshot_id")
    if not dumps:
        return p.select("oid", "name", "snapshot_id", F.lit("").alias("transition")).limit(0)
    at = F.create_map(*[F.lit(x) for i, s in enumerate(dumps) for x in (s, i)])[F.col("snapshot_id")]
    by = W.partitionBy("oid", "name").orderBy("i")
    s = p.withColumn("i", at).withColumns({"before": F.lag("i").over(by), "after": F.lead("i").over(by)})
    came = (F.col("i") > 0) & (F.col("before").isNull() | (F.col("before") < F.col("i") - 1))
    went = (F.col("i") < len(dumps) - 1) & (F.col("after").isNull() | (F.col("after") > F.col("i") + 1))
    ids = F.array(*[F.lit(x) for x in dumps])
    ev = F.array_compact(F.array(F.when(came, F.struct(F.col("i").alias("i"), F.lit("appeared").alias("t"))), F.when(went, F.struct((F.col("i") + 1).alias("i"), F.lit("disappeared").alias("t")))))
    return s.select("oid", "name", F.explode(ev).alias("e")).select("oid", "name", F.element_at(ids, F.col("e.i") + 1).alias("snapshot_id"), F.col("e.t").alias("transition"))


def build(spark, sf_dir: str, path: str, keep_going: bool = False) -> list[tuple[int, int]]:
    """Write the object, property and verb events of every pair of consecutive live dumps below ``path``, one folder per pair.

    Pairs already written are left as they are, so a stopped build goes on where it was.  With ``keep_going`` a pair
    that fails is left out, a gap, and the others are built.  Returns the pairs written.
    """
    from worldloom.operators.compare import object_events, value_events, verb_pairs
    from worldloom.operators.inspect import open_world
    from worldloom.sources.tables import live_dumps, table

    dumps = live_dumps(table(spark, sf_dir, "moo_dumps"))
    wrote = []
    for i in range(1, len(dumps)):
        folder = f"{path}/pair={i}"
        if exists(spark, f"{folder}/_SUCCESS"):
            continue
        try:
            a, b = open_world(spark, sf_dir, len(dumps) - i), open_world(spark, sf_dir, len(dumps) - 1 - i)
            o = object_events(a, b).select(F.lit("object").alias("kind"), "oid", F.col("field").alias("name"), "change")
            p = value_events(a, b).select(F.lit("property").alias("kind"), "oid", "name", "change")
            v = verb_pairs(a, b).select(F.lit("verb").alias("kind"), "oid", "name", "change")
            o.unionByName(p).unionByName(v).withColumns({"old_id": F.lit(dumps[i - 1]), "new_id": F.lit(dumps[i])}).write.mode("overwrite").parquet(folder)
        except Exception:
            if not keep_going:
                raise
            continue
        wrote.append((dumps[i - 1], dumps[i]))
    return wrote


def gaps(spark, dumps: list[int], path: str) -> list[tuple[int, int]]:
    """Pairs of consecutive dumps that a history lacks: what happened between them is not known."""
    return [(dumps[i - 1], dumps[i]) for i in range(1, len(dumps)) if not exists(spark, f"{path}/pair={i}/_SUCCESS")]


def events(spark, path: str, kind: str | None = None, oid: int | None = None, changes: list[str] | None = None, name_prefix: str = "") -> DataFrame:
    """Events of a built history in order of pairs; filters reach the scan."""
    e = spark.read.parquet(path).filter(F.startswith(F.coalesce("name", F.lit("")), F.lit(name_prefix)))
    if kind:
        e = e.filter(F.col("kind") == kind)
    if changes is not None:
        e = e.filter(F.col("change").isin(changes))
    return e.filter(F.col("oid") == oid) if oid is not None else e


def event_page(found: DataFrame, offset: int, size: int) -> DataFrame:
    """One page of events in order of pair, kind, object and name, with the total and where the next page starts."""
    from worldloom.operators.joins import page

    return page(found, ["pair", "kind", "oid", "name", "change"], offset, size)


def rendered(found: DataFrame) -> DataFrame:
    """``pair, text``: a pair's events as lines, one section a pair; a pair's text is as long as its events."""
    line = F.format_string("- %s #%d%s: %s", "kind", "oid", F.when(F.coalesce("name", F.lit("")) == "", "").otherwise(F.concat(F.lit("."), F.col("name"))), "change")
    per = found.select("pair", "old_id", "new_id", F.struct("kind", "oid", "name", "change").alias("k"), line.alias("line"))
    by = per.groupBy("pair", "old_id", "new_id").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    return by.select("pair", F.array_join(F.concat(F.array(F.format_string("## %d to %d", "old_id", "new_id")), F.col("l.line")), "\n").alias("text"))


def continuous(spark, path: str) -> bool:
    """Whether every pair's older dump is the pair's before it: one row per pair is compared."""
    p = spark.read.parquet(path).groupBy("pair").agg(F.min("old_id").alias("old_id"), F.max("new_id").alias("new_id"), (F.count_distinct("old_id", "new_id") == 1).alias("one"))
    by = W.orderBy("pair")
    bad = p.withColumn("before", F.lag("new_id").over(by)).filter("NOT one OR (before IS NOT NULL AND before <> old_id)")
    return bad.isEmpty()
