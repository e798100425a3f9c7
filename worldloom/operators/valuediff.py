"""Differences inside typed values, node by node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worldloom.functions.values import close, double_of_bits, value_hash
from worldloom.operators.inspect import World, value_nodes
from worldloom.session import materialize


def changed_only(old: World, new: World) -> tuple[World, World]:
    """Both worlds with just the properties whose typed value differs; equal values never reach the walk."""
    p = lambda w: w.properties.select("oid", "name", F.struct(value_hash("value_json").alias("h")).alias("v"))
    keys = p(old).withColumnRenamed("v", "a").join(p(new).withColumnRenamed("v", "b"), ["oid", "name"]).filter(~F.col("a").eqNullSafe(F.col("b"))).select("oid", "name")
    cut = lambda w: World(w.objects, w.properties.join(keys, ["oid", "name"], "left_semi"), w.verbs, w.waifs)
    return cut(old), cut(new)


def _by_key(nodes: DataFrame) -> DataFrame:
    """Nodes with their map steps named by key, ``map:tag:content:value``, in place of the entry's position.

    Keys are told apart as the server does, strings in any case.  Entries whose key is no scalar keep their position.
    """
    key = F.concat_ws(":", "tag", F.lower("scalar"))
    keys = nodes.filter(F.col("path").rlike(":key$") & F.col("scalar").isNotNull()).select("oid", "name", F.regexp_replace("path", ":key$", "").alias("entry"), key.alias("key"))
    # One value's keys; a value fits where its own text fitted.
    named = keys.groupBy("oid", "name").agg(F.map_from_entries(F.collect_list(F.struct("entry", "key"))).alias("keys"))
    rest = nodes.filter(~F.col("path").rlike(r"(^|/)map:\d+:key(/|$)")).join(named, ["oid", "name"], "left")

    def step(a: Column, s: Column) -> Column:
        at = F.concat_ws("/", F.when(a["was"] != "", a["was"]), s)
        entry = F.concat_ws("/", F.when(a["was"] != "", a["was"]), F.regexp_replace(s, ":value$", ""))
        known = F.when(F.startswith(s, F.lit("map:")), F.try_element_at(F.col("keys"), entry))
        word = F.when(known.isNotNull(), F.concat(F.lit("map:"), known, F.lit(":value"))).otherwise(s)
        return F.struct(at.alias("was"), F.concat_ws("/", F.when(a["now"] != "", a["now"]), word).alias("now"))

    walked = F.aggregate(F.split("path", "/"), F.struct(F.lit("").alias("was"), F.lit("").alias("now")), step)["now"]
    return rest.withColumn("path", F.when(F.col("keys").isNull() | (F.col("path") == ""), F.col("path")).otherwise(walked)).drop("keys")


def node_diffs(old: World, new: World, tolerant: bool = False) -> DataFrame:
    """``oid, name, path, kind``: changed, type_mismatch, missing or extra nodes of properties in both dumps.

    Lists are compared by position, maps by key, whatever the order of their entries.  Exactly by default;
    ``tolerant`` takes floats within 1e-9 (relative) as equal.
    """
    a, b = changed_only(old, new)

    def cols(w: World, side: str) -> DataFrame:
        nodes = value_nodes(w).select(F.col("holder_id").alias("oid"), F.col("member").alias("name"), "path", "tag", "scalar")
        return _by_key(materialize(nodes, "value-nodes")).select("oid", "name", "path", F.struct("tag", "scalar").alias(side))

    j = cols(a, "a").join(cols(b, "b"), ["oid", "name", "path"], "full")
    floats = (F.col("a.tag") == "float") & (F.col("b.tag") == "float")
    near = F.coalesce(floats & close(double_of_bits("a.scalar"), double_of_bits("b.scalar")), F.lit(False)) if tolerant else F.lit(False)
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("a.tag").eqNullSafe(F.col("b.tag")), "type_mismatch").when(~F.col("a.scalar").eqNullSafe(F.col("b.scalar")) & ~near, "changed")
    return j.select("oid", "name", "path", kind.alias("kind")).filter("kind IS NOT NULL")


def summary(diffs: DataFrame, kinds: list[str] | None = None, path_prefix: str = "") -> DataFrame:
    """``kind, n_diffs, n_properties`` of node differences, of some kinds or below some path only."""
    d = diffs.filter(F.startswith("path", F.lit(path_prefix)))
    if kinds is not None:
        d = d.filter(F.col("kind").isin(kinds))
    return d.groupBy("kind").agg(F.count("*").alias("n_diffs"), F.count_distinct("oid", "name").alias("n_properties"))


def _opcodes(batches):
    """Edit steps between two lists of spelled scalars: ``op``, half-open spans, from 0."""
    from difflib import SequenceMatcher

    import pandas as pd

    for b in batches:
        out = []
        for oid, name, path, a, z in zip(b["oid"], b["name"], b["path"], b["a"], b["b"]):
            steps = SequenceMatcher(None, list(a), list(z), autojunk=False).get_opcodes()
            out += [(oid, name, path, op, i1, i2, j1, j2) for op, i1, i2, j1, j2 in steps if op != "equal"]
        yield pd.DataFrame(out, columns=["oid", "name", "path", "op", "old_from", "old_to", "new_from", "new_to"])


def list_edits(old: World, new: World) -> DataFrame:
    """Edit steps of lists of scalars that stand at the same place in both dumps with different lengths.

    ``oid, name, path, op, old_from, old_to, new_from, new_to``; ``op`` is insert, delete or replace, spans count
    from 0 and leave out their end.  Lists with members that are lists, maps or waifs are not aligned.
    """
    a, b = changed_only(old, new)

    def lists(w: World, side: str) -> DataFrame:
        n = value_nodes(w).select(F.col("holder_id").alias("oid"), F.col("member").alias("name"), "path", "tag", "scalar", "parent_path")
        places = n.filter("tag = 'list'").select("oid", "name", "path")
        at = F.regexp_extract("path", r"(\d+)$", 1).try_cast("int")
        inside = n.filter(F.col("path").rlike(r"(^|/)list:\d+$")).select("oid", "name", F.col("parent_path").alias("path"), at.alias("i"), F.col("tag").isin("list", "map", "waif").alias("deep"), F.concat_ws(":", "tag", "scalar").alias("x"))
        # One list is one value of one property, so its members fit where the value fitted.
        g = inside.groupBy("oid", "name", "path").agg(F.max("deep").alias("deep"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m"))
        every = places.join(g, ["oid", "name", "path"], "left").filter("NOT coalesce(deep, false)")
        return every.select("oid", "name", "path", F.coalesce(F.col("m.x"), F.array().cast("array<string>")).alias(side))

    j = lists(a, "a").join(lists(b, "b"), ["oid", "name", "path"]).filter(F.size("a") != F.size("b"))
    return j.mapInPandas(_opcodes, "oid bigint, name string, path string, op string, old_from int, old_to int, new_from int, new_to int")
